"""The training-data algorithms against brute force on small fixtures with nulls, ties, repeats and clashing columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from chainforge.llm import similarity_clusters as sc
from chainforge.llm.canonical_names import NameIndex, deletions, distance, map_names
from chainforge.llm.hidden_duplicates import collapsed, fields, hidden_duplicates, keyed, letters
from chainforge.llm.link_groups import link_groups
from chainforge.llm.term_frequency import term_frequencies


def test_term_frequencies(spark):
    rows = [(1, "A*01"), (2, "A*01_B_B"), (3, None), (4, ""), (5, "B"), (6, "a*01"), (7, "A*01__C"), (8, "A*01"), (9, "A*01")]
    df = spark.createDataFrame(rows, "id long, v string").withColumn("term", F.lit("clash"))
    got = {(r["term"], r["occurrences"], r["records"], r["mark"]) for r in term_frequencies(df, F.col("id"), {"v": F.col("v")}, partitions=3).collect()}
    assert got == {("A*01", 5, 5, "common"), ("B", 3, 2, "rare"), ("a*01", 1, 1, "rare"), ("C", 1, 1, "rare")}
    assert term_frequencies(df.limit(0), F.col("id"), {"v": F.col("v")}).count() == 0


def _canonical(spark, rows):
    df = spark.createDataFrame(rows, "id long, s string, h string").withColumn("k1", F.lit(1))
    return keyed(df, "t", F.col("id"), [letters(F.col("s")), fields(F.col("h"))])


def test_hidden_duplicates_with_and_without_hot_keys(spark):
    rows = [(5, "AC D", "a=1|b=2"), (3, "acd", "B: 2; A: 1"), (9, "(A-C-D)", "b = 2\ta = 1"), (4, "ACD", "a=2|b=1"), (7, None, None), (8, "", ""), (10, "ACD", "a=1")]
    rows += [(100 + i, "HOT" + "-" * (i % 5), "x=1") for i in range(50)] + [(None, "ACD", "a=1|b=2"), (3, "acd", "B: 2; A: 1")]
    want = {(3, 5), (3, 9), (7, 8)} | {(100, 100 + i) for i in range(1, 50)}
    for hot in (10_000, 10, 1):
        keys = _canonical(spark, rows)
        assert {(r["kept_id"], r["copy_id"]) for r in hidden_duplicates(keys, hot_rows=hot, salts=4).collect()} == want
        n = {r["kept_id"]: r["n_copies"] for r in collapsed(keys, hot_rows=hot, salts=4).collect()}
        assert n == {3: 4, 4: 1, 7: 2, 10: 1, 100: 50}
    assert hidden_duplicates(_canonical(spark, rows).limit(0)).count() == 0


def _union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in parent}


def test_link_groups(spark):
    random.seed(4)
    hub = [(1, 10 + i) for i in range(40)] + [(10, 60), (60, 61)]
    chain = [(500 + i, 501 + i) for i in range(70)]
    pairs = hub + chain + [(random.randrange(2000, 2300), random.randrange(2000, 2300)) for _ in range(150)]
    pairs += [(b, a) for a, b in pairs[:30]] + [(5, 5), (None, 1), (2, None)]
    want = _union_find([(a, b) for a, b in pairs if a is not None and b is not None and a != b])
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("node", F.lit(0))
    for depth in (24, 8, 2, 1, 0):  # peeled to the end, or with the rest of the component hanging on the peeled part
        assert {tuple(r) for r in link_groups(df, "a", "b", depth).collect()} == want
    assert link_groups(df.limit(0), "a", "b").count() == 0


def test_link_groups_of_a_large_star_and_a_long_path(spark):
    ids = spark.range(1, 1_000_000, numPartitions=4)
    star = ids.select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    path = spark.range(2_000_000, 2_010_000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    got = link_groups(star.unionAll(path), "a", "b").groupBy("group_id").count().collect()
    assert sorted(r["count"] for r in got) == [10_001, 1_000_000]
    hub = ids.select((F.col("id") + 3_000_000).alias("a"), F.lit(9_000_000).cast("long").alias("b"))  # the hub is the larger end, in no peeled component
    got = link_groups(star.unionAll(star.limit(1).select(F.lit(0).cast("long"), F.lit(1_000_001).cast("long"))).unionAll(hub), "a", "b").groupBy("group_id").count().collect()
    assert sorted((r["group_id"], r["count"]) for r in got) == [(0, 1_000_001), (3_000_001, 1_000_000)]


def _mutants(rng, n, length, families):
    bases = [[rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(length)] for _ in range(families)]
    out = []
    for _ in range(n):
        s = list(rng.choice(bases))
        for _ in range(rng.randrange(0, length // 5)):
            s[rng.randrange(length)] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
        out.append("".join(s))
    return out


def test_similarity_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, s, rng.choice("vw")) for i, s in enumerate(_mutants(rng, 260, 40, 4) + _mutants(rng, 140, 57, 2), 1)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)] + [(2000, "", "v"), (2001, "", "v"), (2002, None, "v"), (None, "AC", "v"), (2003, "ACD", None), (2004, "ACD", None)]
    pairs = [
        (a, b)
        for k, (a, s, v) in enumerate(rows)
        for b, t, w in rows[:k]
        if None not in (a, b, s, t) and v == w and len(s) == len(t) and sum(x != y for x, y in zip(s, t)) * 10 <= len(s)
    ]
    want = _union_find(pairs)
    df = spark.createDataFrame(rows, "i long, s string, v string").withColumn("g", F.lit(1))
    for block, piece in ((20_000, 200_000), (24, 200_000), (24, 24), (20_000, 7), (24, 1)):  # groups in one piece, in several, in as many as bands and cut by key
        got = {tuple(r) for r in sc.similarity_clusters(df, F.col("i"), F.col("s"), [F.col("v")], block_rows=block, piece_rows=piece).collect()}
        assert got == want
    sizes = {}
    for c, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    parts = sc.cluster_profiles(df, F.col("i"), F.col("s"), [F.col("v")]).collect()
    total = {}
    for p in parts:
        total[p["cluster_id"]] = total.get(p["cluster_id"], 0) + p["n_rows"]
        assert p["radius"] <= 0.1 and p["typical_ids"][0] == p["medoid_id"] and len(p["typical_ids"]) <= 3
    assert total == sizes
    assert sc.similarity_clusters(df.limit(0), F.col("i"), F.col("s"), [F.col("v")]).count() == 0


def test_profiles_are_the_same_at_every_size(spark):
    rng = random.Random(8)
    rows = [(i, s, "v") for i, s in enumerate(_mutants(rng, 40, 40, 1), 1)] + [(500, "", "v"), (501, "", "v")]
    rows += [(600 + i, rows[i][1], "v") for i in range(9)]
    df = spark.createDataFrame(rows, "i long, s string, v string")
    one, many = ({tuple(map(str, r)) for r in sc.cluster_profiles(df, F.col("i"), F.col("s"), [F.col("v")], block_rows=block).collect()} for block in (20_000, 8))
    assert one == many
    assert any(int(r[3]) > 5 for r in one) and len({r[0] for r in one}) < len(one)


def test_bit_planes_and_bands():
    rng = np.random.default_rng(3)
    for length in (0, 1, 8, 63, 64, 65, 130, 300):
        a = rng.integers(0, 27, (40, length)).astype(np.uint8)
        want = (a[:, None, :] != a[None, :, :]).sum(2)
        planes = sc.bit_planes(a)
        assert np.array_equal(sc._distances(planes, planes), want)
        i, j = rng.integers(0, 40, 90), rng.integers(0, 40, 90)
        assert np.array_equal(sc._alike(planes, i, j, 5), want[i, j] <= 5)
    for size in (1, 20_000, 200_000, 10**7):
        rows, bands = sc.banding(size, 0.1)
        assert rows >= 6 and (1 - (0.9 / 1.1) ** rows) ** bands < 1e-6
    assert sc.banding(1, 0.1) == (6, 40) and sc.banding(5, 0.0)[1] == 1
    base = rng.integers(0, 20, (1, 121)).astype(np.uint8).repeat(4000, 0)  # pairs just at the limit share a band
    other = base.copy()
    for row, at in zip(other, rng.random(other.shape).argsort(1)[:, :12]):
        row[at] = (row[at] + 1) % 20
    for size in (1, 400_000):
        rows, bands = sc.banding(size, 0.1)
        groups = np.zeros(4000, np.int64)
        met = np.zeros(4000, bool)
        for x, y in zip(sc.band_keys(base, groups, rows, range(bands)), sc.band_keys(other, groups, rows, range(bands))):
            met |= x == y
        assert met.all()


def test_large_runs_are_linked_like_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 20, (3, 50)).astype(np.uint8)
    a = base[rng.integers(0, 3, 300)]
    flips = rng.random(a.shape) < 0.07
    a[flips] = rng.integers(0, 20, flips.sum())
    want = np.arange(300)
    for i in range(300):
        hit = np.flatnonzero((a != a[i]).sum(1) <= 5)
        want = sc._merge(want, np.full(len(hit), i), hit)
    for short in (2048, 0):
        assert np.array_equal(sc._link_run(sc.bit_planes(a), np.arange(300), np.arange(300), 5, short), want)


ENTRIES = [(1, "IGHV1-2*01"), (2, "IGHV1-2*02"), (3, "IGHV3-7*01"), (4, "IGHV1S34*01")]
LIGHT = [(10, "IGKJ1*01"), (11, "IGLJ1*01"), (12, "IGKJ5*02"), (13, "IGLJ3*01"), (14, "IGKJ11*01")]


def test_names_are_read_as_meant():
    index = NameIndex([(*e, 0) for e in ENTRIES], ("IGKV", "IGLV", "IGHJ"))
    meant = {
        "ighv1-2*01": 1, " IGHV 1-02 allele 2.": 2, "IGVH1_2:01": 1, "lGHV3-7": 3, "Vh3 7-1": 3, "human: IGHU3.7*o1 (F)": 3, "IG-HV1s34*01\n": 4, "IGHV1-34*01": 4, "rattus - HV3–7^01 [ORF]": 3,
        "3-7*01": 3, "IGHV1-2": 0, "IGHV1-2*03": 0, "IGHV1-3*01": 0, "IGKV1-2*01": 0, "TRAV1-2*01": 0, "see notebook": 0, "no call": 0, "IGHV": 0, "": 0, "x" * 100_000: 0, "IGHV" + "0" * 100_000: 0,
        "HVIs34*01": 4, "lGHV ls34 01": 4, "IGVl - 2:02": 2, "IGKKV1-2*01": 0, "IGKV 1-2*01 IGHV1-2*02": 0, "hu - ighv3-7 94.8% id": 3,
    }
    assert {v: index.find(v)[0] for v in meant} == meant
    light = NameIndex([(*e, 0) for e in LIGHT], ("IGHV", "IGKV", "IGHJ"))
    meant = {"IGKJl": 10, "jl1*01": 11, "IGJL1*01": 11, "IGJ5*02": 12, "IGJ1*01": 0, "igkh5-02": 12, "IGHJ1*01": 0, "GLJ3": 13, "IGLJ5*02": 0, "IGKJ 1I*01": 14, "JL l": 11, "IGKJ-I allele 01": 10, "IGK Jl*01": 10, "IGJLI": 11, "IGK J ll": 14}
    assert {v: light.find(v)[0] for v in meant} == meant
    assert NameIndex([]).find("IGHV1-2*01")[0] == 0


def test_names_with_long_notes_and_padding():
    index = NameIndex([(*e, 0) for e in ENTRIES])
    note = "see the notebook of last year, 12.5 % id; " * 200
    meant = {
        f"IGHV1-2*01 ({note})": 1, f"[{note}] IGHV1-2*02 gene" + " ;" * 5000: 2, " \n" * 5000 + "human: IGHV3-7*01": 3, "IGHV" + " -" * 5000 + "1-2*01": 1, "IGHV3-7" + "*" * 5000 + "01": 3,
        "rattus - IGHV1S34*01" + " orf" * 2000: 4, "(" * 100_000 + "IGHV1-2*01": 1, "1" * 100_000 + "x": 0, "IGHV1-2" + "-" * 100_000 + "x": 0, "1.1" * 50_000: 0, "i g" * 50_000: 0, "[(" * 50_000: 0,
    }
    assert {v: index.find(v)[0] for v in meant} == meant


def test_distance_and_deletions():
    assert distance("a.1", "a.2") > 2 and distance("a.1", "a.1.1") > 2 and distance("ighv.1.2", "igvh.1.2") == 1
    assert distance("ighv", "ighv") == 0 and distance("igvh", "ighv") == 1 and distance("lghv", "ighv") == 0.75 and distance("", "ab") == 2
    rng = random.Random(7)
    for _ in range(300):  # two words within two edits share a deletion of at most two letters each
        a = "".join(rng.choice("abc") for _ in range(5))
        b = list(a)
        for _ in range(2):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(2)] = rng.choice(["", "a", "c"])
        assert deletions(a) & deletions("".join(b))


def test_map_names(spark):
    df = spark.createDataFrame([(1, "IGHV1-2*01"), (2, "ighv1-2*01"), (2, "ighv1-2*01"), (3, None), (4, " "), (5, "what?"), (None, "IGHV3-7")], "i long, v string").withColumn("gene_id", F.lit(9))
    entries = spark.createDataFrame(ENTRIES, "gene_id long, gene_name string")
    got = map_names(df, F.col("i"), {"v": (F.col("v"), entries)}).collect()
    assert sorted((r["row_id"] or 0, r["gene_id"], r["outcome"]) for r in got) == [(0, 3, "matched"), (2, 1, "matched"), (2, 1, "matched"), (5, 0, "unmatched")]
    assert map_names(df.limit(0), F.col("i"), {"v": (F.col("v"), entries)}).count() == 0
    assert {r["outcome"] for r in map_names(df, F.col("i"), {"v": (F.col("v"), entries.limit(0))}).collect()} == {"unmatched"}


