"""Search, clustering, mixtures, scores, databases and streams against plain Python."""

import random
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainforge.functions import alphabet, positions
from chainforge.functions.substitution import mismatch_distances
from chainforge.operators import search as se
from chainforge.operators.mixture import CategoricalMixture, logsumexp, masked
from chainforge.operators.scoring import SequenceScorer
from chainforge.plans import models

AA = alphabet.RESIDUES


def _rows(rng, n):
    out = []
    bases = [["".join(rng.choice("ACDE") for _ in range(rng.randrange(*r))) for r in ((3, 9), (3, 9), (4, 15))] for _ in range(8)]
    for i in range(1, n + 1):
        cdrs = []
        for c in rng.choice(bases):
            c = list(c)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(c))
                c[k : k + 1] = rng.choice([[], [rng.choice("ACDE")], [rng.choice("ACDE")] * 2, [rng.choice("ACDE")]])
            cdrs.append("".join(c) or "A")
        out.append((i, rng.choice("HKL"), *cdrs, rng.choice(["V1", "V2", None]), rng.choice(["J1", "J2"]), rng.choice(["human", "mouse"])))
    return out


def _fixed(s, w):
    left = (len(s) + 1) // 2
    return s[:left] + "-" * (w - len(s)) + s[left:]


def _brute(queries, rows, s, same, distances):
    group = {"H": "H", "K": "KL", "L": "KL"}
    out = set()
    for q in queries:
        for h in rows:
            if group[q[1]] != group[h[1]] or any(q[5 + "vjs".index(c[0])] is None or q[5 + "vjs".index(c[0])] != h[5 + "vjs".index(c[0])] for c in same):
                continue
            if abs(len(q[4]) - len(h[4])) > s.max_length_shift:
                continue
            a = [(_fixed(q[1 + k], se.CDR_WIDTHS[k]), _fixed(h[1 + k], se.CDR_WIDTHS[k])) for k in (1, 2, 3)]
            d = [sum(x != y for x, y in zip(*p)) for p in a]
            b12, b3 = floor((len(q[2]) + len(q[3])) * s.cdr_cutoff), floor(len(q[4]) * s.cdr_cutoff)
            if s.symmetric:
                b3 = min(b3, floor(len(h[4]) * s.cdr_cutoff))
                if s.mode == "123" and len(h[2]) + len(h[3]):
                    b12 = min(b12, floor((len(h[2]) + len(h[3])) * s.cdr_cutoff))
            d12 = d[0] + d[1] if s.mode == "123" else 0
            if d12 > b12 or d[2] > b3:
                continue
            dist = float(d12 + d[2])
            if s.blosum_cutoff >= 0:
                cells = [distances[y, x] for p in (a if s.mode == "123" else a[2:]) for x, y in zip(*p)]
                if max(cells) > s.blosum_cutoff:
                    continue
                dist = float(sum(cells))
            out.add((q[0], h[0], dist))
    return out


def _prepared(spark, rows):
    df = spark.createDataFrame(rows, "i long, c string, c1 string, c2 string, c3 string, v string, j string, s string").withColumn("block", F.lit("clash"))
    return df, se.prepare(df, F.col("i"), F.col("c"), {k: F.col(f"c{k}") for k in (1, 2, 3)}, F.col("v"), F.col("j"), F.col("s"))


def test_search_over_a_grid_of_settings(spark):
    rng = random.Random(1)
    rows = _rows(rng, 220)
    _, prepared = _prepared(spark, rows)
    prepared = prepared.cache()
    queries = [r for r in rows if r[0] % 3 == 0]
    q = prepared.where("seq_id % 3 = 0")
    distances = mismatch_distances()
    found = 0
    for mode, cutoff, shift, symmetric, blosum, same in [
        ("3", 0.3, 2, False, -1, ()), ("3", 0.25, 0, False, -1, ("v",)), ("123", 0.3, 1, False, -1, ()), ("123", 0.3, 2, True, -1, ("v", "j", "species")), ("3", 0.0, 2, False, -1, ()),
        ("3", 0.3, 2, True, -1, ("species",)), ("123", 0.2, 2, False, 7, ()), ("3", 0.3, 2, False, 5, ("v",)), ("3", 0.1, 2, False, -1, ()),
    ]:
        s = se.SearchSettings(mode, cutoff, blosum, shift, symmetric)
        got = {(r["query_id"], r["seq_id"], r["distance"]) for r in se.search(q, prepared, s, same, distances).collect()}
        want = _brute(queries, rows, s, same, distances)
        assert got == want
        found += len(got)
    assert found > 1000
    assert se.search(q.limit(0), prepared).count() == 0 and se.search(q, prepared.limit(0)).count() == 0
    for bad in ({"mode": "12"}, {"cdr_cutoff": 0.5}, {"blosum_cutoff": -3}, {"max_length_shift": -1}):
        with pytest.raises(ValueError):
            se.SearchSettings(**bad)


def test_single_linkage(spark):
    rng = random.Random(2)
    rows = _rows(rng, 150)
    rows += [(500 + i, *rows[i][1:]) for i in range(10)]
    df, prepared = _prepared(spark, rows)
    extra = spark.createDataFrame([(9000,)], "seq_id long")
    every = df.select(F.col("i").alias("seq_id")).unionAll(extra)
    s = se.SearchSettings("123", 0.2, max_length_shift=0)
    for by_j in (True, False):
        pairs = _brute(rows, rows, s, ("v", "species", "j") if by_j else ("v", "species"), None)
        parent = {r[0]: r[0] for r in rows}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b, _ in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        members = {}
        for x in parent:
            members.setdefault(find(x), []).append(x)
        real = sorted(k for k, m in members.items() if len(m) > 1)
        want = {x: real.index(find(x)) + 2 if find(x) in real else 1 for x in parent} | {9000: 0}
        got = {r["seq_id"]: r["cluster"] for r in se.single_linkage(prepared, every, se.SearchSettings("123", 0.2), by_j).collect()}
        assert got == want


def test_tags_never_exceed_the_distance(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice(AA + "-") for _ in range(36)), "".join(rng.choice(AA + "-") for _ in range(36))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", se.tag_lower_bound(se.tag_planes(F.col("a")), se.tag_planes(F.col("b"))).alias("t")).collect()
    ends = lambda s: s[:8] + s[-8:]
    for r in got:
        real = sum(x != y for x, y in zip(ends(r["a"]), ends(r["b"])))
        assert real - 8 < r["t"] <= real


def test_distances_and_numbers(spark):
    t = positions.Template(["1", "27", "28", "118"], "H", "imgt")
    df = spark.createDataFrame([(1, "ACDE"), (2, "ACDF"), (3, "AAAE")], "i int, a string")
    got = {(r["i"], r["j"]): r["distance"] for r in se.distance_edges(df, "i", "a", t).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (2, 3): 3}
    assert {r["distance"] for r in se.distance_edges(df, "i", "a", t, "cdr1").collect()} == {0, 2}
    with pytest.raises(ValueError):
        se.distance_edges(df.withColumn("a", F.lit("AC")), "i", "a", t)
    with pytest.raises(ValueError):
        se.distance_edges(df, "i", "a", t, max_rows=2)
    nums = se.dense_numbers(spark.range(100, 160).toDF("k").repartition(7), "k").collect()
    assert {r["k"]: r["number"] for r in nums} == {100 + i: i + 1 for i in range(60)}


def _model(k, length, seed):
    return CategoricalMixture(k, length).initialise(seed)


def test_scores_equal_the_definition(spark):
    rng = random.Random(4)
    m = _model(4, 9, 1)
    mu, w = m.parameters()
    seqs = ["".join(rng.choice(alphabet.ALPHABET) for _ in range(9)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(seqs)) + [(99, None)], "i int, s string").withColumn("score", F.lit("clash"))
    for mask, terminal, gaps in ((None, False, False), ([i % 2 == 0 for i in range(9)], False, False), (None, True, False), (None, False, True)):
        keep = None if mask is None else F.array(*(F.lit(x) for x in mask))
        codes = masked(m.encode(F.col("s")), keep, terminal, gaps)
        got = {r["i"]: (r["score"], r["mean"]) for r in m.score(m.score(df, codes), codes, True, "mean").collect()}
        assert got[99] == (None, None)
        for i, s in enumerate(seqs):
            core = range(len(s) - len(s.lstrip("-")), len(s.rstrip("-")))
            on = [p for p in range(9) if (mask is None or mask[p]) and (not terminal or p in core) and (not gaps or s[p] != "-")]
            joint = np.array([np.log(w[k]) + sum(np.log(mu[k, p, alphabet.ALPHABET.index(s[p])]) for p in on) for k in range(4)])
            want = logsumexp(joint[:, None])[0]
            assert abs(got[i][0] - want) < 1e-9 and (not on or abs(got[i][1] - want / len(on)) < 1e-9)
    lj = {r["i"]: r["log_joint"] for r in m.log_joint(df, m.encode(F.col("s"))).collect()}
    cl = {r["i"]: r["cluster"] for r in m.predict(df, m.encode(F.col("s"))).collect()}
    assert all(cl[i] == int(np.argmax(lj[i])) for i in range(50)) and cl[99] is None


def test_fit_improves_and_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice(t) for t in rng.choice([["AC"] * 6, ["WY-"] * 6, ["KR"] * 6])) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    bounds = []
    m = _model(3, 6, 123)
    enc = df.select(m.encode(F.col("s")).alias("codes"))
    for _ in range(5):
        b, resp, counts = m.em_step(enc)
        assert abs(resp.sum() - 300) < 1e-6 and np.allclose(counts.sum(2), resp[:, None])
        bounds.append(b)
        m.load(counts / counts.sum(2, keepdims=True), resp / resp.sum())
    assert all(b >= a - 1e-9 for a, b in zip(bounds, bounds[1:]))
    one, two = CategoricalMixture(3, 6), CategoricalMixture(3, 6)
    f1 = one.fit(df.coalesce(1), one.encode(F.col("s")), max_iter=20, n_restarts=2)
    f2 = two.fit(df.repartition(7), two.encode(F.col("s")), max_iter=20, n_restarts=2)
    assert abs(f1.log_likelihood - f2.log_likelihood) < 1e-6 and np.allclose(one.parameters()[0], two.parameters()[0])
    fitted, start = one.information(df, one.encode(F.col("s"))), _model(3, 6, 1).information(df, one.encode(F.col("s")))
    assert fitted["bic"] < start["bic"] and fitted["aic"] < start["aic"]
    counts = {(r["k"], r["pos"], r["aa"]): r["count"] for r in one.profiles(df.union(spark.createDataFrame([("",)], "s string")), "s").collect()}
    assert sum(counts.values()) == 300 * 6
    assert {r["cluster"] for r in one.assign(spark.createDataFrame([("",), (None,)], "s string"), "s").collect()} == {-1}


def test_model_arguments(spark):
    for bad in ((0, 3), (2, 0)):
        with pytest.raises(ValueError):
            CategoricalMixture(*bad)
    with pytest.raises(RuntimeError):
        CategoricalMixture(2, 3).parameters()
    with pytest.raises(ValueError):
        CategoricalMixture(2, 3).load(np.ones((2, 3, 20)), np.ones(2))
    m = _model(3, 2, 1)
    mu, w = m.parameters()
    assert abs(w.sum() - 1) < 1e-12 and np.allclose(mu.sum(2), 1)
    back = CategoricalMixture.from_tables(*m.to_tables(spark))
    assert np.allclose(back.parameters()[0], mu)
    m.load(mu, np.array([0.5, 0.0, 0.5]))
    assert np.allclose(m.prune().parameters()[0], mu[[0, 2]]) and m.n_components == 2


def test_chain_scores(spark):
    codes = positions.canonical_numbering("imgt", "H")
    t = positions.Template(codes, "H", "imgt")
    m = _model(3, len(codes), 7)
    plain = [c for c in codes if c.isdigit()]
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(AA) for _ in plain), plain, "H") for i in range(5)] + [(9, "ACX", ["1", "2", "3"], "H"), (10, "AC", ["1", "2"], "A"), (11, None, None, "H")]
    df = spark.createDataFrame(rows, "i int, s string, n array<string>, c string")
    sc = SequenceScorer({"H": m}, {"H": t}, "training_set_adjust")
    p = sc.prepare(df, F.col("s"), F.col("n"), F.col("c")).cache()
    raw = {r["i"]: r["value"] for r in SequenceScorer({"H": m}, {"H": t}).score(p).collect()}
    adjusted = {r["i"]: r["value"] for r in sc.score(p).collect()}
    assert all(abs(adjusted[i] - raw[i] - 59.5617) < 1e-9 for i in range(5)) and raw[9] is raw[10] is raw[11] is None
    top = sc.closest_clusters(p, "i", 3).collect()
    best = {r["i"]: r["cluster"] for r in top if r["rank"] == 1}
    assigned = {r["i"]: r["value"] for r in sc.score(p, mode="assign").collect()}
    assert len(top) == 15 and all(best[i] == assigned[i] for i in range(5))
    mu, _, letters = sc.retrieve_cluster(1, "H")
    assert mu.shape == (1, len(codes), 21) and letters == alphabet.ALPHABET and sum(sc.standard_mask("H", "cdr")) == t.region_size("cdr")
    per = sc.residue_probabilities(p.where("i = 0"), "i", F.lit(1)).collect()
    assert len(per) == len(plain)
    for r in per:
        q = codes.index(r["code"])
        assert abs(r["log_p"] - np.log(m.parameters()[0][1, q, alphabet.ALPHABET.index(r["aa"])])) < 1e-9 and r["best_aa"] == alphabet.ALPHABET[int(m.parameters()[0][1, q].argmax())]
    h = {r["i"]: r for r in SequenceScorer({"H": m}, {"H": t}).humanize(p, "s", "n", s_thresh=1.0).collect()}
    grafted = {r["i"]: r for r in SequenceScorer({"H": m}, {"H": t}).humanize(p, "s", "n", s_thresh=1e9).collect()}
    for i in range(5):
        assert h[i]["new_score"] >= raw[i] and len(h[i]["mutations"]) > 50 and grafted[i]["mutations"] == [] and grafted[i]["new_seq"] == rows[i][1]
        a, spot, b = h[i]["mutations"][0].split("_")
        assert rows[i][1][int(spot) - 1] == a or a == "-"
    assert h[9]["new_score"] is None
    d = sc.diagnostics(df.where("i = 10"), F.col("n"), F.lit("H")).first()
    assert len(d["gapped"]) == len(codes) - 2 and d["unusual"] == []
    drawn = sc.sample(spark, "H", 0, 20, 1).collect()
    assert len({r["seq"] for r in drawn}) == 20 and all(len(r["seq"]) <= len(codes) for r in drawn) and len(sc.consensus("H", 0)) <= len(codes)
    with pytest.raises(ValueError):
        sc.standard_positions("A")
    with pytest.raises(ValueError):
        SequenceScorer({"H": m}, {"H": t}, "other")


def test_database_round_trip(spark, tmp_path):
    from chainforge.operators.annotate import chain_profiles
    from chainforge.sources import database as db
    from tests.test_sequences import _germlines

    g = _germlines(spark)
    v = {r["gene_name"]: r["aligned_seq"].replace("-", "") for r in g.collect()}
    h, k = v["IGHV2-1*01"] + "ARDYW" + v["IGHJ2*01"], v["IGKV3-1*01"] + "QQSYT" + v["IGKJ3*01"]
    df = spark.createDataFrame([(1, h, "m1"), (2, k, "m2"), (3, "A" * 100, "m3"), (4, "bad!", "m4"), (5, None, "m5"), (6, h, "m6")], "seq_id long, seq string, metadata string")
    info = db.Info(memo="test")
    sequences, chains, rejects = db.from_sequences(df, "seq", g, chain_profiles(g), info)
    db.write_database(str(tmp_path / "db"), sequences, chains, rejects, info)
    with pytest.raises(Exception, match="(?i)exists"):
        db.write_database(str(tmp_path / "db"), sequences, chains, rejects, info)
    got = db.Database(spark, str(tmp_path / "db"))
    assert got.metadata()["memo"] == "test" and {r["seq_id"]: r["code"] for r in got.rejects.collect()} == {3: "identity", 4: "invalid", 5: "invalid"}
    names = {r["seq_id"]: (r["v_gene"], r["j_gene"]) for r in got.genes().collect()}
    assert names[1] == ("IGHV2-1*01", "IGHJ2*01") and names[2] == ("IGKV3-1*01", "IGKJ3*01")
    hits = {(r["query_id"], r["seq_id"]) for r in se.search(got.searchable(), got.searchable(), se.SearchSettings("123", 0.2), ("v",)).collect()}
    assert hits == {(1, 1), (1, 6), (6, 1), (6, 6), (2, 2)}
    with pytest.raises(RuntimeError):
        db.Database(spark, str(tmp_path / "none"))
    both = db.from_sequences(spark.createDataFrame([(1, h + "GGGS" + k, "m")], df.schema), "seq", g, chain_profiles(g), db.Info(sequence_type="paired"))
    assert {r["chain_group"] for r in both[1].collect()} == {"H", "KL"}
    full = spark.createDataFrame([(1, h, None, "IGHV2-1*01", "IGHJ2*01"), (2, h, "_".join(map(str, range(1, len(h) + 1))), "IGHV2-1*01", "IGHJ2*01"), (3, h, None, None, "IGHJ2*01"), (4, h, "1_2", "IGHV2-1*01", "IGHJ2*01")], "seq_id long, heavy_chain string, heavy_numbering string, heavy_vgene string, heavy_jgene string")
    _, chains, rejects = db.from_full_chains(full, {c: c for c in full.columns}, chain_profiles(g))
    assert {r["seq_id"] for r in chains.collect()} == {1, 2} and {(r["seq_id"], r["code"]) for r in rejects.collect()} == {(3, "genes"), (4, "numbering")}
    with pytest.raises(ValueError):
        db.from_full_chains(full, {"heavy_chain": "heavy_chain"}, chain_profiles(g))


def test_streams(spark, tmp_path):
    from chainforge.streaming import stateless as st

    lines = [(i, "s,ACD,v,j,h" if i % 3 else 's,A"CD,v,j,h', f"2024-01-01 0{i // 10}:00:00") for i in range(30)]
    df = spark.createDataFrame(lines, "raw_id long, line string, at string").withColumn("at", F.to_timestamp("at"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = st.read_stream(spark, str(tmp_path / "in"), df.schema, 1)
    st.write_parted(st.parse_stream(stream, F.col("raw_id"), F.col("line")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 20 and {r["reason"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"quoting"}
    counts = st.counts_by_time(st.read_stream(spark, str(tmp_path / "in"), df.schema), "at", F.col("raw_id") % 2)
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.table("counted").collect()) == 30 and spark.table("counted").count() == 6


def test_large_buckets_are_linked_like_all_pairs(spark):
    from chainforge.operators import linkage

    rng = np.random.default_rng(10)
    for mode, symmetric, cutoff in (("123", False, -1), ("123", True, -1), ("3", False, -1), ("123", False, 5)):
        base = rng.integers(65, 70, (4, 30)).astype(np.uint8)
        a = base[rng.integers(0, 4, 150)]
        flips = rng.random(a.shape) < 0.08
        a[flips] = rng.integers(65, 70, flips.sum())
        table = None if cutoff < 0 else np.abs(np.arange(128)[:, None] - np.arange(128)[None, :]) * 2.0
        bucket = linkage._Bucket(a[:, :18], a[:, 18:], rng.integers(1, 4, 150), 2, mode, cutoff, table, symmetric)
        every = np.arange(150)
        want = linkage._joined(np.arange(150), *np.nonzero(bucket.link(every, every)[0]))
        assert np.array_equal(bucket.components(), want)
    rows = [(i, "".join(chr(c) for c in r[:9]), "".join(chr(c) for c in r[9:18]), "".join(chr(c) for c in r[18:]), 2, 2) for i, r in enumerate(a, 1)]
    df = spark.createDataFrame(rows, "seq_id long, aln1 string, aln2 string, aln3 string, b12 int, b3 int").withColumn("k", F.lit(1))
    df = df.select("*", F.col("aln3").alias("shared"), F.lit(-1).alias("block"), F.lit(1).alias("n"))  # no column is common to the bucket
    found = []
    for most in (20_000, 40, 6):  # whole, cut by blocks of the columns, and these cut into chunks
        links = [(r["a"], r["b"]) for r in linkage.bucket_links(df, ["k"], "3", -1, None, False, most).collect()]
        parent = {i: i for i in range(1, 151)}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in links:
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        found.append([find(i) for i in range(1, 151)])
    assert found[0] == found[1] == found[2]


def test_registered_fit_runs_until_the_tolerance_is_met(spark, sf, monkeypatch):
    starts, fits = [], []
    initialise, fit = CategoricalMixture.initialise, CategoricalMixture.fit
    monkeypatch.setattr(CategoricalMixture, "initialise", lambda self, seed: (starts.append(seed), initialise(self, seed))[1])
    monkeypatch.setattr(CategoricalMixture, "fit", lambda self, *a, **k: (fits.append(fit(self, *a, **k)), fits[-1])[1])
    assert models.m7_em_fit(spark, sf).count() > 0
    assert fits[0].converged and len(starts) == 3


def test_light_chains_are_scored_by_their_own_model(spark, sf):
    scorer = models._both_scorer("training_set_adjust")
    chains = models.both_chains(spark, sf)
    assert {r[0] for r in chains.select("chain").distinct().collect()} == {"H", "K", "L"}
    got = {r["chain_id"]: r for r in scorer.score(scorer.prepare(chains, F.col("seq"), F.col("num"), F.col("chain"))).collect()}
    assert len(got) == chains.count()
    kappa = next(r for r in got.values() if r["chain"] == "K" and r["aligned"])
    model = models.rule_model(len(models.LIGHT.codes))
    x = [alphabet.ALPHABET.index(a) for a in kappa["aligned"]]
    joint = np.log(model.parameters()[0])[:, np.arange(len(x)), x].sum(1) + np.log(model.parameters()[1])
    assert kappa["chain_type"] == "L" and abs(kappa["value"] - logsumexp(joint[:, None])[0] - 33.22445) < 1e-6
    new = {r["chain_id"] for r in models.h11_both_humanize(spark, sf).where("new_score IS NOT NULL").collect()}
    assert kappa["chain_id"] in new
