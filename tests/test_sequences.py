"""Sequence, numbering, gene, liability and file operators against plain Python."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainforge.functions import alphabet, genes, liabilities, positions
from chainforge.functions.substitution import default_scores, mismatch_distances, mismatch_table
from chainforge.operators import annotate as ann
from chainforge.operators import gene_assignment as ga
from chainforge.plans import sequences
from chainforge.sources import files

AA = alphabet.RESIDUES


def test_validity_cleaning_and_encoding(spark):
    rows = [("ACDX", True), ("", False), (None, False), ("ACB", False), ("acd", False), ("AC\n", False), ("A-C", False)]
    df = spark.createDataFrame(rows, "s string, ok boolean")
    assert all(r["v"] == r["ok"] and (r["e"] is None) == r["ok"] for r in df.withColumn("v", alphabet.is_valid_sequence(F.col("s"))).withColumn("e", alphabet.validity_error(F.col("s"))).collect())
    assert [r[0] for r in spark.createDataFrame([(" a-c\nd",), (None,)], "s string").select(alphabet.clean_sequence(F.col("s"))).collect()] == ["ACD", None]
    codes = spark.createDataFrame([("AC-Y",), ("",), (None,)], "s string").select(alphabet.encode(F.col("s"))).collect()
    assert [r[0] for r in codes] == [[0, 1, 20, 19], [], None]
    for bad, length in (("AX", None), ("AC", 3)):
        with pytest.raises(Exception, match="cannot encode"):
            spark.createDataFrame([(bad,)], "s string").select(alphabet.encode(F.col("s"), length)).collect()


def test_masks(spark):
    rng = random.Random(1)
    texts = ["-" * 6, "A-----", "-----A", "A-C-D-", "ACDEFG"] + ["".join(rng.choice("A-C") for _ in range(6)) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("c", alphabet.encode(F.col("s")))
    got = df.select("s", "c", alphabet.mask_terminal_gaps(F.col("c")).alias("t"), alphabet.mask_gaps(F.col("c")).alias("g")).collect()
    for r in got:
        core = r["s"].strip("-")
        left = len(r["s"]) - len(r["s"].lstrip("-")) if core else 6
        want = [c if left <= i < left + len(core) else None for i, c in enumerate(r["c"])]
        assert r["t"] == want and r["g"] == [c if c != 20 else None for c in r["c"]]


def test_sorting_and_canonical_lists(spark):
    rng = random.Random(2)
    for scheme in positions.SCHEMES:
        for chain in ("H", "K"):
            codes = list(positions.canonical_numbering(scheme, chain))
            assert len(set(codes)) == len(codes)
            mixed = codes + ["-"] * 3
            rng.shuffle(mixed)
            df = spark.createDataFrame([(mixed,)], "c array<string>")
            assert df.select(positions.sort_codes(F.col("c"), scheme)).first()[0] == codes
    heavy = positions.canonical_numbering("imgt", "H")
    assert len(heavy) == 173 and len(positions.canonical_numbering("imgt", "L")) == 141
    assert heavy[heavy.index("111") :][:3] == ("111", "111A", "111B") and heavy[heavy.index("112") - 2 : heavy.index("112") + 1] == ("112B", "112A", "112")
    with pytest.raises(Exception, match="malformed"):
        spark.createDataFrame([(["1", "x2"],)], "c array<string>").select(positions.sort_codes(F.col("c"), "imgt")).collect()
    with pytest.raises(ValueError):
        positions.canonical_numbering("chothia")


def test_trim(spark):
    rows = [("ABCDE", ["-", "1", "2", "-", "3"]), ("AB", ["-", "-"]), ("AB", ["1", "2"]), ("", []), (None, None)]
    got = spark.createDataFrame(rows, "s string, n array<string>").select(positions.trim_alignment(F.col("s"), F.col("n")).alias("t")).collect()
    assert [tuple(r["t"]) if r["t"] else None for r in got] == [("BC", ["1", "2"], 1, 3), ("", [], 0, 0), ("AB", ["1", "2"], 0, 2), ("", [], 0, 0), None]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([("ABC", ["1"])], "s string, n array<string>").select(positions.trim_alignment(F.col("s"), F.col("n"))).collect()


def test_cdr_numbering_of_any_length(spark):
    sizes = [0, 1, 12, 13, 20, 60, 61, 62, 65, 66, 67, 119, 120, 1416, 1417, 1418, 1500]
    df = spark.createDataFrame([("A" * n,) for n in sizes] + [(None,)], "s string")
    for cdr in (1, 2, 3):
        for longest in (60, 3):
            got = {len(r[0]): r[1] for r in df.select("s", positions.number_imgt_cdr(F.col("s"), cdr, longest)).collect() if r[0] is not None}
            assert all(tuple(got[n]) == positions.imgt_cdr_codes(cdr, n) and len(set(got[n])) == n for n in sizes)


def test_cdr_numbering_by_length():
    assert positions.imgt_cdr_codes(3, 4) == ("105", "106", "116", "117")
    assert positions.imgt_cdr_codes(3, 14)[6:9] == ("111", "112A", "112") and positions.imgt_cdr_codes(3, 15)[6:9] == ("111", "111A", "112A")
    assert positions.imgt_cdr_codes(1, 13)[5:8] == ("32", "33A", "33") and positions.imgt_cdr_codes(2, 0) == ()
    order = {c: i for i, c in enumerate(positions.canonical_numbering("imgt", "H"))}
    for cdr, most in ((1, 18), (2, 20), (3, 36)):
        for n in range(most + 1):
            codes = [c for c in positions.imgt_cdr_codes(cdr, n) if c in order]
            assert len(positions.imgt_cdr_codes(cdr, n)) == n and codes == sorted(codes, key=order.get)
    with pytest.raises(ValueError):
        positions.imgt_cdr_codes(4, 3)


def test_template_operations_agree_with_loops(spark):
    rng = random.Random(3)
    codes = list(positions.canonical_numbering("imgt", "H"))
    t = positions.Template(codes[10:120], "H", "imgt")
    rows = []
    for i in range(40):
        kept = sorted(rng.sample(range(len(codes)), 60))
        num = ["-"] * rng.randrange(3) + [codes[k] for k in kept]
        num.insert(len(num), "200A")
        rows.append((i, "".join(rng.choice(AA) for _ in num), num))
    df = spark.createDataFrame(rows, "i int, s string, n array<string>")
    s, n = F.col("s"), F.col("n")
    got = df.select("s", "n", t.align(s, n).alias("a"), t.align_region(s, n, "cdr").alias("r"), t.unusual(n).alias("u"), t.forward(n).alias("f"), t.back(n).alias("b")).collect()
    for r in got:
        at = dict(zip(r["n"], r["s"]))
        aligned = "".join(at.get(c, "-") for c in t.codes)
        assert r["a"] == aligned and r["r"] == "".join(a for a, x in zip(aligned, t.labels) if x.startswith("cdr"))
        assert r["u"] == [c for c in r["n"] if c != "-" and c not in t.codes]
        assert r["f"] == [t.codes.index(c) if c in t.codes else -1 for c in r["n"]]
        assert r["b"] == [r["n"].index(c) if c in r["n"] else -1 for c in t.codes]
    codes2, msa = positions.build_msa(df, "s", "n", "H", "imgt")
    assert {len(r["aligned"]) for r in msa.collect()} == {len(codes2)} and codes2[-1] == "200A"
    assert set(codes) <= set(positions.build_msa(df, "s", "n", "H", "imgt", True)[0])
    with pytest.raises(ValueError):
        t.kept("cdr9")
    with pytest.raises(ValueError):
        positions.Template([], "H", "imgt")
    assert t.region_size("fmwk") + t.region_size("cdr") == len(t.codes)


def test_regions(spark):
    df = spark.createDataFrame([(["-", "1", "26", "27", "38", "39", "112A", "118"],)], "n array<string>")
    assert df.select(positions.region_labels(F.col("n"), "imgt", "K")).first()[0] == ["-", "fmwk1", "fmwk1", "cdr1", "cdr1", "fmwk2", "cdr3", "fmwk4"]
    assert positions.label_of("100A", "kabat", "H") == "cdr3" and positions.label_of("32", "martin", "H", "kabat") == "cdr1"
    with pytest.raises(ValueError):
        positions.bounds("imgt", "H", "martin")
    got = df.select(positions.imgt_cdr_text(F.lit("abcdefgh"), F.col("n"), 1), positions.imgt_cdr_text(F.lit("abcdefgh"), F.col("n"), 2)).first()
    assert tuple(got) == ("de", "")


def test_gene_names_survive_parsing_and_reassembly(spark):
    names = ["IGHV1-2*03", "IGHV1S34*01", "IGKJ5*01", "IGLV3", "IGHV10-1", "TRBV28*01", "IGHV1-2*03_IGHV9-9*01", "IGHV999-300*01"]
    df = spark.createDataFrame([(n, "rabbit") for n in names] + [(None, None)], "n string, s string").withColumn("g", genes.parse_gene(F.col("n"), F.col("s")))
    rows = df.select("n", "g", genes.reassemble_gene(F.substring("n", 1, 2), F.col("g.chain_code"), F.substring("n", 4, 1), F.col("g.family"), F.col("g.gene"), F.col("g.allele")).alias("back")).collect()
    for r in rows:
        assert r["back"] == (r["n"].split("_")[0] if r["n"] else None)
    by = {r["n"]: r["g"] for r in rows}
    assert tuple(by["IGHV1S34*01"]) == (3, 1, 34, 4, "1S", "34", "01") and by["IGHV999-300*01"]["family_number"] == 254 and by[None] is None


def _germlines(spark, seed=4, families=6):
    """Germlines of one strong pattern per chain: conserved residues at 23, 41 and 104."""
    rng = random.Random(seed)
    rows = []
    for chain, last in (("H", 128), ("K", 127), ("L", 127)):
        base = [rng.choice(AA) for _ in range(128)]
        base[22], base[40], base[103] = "C", "W", "C"
        for i in range(families):
            v = list(base)
            for p in rng.sample(range(128), 10):
                if p not in (22, 40, 103):
                    v[p] = rng.choice(AA)
            v = ["-" if p in (9, 72, 80, 81) or 30 <= p < 34 or 58 <= p < 62 else x for p, x in enumerate(v)]
            rows.append((f"IG{chain}V{i + 1}-1*01", "human" if i % 2 else "mouse", "mab", chain, "V", "".join(v[:104]) + "-" * 24))
            rows.append((f"IG{chain}J{i + 1}*01", "human" if i % 2 else "mouse", "mab", chain, "J", "-" * 117 + "".join(v[117:last]) + "-" * (128 - last)))
    return spark.createDataFrame(rows, "gene_name string, species string, receptor string, chain string, segment string, aligned_seq string")


def test_annotation_recovers_what_was_planted(spark):
    g = _germlines(spark)
    rows = g.collect()
    rng = random.Random(5)
    v = {r["gene_name"]: r["aligned_seq"] for r in rows}
    planted = []
    for i in range(60):
        chain = rng.choice("HKL")
        k = rng.randrange(1, 7)
        text, cdr3 = v[f"IG{chain}V{k}-1*01"][:104], "".join(rng.choice(AA) for _ in range(rng.randrange(4, 20)))
        j = v[f"IG{chain}J{k}*01"][117:].replace("-", "")
        core = text.replace("-", "") + cdr3 + j
        inside = [c for c, a in zip(range(1, 105), text) if a != "-"]
        before, after = "".join(rng.choice("GS") for _ in range(rng.randrange(8))), "".join(rng.choice("GS") for _ in range(rng.randrange(8)))
        planted.append((i, before + core + after, chain, len(before), inside, cdr3, len(j)))
    df = spark.createDataFrame([(p[0], p[1]) for p in planted] + [(100, "ACB"), (101, None), (102, "")], "i int, s string")
    got = {r["i"]: r["annotation"] for r in ann.annotate(df, F.col("s"), ann.chain_profiles(g)).collect()}
    right = total = 0
    for i, s, chain, lead, inside, cdr3, nj in planted:
        a = got[i]
        assert a["chain"] == chain and len(a["numbering"]) == len(s) and a["percent_identity"] > 0.9 and a["error"] is None
        num = a["numbering"]
        assert [c for c in num if c != "-"] == sorted((c for c in num if c != "-"), key=lambda c: _key(c))
        at = lead + len(inside)
        want = [str(c) for c in inside] + list(positions.imgt_cdr_codes(3, len(cdr3)))
        for c, w in zip(num[lead : at + len(cdr3)], want):
            n = int(re.match(r"\d+", w)[0])
            if not (27 <= n <= 38 or 56 <= n <= 65):  # these are numbered by their letters, which the germlines' gaps need not follow
                right += c == w
                total += 1
    assert right / total > 0.97
    for i in (100, 101, 102):
        assert got[i]["error"].startswith("Sequence contains invalid") and got[i]["chain"] is None and got[i]["percent_identity"] == 0
    for bad in (["H", "A"], [], ["Q"]):
        with pytest.raises(ValueError):
            ann.annotate(df, F.col("s"), ann.chain_profiles(g), bad)


def _key(code):
    n = int(re.match(r"\d+", code)[0])
    letters = code[len(str(n)) :]
    rank = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters)))
    return (n, -rank if n in (33, 61, 112) else rank)


def test_paired_annotation_in_either_order(spark):
    g = _germlines(spark)
    v = {r["gene_name"]: r["aligned_seq"].replace("-", "") for r in g.collect()}
    h, k = v["IGHV2-1*01"] + "ARDYW" + v["IGHJ2*01"], v["IGKV3-1*01"] + "QQSYT" + v["IGKJ3*01"]
    df = spark.createDataFrame([(0, h + "GGSGGS" + k), (1, k + "GGSGGS" + h), (2, h)], "i int, s string")
    got = {r["i"]: r for r in ann.annotate_paired(df, F.col("s"), ann.chain_profiles(g)).collect()}
    for i in (0, 1):
        assert got[i]["heavy"]["chain"] == "H" and got[i]["light"]["chain"] == "K"
        assert min(got[i]["heavy"]["percent_identity"], got[i]["light"]["percent_identity"]) > 0.9
        assert len(got[i]["heavy"]["numbering"]) == len(h) + len(k) + 6
    assert got[2]["light"]["percent_identity"] < 0.5 and got[2]["light"]["error"]


def test_prefilter_equals_loops(spark):
    rng = random.Random(6)
    kmers = [(rng.choice("HKL"), "".join(rng.choice("AC") for _ in range(9))) for _ in range(60)]
    scores = [(c, o, a, rng.randrange(-3, 5) / 2) for c in "HKL" for o in range(10) for a in "ACD"]
    seqs = [(i, "".join(rng.choice("ACD" if i % 2 else "AC") for _ in range(rng.randrange(60)))) for i in range(60)] + [(99, None)]
    got = {(r["i"], r["chain"]): (r["n_score"], r["c_score"]) for r in ann.prefilter(spark.createDataFrame(seqs, "i long, s string"), "i", "s", spark.createDataFrame(kmers, "chain string, kmer string"), spark.createDataFrame(scores, "chain string, offset int, residue string, score double")).collect()}
    known, cell = set(kmers), {(c, o, a): v for c, o, a, v in scores}
    for i, s in seqs:
        s = s or ""
        for c in "HKL":
            hits = [(c, s[p : p + 9]) in known for p in range(max(0, len(s) - 9))]
            n = max((sum(hits[p : p + 14]) for p in range(len(hits))), default=0)
            m = max((sum(cell.get((c, o, a), 0) for o, a in enumerate(s[p : p + 10])) for p in range(max(0, len(s) - 5))), default=0)
            assert got[i, c] == (n, max(m, 0))


def test_gene_assignment_equals_loops(spark):
    g = _germlines(spark)
    germ = [r.asDict() for r in g.collect()] + [dict(gene_name="IGHV9-9*01", species="human", receptor="mab", chain="H", segment="V", aligned_seq=next(r["aligned_seq"] for r in g.collect() if r["gene_name"] == "IGHV2-1*01"))]
    g2 = spark.createDataFrame(germ, g.schema)
    rng = random.Random(7)
    rows = []
    for i in range(30):
        text = "".join(rng.choice([a, a, a, rng.choice(AA + "-")]) for a in rng.choice(germ)["aligned_seq"])
        rows.append((i, text, rng.choice("HKL"), rng.choice(["human", "mouse", "unknown", None])))
    rows += [(50, None, "H", "human"), (51, "short", "H", "human"), (52, rows[0][1], "Z", "human"), (53, rows[0][1], "H", "rabbit")]
    df = spark.createDataFrame(rows, "i int, a string, c string, species string").withColumn("v_gene", F.lit("clash"))
    sub = default_scores()

    def score(q, t, mode):
        if mode == "identity":
            return sum(x == y for x, y in zip(q, t) if y != "-") / sum(y != "-" for y in t)
        return sum(4 if x == y else sub[x, y] for x, y in zip(q, t) if "-" not in (x, y))

    for mode in ("identity", "evalue"):
        got = {r["i"]: r for r in ga.assign_genes(df, F.col("a"), F.col("c"), F.col("species"), g2, mode).collect()}
        for i, q, c, sp in rows:
            r = got[i]
            v = [x for x in germ if x["chain"] == c and x["segment"] == "V" and (sp in (None, "unknown") or x["species"] == sp)]
            if q is None or len(q) != 128 or not v:
                assert (r["v_gene"], r["j_gene"], r["v_identity"], r["gene_species"]) == ("", "", 0, "unknown")
                continue
            best = max(score(q, x["aligned_seq"], mode) for x in v)
            tied = sorted(x["gene_name"] for x in v if abs(score(q, x["aligned_seq"], mode) - best) < 1e-9)
            assert r["v_gene"] == "_".join(tied) and abs(r["v_identity"] - best) < 1e-6
    with pytest.raises(ValueError):
        ga.assign_genes(df, F.col("a"), F.col("c"), F.col("species"), g, "other")
    assert ga.gene_sequence(g, spark.createDataFrame([("nope", "human")], "gene_name string, species string")).first()["aligned_seq"] == ""


def test_liabilities(spark):
    num = positions.canonical_numbering("imgt", "H")
    plain = [c for c in num if c.isdigit()]
    s = list("A" * 128)
    s[22] = s[103] = "C"
    s[3], s[28:30], s[57:60], s[107] = "C", "NG", "NNS", "M"
    s[10] = "M"  # outside the CDRs
    df = spark.createDataFrame([(1, "".join(s), plain)], "i int, s string, n array<string>")
    got = {(r["start"], r["description"]) for r in liabilities.find_liabilities(df, "s", "n", "H").collect()}
    assert got == {(3, "Unusual cysteine (severity: high)"), (28, "Deamidation (severity: high)"), (57, "Deamidation (severity: low)"), (58, "Deamidation (severity: high)"), (107, "Methionine / Tryptophan oxidation (severity: medium)")} | {(p, d) for p, d in got if d.startswith("N-glyc")}
    assert {p for p, d in got if d.startswith("N-glyc")} == {m.start() for m in re.finditer(r"(?=N[^P][ST])", "".join(s))}


def test_reading_frames(spark):
    df = spark.createDataFrame([(1, "atggcctaa"), (2, "NNN"), (3, ""), (4, None)], "i int, d string")
    got = {(r["i"], r["frame"]): r["protein"] for r in ann.reading_frames(df, "d").collect()}
    assert got[1, 1] == "MA*" and got[1, 2] == "WP" and got[1, -1] == "LGH" and got[2, 1] == "X" and got[3, 1] == "" and (4, 1) not in got


def test_substitution_distances(spark):
    d = mismatch_distances()
    assert d["A", "A"] == 0 and d["A", "R"] == d["R", "A"] == 5 and d["W", "Y"] == 2 and d["-", "A"] == 8 and min(d.values()) == 0
    assert mismatch_table(spark).count() == 441 and len(default_scores()) == 380


def test_files(spark, tmp_path):
    import gzip

    a, b = tmp_path / "a.fa", tmp_path / "b.fa.gz"
    a.write_text("\n>one x\nAC\nDE\n\n>two\r\nFG\r\n>\nAA\n>empty\n")
    with gzip.open(b, "wt") as f:
        f.write(">three\nHI\n")
    got = files.with_ids(files.read_fasta(spark, [str(b), str(a)])).orderBy("seq_id").collect()
    assert [(r["seqinfo"], r["sequence"], r["error"]) for r in got] == [("three", "HI", None), ("one x", "ACDE", None), ("two", "FG", None), ("", "AA", "no name"), ("empty", "", "no sequence")]
    assert [r["seq_id"] for r in got] == [1, 2, 3, 4, 5]
    c = tmp_path / "c.csv"
    c.write_text('h1;h2\nh3;h4\n"a;1";b\n\nc;\n')
    rows = files.read_csv_rows(spark, [str(c)], 2, 2, ";").orderBy("place").collect()
    assert [(r["c0"], r["c1"]) for r in rows] == [("a;1", "b"), ("c", None)]
    for bad in ("x.fa", [], None):
        with pytest.raises(ValueError):
            files.read_fasta(spark, bad)
    g = tmp_path / "human_imgt_mab_x_2024-01-02.fa.gz"
    with gzip.open(g, "wt") as f:
        f.write(">IGHV1-2*01\n" + "A" * 128 + "\n")
    assert tuple(files.read_germlines(spark, [str(g)]).first()) == ("IGHV1-2*01", "human", "mab", "2024-01-02", "A" * 128)
    with pytest.raises(ValueError):
        files.read_germlines(spark, [str(g), str(g)])
    t = tmp_path / "t.txt"
    t.write_text("# c\n1,A,C\n2,-\n//\n")
    assert [tuple(r) for r in files.read_templates(spark, str(t)).orderBy("pos").collect()] == [(1, ["A", "C"]), (2, [])]
    np.save(tmp_path / "mu.npy", np.full((2, 3, 21), 1 / 21))
    np.save(tmp_path / "w.npy", np.array([0.5, 0.5]))
    assert files.load_model(str(tmp_path / "mu.npy"), str(tmp_path / "w.npy")).specs()["sequence_length"] == 3
    df = spark.createDataFrame([("AC-",), ("",), (None,)], "s string")
    assert files.encode_to_parquet(df, F.col("s"), 3, str(tmp_path / "enc")).first()[0] == [0, 1, 20]
    with pytest.raises(ValueError):
        files.encode_to_parquet(df, F.col("s"), 3, str(tmp_path / "enc2"), 0)
    line = spark.createDataFrame([("a, b,,d",)], "l string").select(*(files.element(F.col("l"), i) for i in (1, 2, 9))).first()
    assert tuple(line) == ("b", None, None)
    files.write_rejects(spark.createDataFrame([("x", "bad"), ("y", None)], "t string, c string"), F.col("t"), F.col("c"), str(tmp_path / "rej"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "rej")).collect()] == ["x\tbad"]


def test_schemes_convert_there_and_back(spark):
    from chainforge.functions.schemes import from_imgt, to_imgt

    rng = random.Random(9)
    for chain, absent in (("H", {10, 73}), ("K", {73, 81, 82})):
        for _ in range(200):
            n1, n2, n3 = rng.randrange(5, 13), rng.randrange(3, 11), rng.randrange(4, 22)
            frame = lambda a, b: [str(i) for i in range(a, b + 1) if i not in absent]  # noqa: E731, B023
            last = 128 if chain == "H" else 127
            num = ["-"] + frame(1, 26) + list(positions.imgt_cdr_codes(1, n1)) + frame(39, 55) + list(positions.imgt_cdr_codes(2, n2)) + frame(66, 104) + list(positions.imgt_cdr_codes(3, n3)) + frame(118, last) + ["-"]
            for scheme in ("kabat", "martin", "aho", "imgt"):
                other = from_imgt(num, chain, scheme)
                assert len(other) == len(num) and len(set(other) - {"-"}) == len(num) - 2
                keys = [(int(re.match(r"\d+", c)[0]), c[len(re.match(r"\d+", c)[0]) :]) for c in other if c != "-"]
                assert scheme == "imgt" or keys == sorted(keys)
                assert to_imgt(other, chain, scheme) == num
    heavy = ["23", "41", "104", "118"]
    assert from_imgt(heavy, "H", "kabat") == ["22", "36", "92", "103"] and from_imgt(heavy, "H", "aho") == ["23", "43", "106", "139"]
    assert from_imgt(["23", "41", "104", "118"], "L", "kabat") == ["23", "35", "88", "98"]
    g = _germlines(spark)
    v = {r["gene_name"]: r["aligned_seq"].replace("-", "") for r in g.collect()}
    seqs = spark.createDataFrame([(i, v[f"IGH V{k}-1*01".replace(" ", "")] + "ARDYW" + v[f"IGHJ{k}*01"]) for i, k in enumerate((1, 2, 3))], "i int, s string")
    found = []
    for scheme in ("imgt", "kabat", "martin", "aho"):
        a = ann.annotate(seqs, F.col("s"), ann.chain_profiles(g), ["H"], scheme=scheme).select("i", "s", F.col("annotation.numbering").alias("n"), F.col("annotation.chain").alias("c"))
        back = ga.imgt_numbering(a, "n", "c", scheme)
        got = ga.assign_genes(back.withColumn("a", ga.to_imgt_columns(F.col("s"), F.col("n"))), F.col("a"), F.col("c"), F.lit("unknown"), g)
        found.append({r["i"]: (r["v_gene"], r["j_gene"], r["v_identity"]) for r in got.collect()})
    assert all(f == found[0] for f in found) and found[0][1][:2] == ("IGHV2-1*01", "IGHJ2*01")
    with pytest.raises(ValueError):
        ann.annotate(seqs, F.col("s"), ann.chain_profiles(g), ["H"], scheme="chothia")


def test_panel_shows_the_identity_of_the_annotation(spark, sf):
    profiles = ann.chain_profiles(sequences.germlines(spark, sf))
    rows = {r["seq_id"]: r for r in sequences.table(spark, sf, "full_chains").collect()}
    panel = sequences.v11_annotated_panel(spark, sf).limit(40).collect()
    assert panel
    for r in panel:
        for side, chains in (("heavy", ["H"]), ("light", ["K", "L"])):
            s = rows[r["seq_id"]][f"{side}_chain"]
            clean = s is not None and re.fullmatch("[A-Z]+", s)
            want = ann.annotate_batch([s], profiles, chains)[0] if clean else None
            if want is None or want["chain"] is None:
                assert r[f"{side}_identity"] == 0 and set(r[f"{side}_aligned"]) == {"-"}
            else:
                assert abs(r[f"{side}_identity"] - want["percent_identity"]) < 1e-6


def test_csv_rows_skip_all_lines_and_hold_line_breaks(spark, tmp_path):
    a, b = tmp_path / "z" / "x.csv", tmp_path / "a" / "x.csv"
    for f in (a, b):
        f.parent.mkdir()
    a.write_text('\nhead\n1,"a, ""b""",c,more\n\n2,short\n')
    b.write_text('h,h\n3,"two\nlines",x\n')
    rows = files.read_csv_rows(spark, [str(a)], 3, 2).orderBy("place").drop("place").collect()
    assert [tuple(r) for r in rows] == [("1", 'a, "b"', "c"), ("2", "short", None)]
    rows = files.read_csv_rows(spark, [str(b)], 3, 1, multiline=True).drop("place").collect()
    assert [tuple(r) for r in rows] == [("3", "two\nlines", "x")]
    got = files.with_ids(files.read_csv_rows(spark, [str(tmp_path / "z"), str(b)], 1)).orderBy("seq_id").collect()
    assert [r["c0"] for r in got][:2] == ["head", "1"] and [r["c0"] for r in got][-2] == "3"  # the first folder first, though its name is the last
    assert files.count_records(spark.range(3)) == 3 and files.count_records(spark.range(0)) == 0
    with pytest.raises(ValueError):
        files.count_records(spark.range(5), 4)


def test_registered_functions(spark, tmp_path, sf):
    from chainforge.operators.annotate import chain_profiles
    from chainforge.plans.models import rule_model
    from chainforge.register import register

    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    profiles = chain_profiles(spark.read.parquet(f"{sf}/germlines.parquet"))
    names = register(spark, profiles, rule_model(4))
    assert {"annotate_chain", "mixture_score", "align_cdr"} <= set(names)
    row = spark.sql("SELECT align_cdr('ACDEF', 7) AS a, align_cdr('ACDEF', 4) AS long, differences('ACD', 'AGD') AS d, differences('A', 'AA') AS u, is_chain_sequence(NULL) AS v, mixture_score('AC-D') AS s, mixture_score('AC') AS w, annotate_chain('J').error AS e").first()
    assert (row["a"], row["long"], row["d"], row["u"], row["v"], row["w"]) == ("ACD--EF", None, 1, None, False, None) and row["s"] < 0 and row["e"].startswith("Sequence contains invalid")
    fasta = tmp_path / "x.fa"
    fasta.write_text(">a b\nAC\n\nDE\n>c\nF\n")
    assert [tuple(r) for r in spark.read.format("fasta").load(str(fasta)).collect()] == [("a b", "ACDE"), ("c", "F")]
