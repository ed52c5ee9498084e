"""Record parsing and range-balanced key statistics, against plain Python."""

import csv
import io
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainforge.operators.components import clean_edges, min_label_components
from chainforge.operators.parse_records import _split, diagnose, parse_records, strict_fields
from chainforge.operators.runs import run_states


def by_rule(line):
    """The grammar again, letter by letter."""
    fields, cur, state = [], "", "start"
    for i, ch in enumerate(line):
        if state == "start":
            if ch == '"':
                state = "quoted"
            elif ch == ",":
                fields.append("")
            else:
                cur, state = ch, "plain"
        elif state == "plain":
            if ch == ",":
                fields.append(cur)
                cur, state = "", "start"
            elif ch == '"':
                return None
            else:
                cur += ch
        elif state == "quoted":
            if ch == '"':
                state = "quote"
            else:
                cur += ch
        else:
            if ch == '"':
                cur, state = cur + '"', "quoted"
            elif ch == ",":
                fields.append(cur)
                cur, state = "", "start"
            else:
                return None
    if state == "quoted":
        return None
    return [*fields, cur]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab",\n\r ', max_size=14))
def test_strict_fields_follow_the_grammar(line):
    if line:
        assert strict_fields(line) == by_rule(line)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='AC",\n\r x', max_size=6), min_size=5, max_size=5))
def test_written_records_read_back(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert strict_fields(out.getvalue()) == fields


def test_parse_parts_good_from_bad_in_any_mix(spark):
    random.seed(1)
    good = ['s {i},ACDX,v,j,human', '"s, {i}","AC",v,"a ""b"" c","x\ny"', "s{i},W,,,"]
    bad = {'s{i},AC"D,v,j,h': "quoting", '"s{i},ACD,v,j,h': "quoting", '"s{i}"x,A,v,j,h': "quoting", "s{i},ACD,v,j": "columns", "s{i},A,v,j,h,z": "columns", " ,ACD,v,j,h": "value", "s{i},,v,j,h": "value", "s{i},acd,v,j,h": "value", 's{i},"ACD\r",v,j,h': "value", '"s{i}" ,B,v': "quoting"}
    lines = [(i, (random.choice(good) if random.random() < 0.6 else random.choice([*bad, "", " \t"])).replace("{i}", str(i))) for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(lines, "raw_id long, line string").withColumn("reason", F.lit("clash")).repartition(3)
    got = {r["raw_id"]: r for r in parse_records(df, df["raw_id"], df["line"]).collect()}
    for i, line in lines:
        if line is None or not line.strip():
            assert i not in got
            continue
        fields, reason = diagnose(line)
        assert got[i]["reason"] == reason
        assert [got[i][c] for c in ("seqinfo", "sequence", "vgene", "jgene", "species")] == (fields or [None] * 5)


def test_only_suspect_lines_reach_the_strict_scanner():
    random.seed(2)
    lines = [random.choice(['s {i},ACDX,v,j,human', '"s, {i}","AC",v,"a ""b"" c","x\ny"', "s{i},W,,,"]) for _ in range(5000)]
    bad = random.sample(range(5000), 500)
    for i in bad:
        lines[i] = random.choice(['s{i},AC"D,v,j,h', "s{i},ACD,v,j", " ,ACD,v,j,h", "s{i},acd,v,j,h", "a\nb,A,v,j,h", '"a",A,v\nw,j,h'])
    good, alone = _split(pa.array(lines), 5)
    scanned = sorted(set(bad) | {i for i, x in enumerate(lines) if diagnose(x)[1]})
    assert alone.tolist() == scanned
    assert sorted(i for at, _ in good for i in at.tolist()) == sorted(set(range(5000)) - set(scanned))
    assert all(diagnose(lines[i])[0] == [c[k].as_py() for c in t.columns] for at, t in good for k, i in enumerate(at.tolist()[:50]))
    assert _split(pa.array([], pa.string()), 5)[1].tolist() == []


def test_parse_of_nothing_and_of_very_long_lines(spark):
    none = spark.createDataFrame([], "raw_id long, line string")
    assert parse_records(none, none["raw_id"], none["line"]).count() == 0
    long = spark.createDataFrame([(1, "s," + "A" * 2_000_000 + ",v,j,h"), (None, "s,A,v,j,h"), (1, "s,A,v,j,h")], "raw_id long, line string")
    rows = parse_records(long, long["raw_id"], long["line"]).collect()
    assert sorted(len(r["sequence"]) for r in rows) == [1, 1, 2_000_000] and {r["reason"] for r in rows} == {None}


def test_runs_equal_a_plain_group_by(spark):
    random.seed(2)
    rows = [(random.choice(["a", "a", "a", "b", "", None]), random.choice(["x", None]), random.choice([None, *range(40)]), random.choice([None, 1, 5])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "v string, s string, i long, m long").withColumn("n_rows", F.lit(1)).repartition(5)
    want = {}
    for v, s, i, m in rows:
        e = want.setdefault((v, s), [0, set(), 0])
        e[0] += 1
        e[1] |= {i} - {None}
        e[2] += m or 0
    for parts in (1, 3, 7):
        got = run_states(df, {"v": F.col("v"), "s": F.col("s")}, F.col("i"), {"m": F.col("m")}, partitions=parts).collect()
        assert len(got) == len(want)
        for r in got:
            n, ids, m = want[r["v"], r["s"]]
            ids = sorted(ids)
            gap = max((b - a for a, b in zip(ids, ids[1:])), default=0)
            assert (r["n_rows"], r["n_distinct"], r["m"], r["first_order"], r["last_order"], r["max_gap"]) == (n, len(ids), m, ids[0], ids[-1], gap)
    assert run_states(df.limit(0), {"v": F.col("v")}, F.col("i")).count() == 0


def test_components_equal_union_find(spark):
    random.seed(3)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "x long, y long")
    got = {r["node"]: r["component"] for r in min_label_components(clean_edges(df, "x", "y")).collect()}
    assert got == {x: find(x) for x in parent}
    assert min_label_components(clean_edges(df.limit(0), "x", "y")).count() == 0
