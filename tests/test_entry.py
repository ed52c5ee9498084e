"""The driver's contract, and every query with SQL against it on the smallest tables."""

import math
import os
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_llm_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "chainforge")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                assert "chainforge.llm" not in open(os.path.join(folder, name)).read()


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    assert __spark_entry__.entry(spark).count() > 0


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df = __spark_entry__.queries()[name](spark, sf)
    got = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(columns) and got == want
