"""Queries of the general corpus operators (problems 2 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainforge.operators.parse_records import parse_records
from chainforge.operators.runs import run_states
from chainforge.runtime import table

#: A pair is heavy above this share of all rows.
HEAVY = 0.04


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_records")
    return parse_records(raw, raw["raw_id"], raw["line"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where(F.col("reason").isNotNull()).select("raw_id", "reason")


def p2_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where(F.col("reason").isNull()).drop("reason")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "full_chains")
    sums = {"n_chains": F.col("heavy_chain").isNotNull().cast("long"), "letters": F.length("heavy_chain")}
    return run_states(t, {"heavy_vgene": F.col("heavy_vgene"), "species": F.col("species")}, F.col("seq_id"), sums)


def p7_key_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select(
        "heavy_vgene", "species", "n_rows", "n_chains",
        F.when(F.col("n_chains") > 0, F.round(F.col("letters") / F.col("n_chains"), 6)).alias("mean_length"),
        F.col("first_order").alias("first_seq_id"), F.col("last_order").alias("last_seq_id"), F.col("max_gap").alias("max_gap"),
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    total = table(spark, sf, "full_chains").count()  # from the files' footers
    written = lambda c: F.col(c).rlike(r"(?U)\S")
    return _pairs(spark, sf).where(written("heavy_vgene") & written("species") & (F.col("n_rows") > F.lit(HEAVY) * F.lit(total))).select("heavy_vgene", "species")


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p7_found": p7_found, "p7_key_stats": p7_key_stats}

_FIELD = '("([^"]|"")*"|[^",]*)'
_RAW = f"""
WITH kept AS (SELECT raw_id, line FROM raw_records WHERE line IS NOT NULL AND regexp_matches(line, '[^\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]')),
shaped AS (SELECT raw_id, line, regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS quoted_well FROM kept),
-- a mark that no line holds, put in front of each field of a well-quoted line
fields AS (SELECT raw_id, quoted_well, CASE WHEN quoted_well THEN
    list_transform(regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1, 's'),
        lambda f: CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) END AS f FROM shaped),
judged AS (SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> 5 THEN 'columns'
    WHEN NOT regexp_matches(f[1], '\\S') OR NOT regexp_full_match(f[2], '[ACDEFGHIKLMNPQRSTVWYX]+') THEN 'value' END AS reason FROM fields)
"""
SQL = {
    "p2_found": _RAW + "SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": _RAW + "SELECT raw_id, f[1] AS seqinfo, f[2] AS sequence, f[3] AS vgene, f[4] AS jgene, f[5] AS species FROM judged WHERE reason IS NULL",
    "p7_found": f"SELECT heavy_vgene, species FROM full_chains WHERE trim(heavy_vgene) <> '' AND trim(species) <> '' GROUP BY ALL HAVING count(*) > {HEAVY} * (SELECT count(*) FROM full_chains)",
    "p7_key_stats": """
WITH g AS (SELECT heavy_vgene, species, seq_id, heavy_chain, seq_id - lag(seq_id) OVER (PARTITION BY heavy_vgene, species ORDER BY seq_id) AS gap FROM full_chains)
SELECT heavy_vgene, species, count(*) AS n_rows, count(heavy_chain) AS n_chains, round(sum(length(heavy_chain)) / count(heavy_chain)::double, 6) AS mean_length,
    min(seq_id) AS first_seq_id, max(seq_id) AS last_seq_id, coalesce(max(gap), 0) AS max_gap FROM g GROUP BY ALL""",
}
