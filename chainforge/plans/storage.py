"""Queries of sources, sinks and database builds.

Files are written to the shared folder and read back, so that the readers and writers run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainforge.operators.annotate import chain_profiles
from chainforge.operators.search import SearchSettings, search
from chainforge.plans.sequences import germlines
from chainforge.plans.typed import typed
from chainforge.runtime import folder, spread, store, table
from chainforge.sources import database as db
from chainforge.sources import files


def s1_fasta_roundtrip(spark, sf):
    t = table(spark, sf, "fasta_records")
    path = folder(spark)
    files.write_fasta(t, F.col("seqinfo"), F.col("sequence"), path)
    return files.read_fasta(spark, [path]).where("error IS NULL").groupBy("seqinfo", "sequence").agg(F.count("*").alias("n"))


def s2_csv_roundtrip(spark, sf):
    t = table(spark, sf, "cdr_rows")
    path = folder(spark)
    t.select("cdr_id", "entry_key", "heavy_cdr3", "lab").write.option("header", True).csv(path)
    rows = files.read_csv_rows(spark, [path], 4, skip_rows=1)
    return rows.select(F.col("c0").cast("long").alias("cdr_id"), F.col("c1").alias("entry_key"), F.col("c2").alias("heavy_cdr3"), F.col("c3").alias("lab"))


def _columns(spark) -> dict[str, str]:
    return {c: c for c in ("seq_id", "heavy_chain", "light_chain", "heavy_numbering", "light_numbering", "heavy_vgene", "light_vgene", "heavy_jgene", "light_jgene", "species", "metadata")}


def s6_full_chain_build(spark, sf):
    _, chains, _ = db.from_full_chains(spread(table(spark, sf, "full_chains").select(*_columns(spark))), _columns(spark), chain_profiles(germlines(spark, sf)))
    return chains


def s7_cdr_build(spark, sf):
    columns = {c: c for c in ("heavy_cdr3", "heavy_cdr2", "heavy_cdr1", "light_cdr3", "light_cdr2", "light_cdr1", "heavy_vgene", "light_vgene", "heavy_jgene", "light_jgene", "species")} | {"seq_id": "cdr_id"}
    _, chains, _ = db.from_cdrs(table(spark, sf, "cdr_rows"), columns)
    return chains.select("seq_id", "chain_group", "cdr1", "cdr2", "cdr3", "len1", "len2", "len3", "species", "n_noncanonical")


def s9_rejects(spark, sf):
    columns = {c: c for c in ("heavy_cdr3", "heavy_cdr2", "heavy_cdr1", "light_cdr3", "light_cdr2", "light_cdr1", "heavy_vgene", "light_vgene", "heavy_jgene", "light_jgene", "species")} | {"seq_id": "cdr_id"}
    return db.from_cdrs(table(spark, sf, "cdr_rows"), columns)[2]


def s5_database_roundtrip(spark, sf) -> DataFrame:
    """Build from sequences, write, open, and search it with every 100th row."""
    t = table(spark, sf, "fasta_records")
    t = spread(t.select(F.col("rec_id").alias("seq_id"), F.col("seqinfo").alias("metadata"), F.upper(F.regexp_replace("sequence", "[^A-Za-z]", "")).alias("seq")))
    info = db.Info(memo="fasta_records")
    parts = db.from_sequences(t, "seq", germlines(spark, sf), chain_profiles(germlines(spark, sf)), info)
    path = folder(spark)
    db.write_database(path, *parts, info)
    rows = store(db.Database(spark, path).searchable())
    return search(rows.where("seq_id % 100 = 0"), rows, SearchSettings("123", 0.2), ("v", "species"))


QUERIES = {f.__name__: f for f in (s1_fasta_roundtrip, s2_csv_roundtrip, s5_database_roundtrip, s6_full_chain_build, s7_cdr_build, s9_rejects)}

_WIDTHS = {1: 17, 2: 20, 3: 36}


def _fixed(c: str, w: int) -> str:
    return f"substr({c}, 1, (length({c}) + 1) // 2) || repeat('-', {w} - length({c})) || substr({c}, (length({c}) + 1) // 2 + 1)"


def _sides() -> str:
    one = "SELECT cdr_id AS seq_id, '{s}' AS side, upper(substr(coalesce(trim({s}_vgene), ''), 3, 1)) AS letter, '{d}' AS fallback, coalesce(trim({s}_cdr1), '') AS c1, coalesce(trim({s}_cdr2), '') AS c2, coalesce(trim({s}_cdr3), '') AS c3, coalesce(trim({s}_vgene), '') AS v, CASE WHEN coalesce(trim(species), '') = '' THEN 'human' ELSE species END AS species FROM cdr_rows"
    code = "CASE WHEN c3 = '' OR v = '' THEN 'missing' WHEN NOT regexp_full_match(c1 || c2 || c3, '[ACDEFGHIKLMNPQRSTVWYX]+') THEN 'invalid' WHEN length(c1) > 17 OR length(c2) > 20 OR length(c3) > 36 THEN 'length' END"
    chain = "CASE WHEN strpos('HKLABDG', letter) > 0 AND letter <> '' THEN letter ELSE fallback END"
    return f"WITH s AS ({one.format(s='heavy', d='H')} UNION ALL {one.format(s='light', d='K')}), j AS (SELECT *, {code} AS code, {chain} AS chain FROM s WHERE c1 || c2 || c3 <> '') "


SQL = {
    "s1_fasta_roundtrip": "SELECT trim(regexp_replace(regexp_replace(seqinfo, '[\\r\\n]+', ' ', 'g'), '\\t', ' ', 'g')) AS seqinfo, regexp_replace(sequence, '\\s', '', 'g') AS sequence, count(*) AS n FROM fasta_records WHERE length(seqinfo) > 0 AND length(sequence) > 0 GROUP BY 1, 2",
    "s2_csv_roundtrip": "SELECT cdr_id, entry_key, nullif(heavy_cdr3, '') AS heavy_cdr3, nullif(lab, '') AS lab FROM cdr_rows",
    "s7_cdr_build": _sides() + "SELECT seq_id, CASE chain WHEN 'H' THEN 'H' WHEN 'K' THEN 'KL' WHEN 'L' THEN 'KL' WHEN 'B' THEN 'BD' WHEN 'D' THEN 'BD' ELSE 'AG' END AS chain_group, "
    + ", ".join(f"{_fixed(f'c{k}', w)} AS cdr{k}" for k, w in _WIDTHS.items())
    + ", length(c1) AS len1, length(c2) AS len2, length(c3) AS len3, species, 0 AS n_noncanonical FROM j WHERE code IS NULL",
    "s9_rejects": _sides() + "SELECT seq_id, side, code FROM j WHERE code IS NOT NULL",
}

#: Columns whose type in SQL isn't that of the query.
_TYPES = {"s7_cdr_build": {"len1": "INTEGER", "len2": "INTEGER", "len3": "INTEGER"}}
SQL |= {name: typed(SQL[name], types) for name, types in _TYPES.items()}
