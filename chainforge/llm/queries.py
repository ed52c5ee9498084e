"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainforge.llm.canonical_names import map_names
from chainforge.llm.hidden_duplicates import collapsed, fields, hidden_duplicates, keyed, letters
from chainforge.llm.link_groups import link_groups
from chainforge.llm.similarity_clusters import cluster_profiles, similarity_clusters
from chainforge.llm.term_frequency import term_frequencies
from chainforge.runtime import table

GENES = ("heavy_vgene", "light_vgene", "heavy_jgene")


def written(c: str):
    """Neither null, empty nor white space only."""
    return F.col(c).rlike(r"(?U)\S")


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "full_chains")
    return term_frequencies(t, F.col("seq_id"), {c: F.col(c) for c in GENES})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_terms(spark, sf).where("mark <> 'useful'").select("field", "term", "mark")


def _canonical(spark: SparkSession, sf: str) -> DataFrame:
    fasta, chains = table(spark, sf, "fasta_records"), table(spark, sf, "full_chains")
    return keyed(fasta, "fasta_records", F.col("rec_id"), [letters(F.col("sequence")), fields(F.col("seqinfo"))]).unionAll(
        keyed(chains.where(written("heavy_chain")), "full_chains", F.col("seq_id"), [letters(F.col("heavy_chain")), letters(F.col("light_chain"))])
    )


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hidden_duplicates(_canonical(spark, sf))


def p3_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapsed(_canonical(spark, sf))


def _alike(op, spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "full_chains").where(written("heavy_chain") & written("heavy_vgene") & written("heavy_jgene"))
    return op(t, F.col("seq_id"), letters(F.col("heavy_chain")), [F.col("heavy_vgene"), F.col("heavy_jgene")])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _alike(similarity_clusters, spark, sf)


def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _alike(cluster_profiles, spark, sf)


def p4_first_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each cluster the rows in all parts and the part around its record of the highest degree, which is the first to be split off."""
    parts = p4_clusters(spark, sf)
    first = F.min(F.struct((-F.col("n_records")).alias("n"), "medoid_id"))  # parts shrink, and of equal ones the least medoid came first
    got = parts.groupBy("cluster_id").agg(F.sum("n_rows").alias("n_rows"), first.alias("f"), (F.max("radius") <= 0.1 + 1e-9).alias("tight"))
    return got.select("cluster_id", "n_rows", F.col("f.medoid_id").alias("medoid_id"), (-F.col("f.n")).alias("n_records"), "tight")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return link_groups(table(spark, sf, "chain_matches"), "id_a", "id_b")


def p6_names(spark: SparkSession, sf: str) -> DataFrame:
    t, genes = table(spark, sf, "cdr_rows"), table(spark, sf, "germlines")
    mine = {"heavy_vgene": F.expr("chain = 'H' AND segment = 'V'"), "light_jgene": F.expr("chain IN ('K', 'L') AND segment = 'J'")}
    lists = {c: (F.col(c), genes.where(own)) for c, own in mine.items()}
    return map_names(t, F.col("cdr_id"), lists, {c: genes.where(~own) for c, own in mine.items()}).withColumnRenamed("row_id", "cdr_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_names(spark, sf).select("cdr_id", "field", "gene_id")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p3_found": p3_found, "p3_collapsed": p3_collapsed, "p4_found": p4_found, "p4_clusters": p4_clusters, "p4_first_parts": p4_first_parts, "p5_found": p5_found, "p6_found": p6_found, "p6_names": p6_names}

_TERMS = """
WITH v AS (SELECT seq_id, 'heavy_vgene' AS field, heavy_vgene AS v FROM full_chains UNION ALL SELECT seq_id, 'light_vgene', light_vgene FROM full_chains UNION ALL SELECT seq_id, 'heavy_jgene', heavy_jgene FROM full_chains),
t AS (SELECT seq_id, field, unnest(string_split(v, '_')) AS term FROM v WHERE v <> ''),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT seq_id) AS records FROM t WHERE term <> '' GROUP BY ALL),
m AS (SELECT *, CASE WHEN records <= 3 THEN 'rare' WHEN records > 0.04 * (SELECT count(*) FROM full_chains) THEN 'common' ELSE 'useful' END AS mark FROM c)
"""
_SETS = """
WITH k AS (SELECT 'fasta_records' AS table_name, rec_id AS id, upper(regexp_replace(coalesce(sequence, ''), '[^A-Za-z]', '', 'g')) AS x,
    list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(coalesce(seqinfo, '')), '[^a-z0-9]+', ' ', 'g'), '[a-z0-9]+ ?[a-z0-9]*')))::varchar AS y FROM fasta_records
UNION ALL SELECT 'full_chains', seq_id, upper(regexp_replace(heavy_chain, '[^A-Za-z]', '', 'g')), upper(regexp_replace(coalesce(light_chain, ''), '[^A-Za-z]', '', 'g'))
    FROM full_chains WHERE regexp_matches(heavy_chain, '\\S')),
s AS (SELECT *, min(id) OVER (PARTITION BY table_name, x, y) AS kept_id FROM k)
"""
SQL = {
    "p1_terms": _TERMS + "SELECT * FROM m",
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark <> 'useful'",
    "p3_found": _SETS + "SELECT table_name, kept_id, id AS copy_id FROM s WHERE id <> kept_id",
    "p3_collapsed": _SETS + "SELECT table_name, kept_id, count(*) AS n_copies FROM s GROUP BY ALL",
    "p4_found": """
WITH RECURSIVE c AS (SELECT seq_id, heavy_vgene AS v, heavy_jgene AS j, upper(regexp_replace(heavy_chain, '[^A-Za-z]', '', 'g')) AS x FROM full_chains
    WHERE regexp_matches(heavy_chain, '\\S') AND regexp_matches(heavy_vgene, '\\S') AND regexp_matches(heavy_jgene, '\\S')),
e AS (SELECT p.seq_id AS a, q.seq_id AS b FROM c p JOIN c q ON p.v = q.v AND p.j = q.j AND length(p.x) = length(q.x) AND p.seq_id <> q.seq_id WHERE 10 * hamming(p.x, q.x) <= length(p.x)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT least(a, min(b)) AS cluster_id, a AS seq_id FROM r GROUP BY a""",
    "p4_first_parts": """
WITH RECURSIVE c AS (SELECT min(seq_id) AS id, count(*) AS n, heavy_vgene AS v, heavy_jgene AS j, upper(regexp_replace(heavy_chain, '[^A-Za-z]', '', 'g')) AS x FROM full_chains
    WHERE regexp_matches(heavy_chain, '\\S') AND regexp_matches(heavy_vgene, '\\S') AND regexp_matches(heavy_jgene, '\\S') GROUP BY v, j, x),
e AS (SELECT p.id AS a, q.id AS b FROM c p JOIN c q ON p.v = q.v AND p.j = q.j AND length(p.x) = length(q.x) WHERE 10 * hamming(p.x, q.x) <= length(p.x)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY a),
d AS (SELECT a AS id, count(*) AS degree FROM e GROUP BY a),
t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY degree DESC, id) AS place, sum(n) OVER (PARTITION BY cluster_id) AS n_rows FROM k JOIN c USING (id) JOIN d USING (id))
SELECT cluster_id, n_rows::bigint AS n_rows, id AS medoid_id, degree AS n_records, TRUE AS tight FROM t WHERE place = 1 AND n_rows > 1""",
    "p5_found": """
WITH RECURSIVE e AS (SELECT DISTINCT id_a AS a, id_b AS b FROM chain_matches WHERE id_a <> id_b UNION SELECT id_b, id_a FROM chain_matches WHERE id_a <> id_b),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT least(a, min(b)) AS group_id, a AS seq_id FROM r GROUP BY a""",
}
