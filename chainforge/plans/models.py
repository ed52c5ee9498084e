"""Queries of masks, mixture models and chain scores, with their SQL.

The model is made from a small rule, so that SQL can make the same one; fitting is tested apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainforge.functions import alphabet, positions
from chainforge.operators.mixture import CategoricalMixture, masked
from chainforge.operators.scoring import SequenceScorer
from chainforge.plans.sequences import NUM, TEMPLATE, _aligned, _list, numbered
from chainforge.plans.typed import typed
from chainforge.runtime import spread, store, table

K, WIDTH = 3, 20


def rule_model(length: int) -> CategoricalMixture:
    """mu from 1 + (7 (k + 1) + 3 (pos + 1) + 5 (aa + 1)) mod 11 over its sum, weights (k + 1) / 6."""
    k, p, a = np.ogrid[0:K, 0:length, 0:21]
    mu = 1.0 + (7 * (k + 1) + 3 * (p + 1) + 5 * (a + 1)) % 11
    return CategoricalMixture(K, length).load(mu / mu.sum(2, keepdims=True), (np.arange(K) + 1) / 6)


def aligned_cdrs(spark, sf) -> DataFrame:
    """cdr_id, aligned: heavy CDR3s in a fixed width."""
    t = table(spark, sf, "cdr_rows").where(F.col("heavy_cdr3").rlike(r"^[ACDEFGHIKLMNPQRSTVWY]+\z")).where(F.length("heavy_cdr3") <= WIDTH)
    return t.select("cdr_id", positions.align_cdr(F.col("heavy_cdr3"), WIDTH).alias("aligned"))


def _codes():
    return alphabet.encode(F.col("aligned"), WIDTH)


def m1_user_mask(spark, sf):
    keep = F.array(*(F.lit(i % 3 != 0) for i in range(WIDTH)))
    return aligned_cdrs(spark, sf).select("cdr_id", F.array_join(masked(_codes(), keep), ",", "x").alias("codes"))


def m2_terminal_mask(spark, sf):
    t = numbered(spark, sf).where(F.col("seq").rlike(r"^[ACDEFGHIKLMNPQRSTVWY]+\z")).withColumn("aligned", TEMPLATE.align(F.col("seq"), F.col("num")))
    cut = TEMPLATE.slice(F.col("aligned"), "cdr1")
    return t.select("seq_id", F.array_join(masked(alphabet.encode(cut), None, True), ",", "x").alias("codes"))


def m3_gap_mask(spark, sf):
    return aligned_cdrs(spark, sf).select("cdr_id", F.array_join(masked(_codes(), None, False, True), ",", "x").alias("codes"))


def m4_score(spark, sf):
    m = rule_model(WIDTH)
    one = m.score(aligned_cdrs(spark, sf), _codes())
    two = m.score(one, masked(_codes(), None, False, True), True, "normalised")
    return two.select("cdr_id", F.round("score", 6).alias("score"), F.round("normalised", 6).alias("normalised"))


def m5_predict(spark, sf):
    m = rule_model(WIDTH)
    return m.predict(m.predict(aligned_cdrs(spark, sf), _codes()), _codes(), False, "unweighted").select("cdr_id", "cluster", "unweighted")


def m6_log_joint(spark, sf):
    got = rule_model(WIDTH).log_joint(aligned_cdrs(spark, sf), _codes())
    return got.select("cdr_id", F.posexplode("log_joint").alias("k", "v")).select("cdr_id", "k", F.round("v", 6).alias("log_joint"))


def m7_em_one_step(spark, sf):
    m = rule_model(WIDTH)
    bound, resp, counts = m.em_step(aligned_cdrs(spark, sf).select(_codes().alias("codes")))
    rows = [(k, p, "ACDEFGHIKLMNPQRSTVWY-"[a], float(counts[k, p, a]), float(resp[k]), bound) for k in range(K) for p in range(WIDTH) for a in range(21)]
    df = spark.createDataFrame(rows, "k int, pos int, aa string, expected double, resp double, bound double")
    return df.select("k", "pos", "aa", F.round("expected", 4).alias("expected"), F.round("resp", 4).alias("resp"), F.round("bound", 3).alias("bound"))


def m7_em_fit(spark, sf):
    m = CategoricalMixture(4, WIDTH)
    t = aligned_cdrs(spark, sf)
    m.fit(t, _codes())
    return m.predict(t, _codes()).groupBy("cluster").agg(F.count("*").alias("n"))


def m10_bic_aic(spark, sf):
    got = rule_model(WIDTH).information(aligned_cdrs(spark, sf), _codes())
    return spark.createDataFrame([(round(got["bic"], 2), round(got["aic"], 2))], "bic double, aic double")


def m14_profiles(spark, sf):
    return rule_model(WIDTH).profiles(aligned_cdrs(spark, sf), "aligned")


def _scorer(normalization: str = "none") -> SequenceScorer:
    return SequenceScorer({"H": rule_model(len(TEMPLATE.codes))}, {"H": TEMPLATE}, normalization)


def _prepared(spark, sf) -> DataFrame:
    t = numbered(spark, sf).select("seq_id", "seq", "num")
    return _scorer().prepare(t, F.col("seq"), F.col("num"), F.lit("H"))


def h2_prepared_sequences(spark, sf):
    return _prepared(spark, sf).select("seq_id", "aligned", "chain_type")


def h5_diagnostics(spark, sf):
    got = _scorer().diagnostics(numbered(spark, sf).select("seq_id", "num"), F.col("num"), F.lit("H"))
    return got.select("seq_id", F.array_join("gapped", "_").alias("gapped"), F.array_join("unusual", "_").alias("unusual"), "chain_type")


def h6_score_by_chain(spark, sf):
    plain = _scorer("training_set_adjust").score(_prepared(spark, sf)).select("seq_id", F.round("value", 6).alias("adjusted"))
    mean = _scorer("normalize").score(_prepared(spark, sf), mask_all_gaps=True).select("seq_id", F.round("value", 6).alias("normalised"))
    return plain.join(mean, "seq_id")


def h7_topn_clusters(spark, sf):
    got = _scorer().closest_clusters(_prepared(spark, sf), "seq_id", 2)
    return got.select("seq_id", "rank", "cluster", F.round("log_joint", 6).alias("log_joint"))


def h10_per_residue(spark, sf):
    got = _scorer().residue_probabilities(_prepared(spark, sf), "seq_id", (F.col("seq_id") % K).cast("int"))
    return got.withColumn("log_p", F.round("log_p", 6))


def h11_humanize(spark, sf):
    got = _scorer().humanize(_prepared(spark, sf), "seq", "num")
    return got.select("seq_id", F.round("new_score", 6).alias("new_score"), F.array_join("mutations", ",").alias("mutations"), "new_seq")



# the same over both chains of a row; seq_id and side name a chain

LIGHT = positions.Template(positions.canonical_numbering("imgt", "L"), "L", "imgt")


def _both_scorer(normalization: str = "none") -> SequenceScorer:
    return SequenceScorer({"H": rule_model(len(TEMPLATE.codes)), "L": rule_model(len(LIGHT.codes))}, {"H": TEMPLATE, "L": LIGHT}, normalization)


def both_chains(spark, sf) -> DataFrame:
    """chain_id (seq_id_side), seq_id, side, seq, num, chain: heavy chains as H, light ones as K if their V gene says so, else as L."""
    t = table(spark, sf, "full_chains")

    def side(name: str, chain) -> DataFrame:
        got = t.where(F.col(f"{name}_numbering").isNotNull() & F.col(f"{name}_chain").rlike(r"^[A-Z]+\z"))
        got = got.select(F.concat_ws("_", "seq_id", F.lit(name)).alias("chain_id"), "seq_id", F.lit(name).alias("side"), F.col(f"{name}_chain").alias("seq"), F.split(f"{name}_numbering", "_").alias("num"), chain.alias("chain"))
        return got.where("size(num) = length(seq)")

    kappa = F.coalesce(F.upper("light_vgene").startswith("IGK"), F.lit(False))
    return spread(side("heavy", F.lit("H")).unionAll(side("light", F.when(kappa, "K").otherwise("L"))))


def _both_prepared(spark, sf) -> DataFrame:
    return _both_scorer().prepare(both_chains(spark, sf), F.col("seq"), F.col("num"), F.col("chain"))


def h2_both_prepared(spark, sf):
    return _both_prepared(spark, sf).select("chain_id", "aligned", "chain_type")


def h5_both_diagnostics(spark, sf):
    got = _both_scorer().diagnostics(both_chains(spark, sf), F.col("num"), F.col("chain"))
    return got.select("chain_id", F.array_join("gapped", "_").alias("gapped"), F.array_join("unusual", "_").alias("unusual"), "chain_type")


def h6_both_scores(spark, sf):
    rows = store(_both_prepared(spark, sf).select("chain_id", "aligned", "chain_type"))  # each model and score reads it
    plain = _both_scorer("training_set_adjust").score(rows).select("chain_id", F.round("value", 6).alias("adjusted"))
    mean = _both_scorer("normalize").score(rows, mask_all_gaps=True).select("chain_id", F.round("value", 6).alias("normalised"))
    return plain.join(mean, "chain_id")


def h7_both_topn(spark, sf):
    got = _both_scorer().closest_clusters(_both_prepared(spark, sf), "chain_id", 2)
    return got.select("chain_id", "rank", "cluster", F.round("log_joint", 6).alias("log_joint"))


def h10_both_per_residue(spark, sf):
    got = _both_scorer().residue_probabilities(_both_prepared(spark, sf), "chain_id", (F.split_part("chain_id", F.lit("_"), F.lit(1)).cast("long") % K).cast("int"))
    return got.withColumn("log_p", F.round("log_p", 6))


def h11_both_humanize(spark, sf):
    got = _both_scorer().humanize(_both_prepared(spark, sf), "seq", "num")
    return got.select("chain_id", F.round("new_score", 6).alias("new_score"), F.array_join("mutations", ",").alias("mutations"), "new_seq")


QUERIES = {
    f.__name__: f
    for f in (
        m1_user_mask, m2_terminal_mask, m3_gap_mask, m4_score, m5_predict, m6_log_joint, m7_em_one_step, m7_em_fit, m10_bic_aic, m14_profiles, h2_prepared_sequences, h5_diagnostics, h6_score_by_chain, h7_topn_clusters, h10_per_residue, h11_humanize,
        h2_both_prepared, h5_both_diagnostics, h6_both_scores, h7_both_topn, h10_both_per_residue, h11_both_humanize,
    )
}

# SQL

_AA = "ACDEFGHIKLMNPQRSTVWY-"
_CDR3 = f"""c AS (SELECT cdr_id, substr(heavy_cdr3, 1, (length(heavy_cdr3) + 1) // 2) || repeat('-', {WIDTH} - length(heavy_cdr3)) || substr(heavy_cdr3, (length(heavy_cdr3) + 1) // 2 + 1) AS aligned
    FROM cdr_rows WHERE regexp_full_match(heavy_cdr3, '[ACDEFGHIKLMNPQRSTVWY]+') AND length(heavy_cdr3) <= {WIDTH})"""


def _model(length: int) -> str:
    return f"""raw AS (SELECT k, pos, a, 1.0::double + (7 * (k + 1) + 3 * (pos + 1) + 5 * (a + 1)) % 11 AS w FROM range(0, {K}) t1(k), range(0, {length}) t2(pos), range(0, 21) t3(a)),
mu AS (SELECT k, pos, substr('{_AA}', (a + 1)::bigint, 1) AS aa, a, w / sum(w) OVER (PARTITION BY k, pos) AS p FROM raw)"""


_JOINT = (
    f"WITH {_CDR3}, {_model(WIDTH)}, cell AS (SELECT cdr_id, pos, substr(aligned, (pos + 1)::bigint, 1) AS aa FROM (SELECT *, unnest(range(0, {WIDTH})) AS pos FROM c)), "
    f"j AS (SELECT cdr_id, k, ln((k + 1) / 6.0::double) + sum(ln(p)) AS lj, sum(ln(p)) AS ll, ln((k + 1) / 6.0::double) + coalesce(sum(ln(p)) FILTER (aa <> '-'), 0) AS lg, count(*) FILTER (aa <> '-') AS n FROM cell JOIN mu USING (pos, aa) GROUP BY cdr_id, k), "
    "t AS (SELECT cdr_id, max(lj) AS top, max(lg) AS topg, max(n) AS n FROM j GROUP BY cdr_id), "
    "s AS (SELECT j.cdr_id, max(top) + ln(sum(exp(lj - top))) AS score, (max(topg) + ln(sum(exp(lg - topg)))) / max(t.n) AS mean FROM j JOIN t ON t.cdr_id = j.cdr_id GROUP BY j.cdr_id) "
)
_MASK = "SELECT cdr_id, array_to_string(list_transform(range(1, {w} + 1), lambda i: CASE WHEN {keep} THEN (strpos('" + _AA + "', substr(aligned, i, 1)) - 1)::varchar ELSE 'x' END), ',') AS codes FROM c"
_H = f"WITH {NUM}, x AS (SELECT seq_id, seq, num, {_aligned(_list(TEMPLATE.codes))} AS a FROM n)"
_VALID = "regexp_full_match(seq, '[ACDEFGHIKLMNPQRSTVWY]+')"
_HJ = (
    f"{_H}, {_model(len(TEMPLATE.codes))}, cell AS (SELECT seq_id, pos, substr(a, (pos + 1)::bigint, 1) AS aa FROM (SELECT *, unnest(range(0, {len(TEMPLATE.codes)})) AS pos FROM x WHERE {_VALID})), "
    "j AS (SELECT seq_id, k, ln((k + 1) / 6.0::double) + sum(ln(p)) AS lj, ln((k + 1) / 6.0::double) + sum(ln(p)) FILTER (aa <> '-') AS lg, count(*) FILTER (aa <> '-') AS n FROM cell JOIN mu USING (pos, aa) GROUP BY seq_id, k), "
    "t AS (SELECT seq_id, max(lj) AS top, max(lg) AS topg FROM j GROUP BY seq_id) "
)
SQL = {
    "m1_user_mask": f"WITH {_CDR3} " + _MASK.format(w=WIDTH, keep="(i - 1) % 3 <> 0"),
    "m2_terminal_mask": f"""{_H}, c AS (SELECT seq_id AS cdr_id, {" || ".join(f"substr(a, {i + 1}, 1)" for i in TEMPLATE.kept("cdr1"))} AS aligned FROM x WHERE {_VALID}),
o AS ({_MASK.format(w=len(TEMPLATE.kept("cdr1")), keep="i > length(regexp_extract(aligned, '^-*')) AND i <= length(aligned) - length(regexp_extract(aligned, '-*$'))")}) SELECT cdr_id AS seq_id, codes FROM o""",
    "m3_gap_mask": f"WITH {_CDR3} " + _MASK.format(w=WIDTH, keep="substr(aligned, i, 1) <> '-'"),
    "m4_score": _JOINT + "SELECT cdr_id, round(score, 6) AS score, round(mean, 6) AS normalised FROM s",
    "m5_predict": _JOINT + "SELECT cdr_id, arg_min(k, -round(lj, 9) + k * 1e-12)::int AS cluster, arg_min(k, -round(ll, 9) + k * 1e-12)::int AS unweighted FROM j GROUP BY cdr_id",
    "m6_log_joint": _JOINT + "SELECT cdr_id, k, round(lj, 6) AS log_joint FROM j",
    "m7_em_one_step": _JOINT + """, r AS (SELECT j.cdr_id, k, exp(lj - score) AS r FROM j JOIN s ON s.cdr_id = j.cdr_id), g AS (SELECT k, sum(r) AS resp FROM r GROUP BY k), b AS (SELECT sum(score) AS bound FROM s),
e AS (SELECT k, pos, aa, sum(r) AS v FROM r JOIN cell USING (cdr_id) GROUP BY ALL)
SELECT mu.k, mu.pos, mu.aa, round(coalesce(v, 0), 4) AS expected, round(resp, 4) AS resp, round(bound, 3) AS bound FROM mu LEFT JOIN e ON e.k = mu.k AND e.pos = mu.pos AND e.aa = mu.aa JOIN g ON g.k = mu.k, b""",
    "m10_bic_aic": _JOINT + f", p AS (SELECT {K} - 1 + 20 * {K} * {WIDTH} AS p, count(*) AS n, sum(score) AS l FROM s) SELECT round(p * ln(n) - 2 * l, 2) AS bic, round(2 * p - 2 * l, 2) AS aic FROM p",
    "m14_profiles": _JOINT + ", q AS (SELECT cdr_id, arg_min(k, -round(lj, 9) + k * 1e-12) AS k FROM j GROUP BY cdr_id) SELECT k::int AS k, pos::int AS pos, aa, count(*) AS count FROM q JOIN cell USING (cdr_id) GROUP BY ALL",
    "h2_prepared_sequences": f"{_H} SELECT seq_id, CASE WHEN {_VALID} THEN a END AS aligned, CASE WHEN {_VALID} THEN 'H' END AS chain_type FROM x",
    "h5_diagnostics": f"{_H} SELECT seq_id, array_to_string(list_filter({_list(TEMPLATE.codes)}, lambda c: NOT list_contains(num, c)), '_') AS gapped, array_to_string(list_filter(num, lambda c: NOT list_contains({_list(TEMPLATE.codes)}, c)), '_') AS unusual, 'H' AS chain_type FROM x",
    "h6_score_by_chain": _HJ + f""", s AS (SELECT j.seq_id, max(top) + ln(sum(exp(lj - top))) AS score, (max(topg) + ln(sum(exp(lg - topg)))) / max(n) AS mean FROM j JOIN t ON t.seq_id = j.seq_id GROUP BY j.seq_id)
SELECT x.seq_id, round(score + 59.5617, 6) AS adjusted, round(mean, 6) AS normalised FROM x LEFT JOIN s ON s.seq_id = x.seq_id""",
    "h7_topn_clusters": _HJ + "SELECT seq_id, r AS rank, k::int AS cluster, round(lj, 6) AS log_joint FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round(lj, 9) DESC, k) AS r FROM j) WHERE r <= 2",
    "h10_per_residue": _HJ + f""", best AS (SELECT k, pos, arg_min(aa, a - 1000 * round(p, 9) * 1e6) AS best_aa FROM mu GROUP BY k, pos)
SELECT seq_id, cell.pos::int AS pos, ({_list(TEMPLATE.codes)})[cell.pos + 1] AS code, cell.aa, round(ln(mu.p), 6) AS log_p, best_aa FROM cell JOIN mu ON mu.k = seq_id % {K} AND mu.pos = cell.pos AND mu.aa = cell.aa JOIN best ON best.k = mu.k AND best.pos = mu.pos WHERE cell.aa <> '-'""",
}



def _both(sql: str) -> str:
    """A heavy-chain statement over both chains: once as it is and once with the light chain's columns, template and adjustment."""
    light = sql.replace("heavy_", "light_").replace(_list(TEMPLATE.codes), _list(LIGHT.codes)).replace(f"range(0, {len(TEMPLATE.codes)})", f"range(0, {len(LIGHT.codes)})")
    light = light.replace("'H' AS chain_type", "'L' AS chain_type").replace("THEN 'H' END", "THEN 'L' END").replace("59.5617", "33.22445")
    one = "SELECT seq_id || '_{side}' AS chain_id, * EXCLUDE (seq_id) FROM ({sql})"
    return one.format(side="heavy", sql=sql) + " UNION ALL " + one.format(side="light", sql=light)


SQL |= {
    new: _both(SQL[old])
    for new, old in {"h2_both_prepared": "h2_prepared_sequences", "h5_both_diagnostics": "h5_diagnostics", "h6_both_scores": "h6_score_by_chain", "h7_both_topn": "h7_topn_clusters", "h10_both_per_residue": "h10_per_residue"}.items()
}

#: Columns whose type in SQL isn"t that of the query.
_TYPES = {"m6_log_joint": {"k": "INTEGER"}, "m7_em_one_step": {"k": "INTEGER", "pos": "INTEGER"}, "h7_topn_clusters": {"rank": "INTEGER"}, "h7_both_topn": {"rank": "INTEGER"}}
SQL |= {name: typed(SQL[name], types) for name, types in _TYPES.items()}
