"""Queries of the operators on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainforge.llm.byte_bpe import encode_texts
from chainforge.llm.languages import languages
from chainforge.llm.mixing import mix, sized
from chainforge.runtime import table


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


def _mixed(spark: SparkSession, sf: str, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "mix_targets")
    return mix(sized(table(spark, sf, "documents"), targets, F.col("doc_id"), F.col("source"), F.col("text"), keep_text), targets)


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf, True)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf, False)[1]


def p9_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source should have, whether it has it but for its largest document and a hundredth, and whether the caps are kept."""
    targets = table(spark, sf, "mix_targets")
    sizes = sized(table(spark, sf, "documents"), targets, F.col("doc_id"), F.col("source"), F.col("text"))
    shares = mix(sizes, targets)[1].join(targets.select("source", "max_repeats"), "source").join(sizes.groupBy("source").agg(F.max("n_tokens").alias("largest")), "source", "left")
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row per target
    off = F.abs(F.col("actual_share") - F.coalesce("target_share", F.lit(0.0)))
    met = off <= 0.01 + F.coalesce(F.col("largest") / total, F.lit(0.0))
    return shares.select("source", F.round("target_share", 9).alias("target_share"), met.alias("met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"))


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    return languages(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), F.col("lang"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    case = F.when(F.col("cell_no") == 0, ~F.col("label").eqNullSafe(F.col("lang"))).otherwise(F.col("lang") != F.col("main"))
    return p10_languages(spark, sf).where(F.col("lang").isNotNull() & case).select("doc_id", "cell_no", "lang")


QUERIES = {"p8_ids": p8_ids, "p9_selection": p9_selection, "p9_shares": p9_shares, "p9_targets": p9_targets, "p10_found": p10_found, "p10_languages": p10_languages}
SQL = {
    "p9_targets": """
WITH u AS (SELECT source, target_weight AS w FROM mix_targets WHERE target_weight > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE length(text) > 0))
SELECT m.source, round(u.w / (SELECT sum(w) FROM u), 9) AS target_share, TRUE AS met, TRUE AS capped FROM mix_targets m LEFT JOIN u USING (source) WHERE m.source IS NOT NULL""",
}
