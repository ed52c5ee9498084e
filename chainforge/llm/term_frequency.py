"""Frequency of every term over a whole collection, with marks for terms too rare or too common to be useful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainforge.operators.runs import run_states


def term_frequencies(df: DataFrame, record_id: Column, fields: dict[str, Column], separator: str = "_", rare_records: int = 3, common_share: float = 0.04, partitions: int | None = None) -> DataFrame:
    """field, term, occurrences, records, mark: one row per distinct term of each field.

    Pairs of term and record identifier are range-partitioned and sorted externally; a run-length scan of each range counts
    occurrences and distinct records, and the states of a term that crosses ranges are stitched. A term in a third of all rows
    is cut at its record identifiers, so no range holds more than its share.

    A value holds terms joined by ``separator``, compared exactly as written; null and empty values and empty terms hold none. A
    record counts once per term however often it repeats it. mark: ``rare`` if at most rare_records records of the field hold the
    term, ``common`` if more than common_share of all rows of ``df`` do, else ``useful``; rare wins in a table so small that both
    apply. Null identifiers count in occurrences only. An empty table gives no rows.
    """
    total = df.count()
    pairs = [F.struct(F.lit(name).alias("f"), F.split(F.when(value != "", value), f"\\Q{separator}\\E", -1).alias("t")) for name, value in fields.items()]
    terms = df.select(record_id.alias("r"), F.explode(F.array(*pairs)).alias("p")).select("r", "p.f", F.explode("p.t").alias("t")).where("t <> ''")
    counted = run_states(terms, {"field": F.col("f"), "term": F.col("t")}, F.col("r"), partitions=partitions)
    mark = F.when(F.col("n_distinct") <= rare_records, "rare").when(F.col("n_distinct") > F.lit(common_share) * F.lit(total), "common").otherwise("useful")
    return counted.select("field", "term", F.col("n_rows").alias("occurrences"), F.col("n_distinct").alias("records"), mark.alias("mark"))
