"""Records that are the same but for white space, case, punctuation or field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainforge.runtime import store


def letters(c: Column) -> Column:
    """The letters A-Z of a text in order, in one case; those of null are none."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", ""))


def fields(c: Column) -> Column:
    """The set of key-value fields of a header, whatever their order, case, spacing and punctuation; a last key may lack its value."""
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(words, F.lit("([a-z0-9]+) ?([a-z0-9]*)"), 0))), "|")


def keyed(df: DataFrame, table_name: str, record_id: Column, parts: list[Column]) -> DataFrame:
    """table_name, k1, k2, id: a 128-bit key of the canonical parts. Rows with a null id are left out: they can't be named."""
    name = F.lit(table_name)
    return df.select(name.alias("table_name"), F.xxhash64(name, *parts).alias("k1"), F.xxhash64(*parts, F.lit(len(parts)), name).alias("k2"), record_id.cast("long").alias("id")).where("id IS NOT NULL")


KEY = ["table_name", "k1", "k2"]


def _hot(keys: DataFrame, hot_rows: int, max_hot_keys: int, salts: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows of cold keys, rows of hot keys, and the hot keys with kept_id and n; None if there are no hot keys."""
    n = keys.count()
    hot_rows = max(hot_rows, -(-n // max_hot_keys))  # so at most max_hot_keys keys can be hot, and what is broadcast has that bound
    hot = store(keys.groupBy(*KEY).count().where(F.col("count") > hot_rows).drop("count"))
    if hot.isEmpty():
        return keys, None, None
    rows = keys.join(F.broadcast(hot), KEY, "left_semi")
    salted = rows.groupBy(*KEY, F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("m"), F.count("*").alias("c"))
    return keys.join(F.broadcast(hot), KEY, "left_anti"), rows, salted.groupBy(*KEY).agg(F.min("m").alias("kept_id"), F.sum("c").alias("n"))


def hidden_duplicates(keys: DataFrame, hot_rows: int = 10_000, max_hot_keys: int = 20_000, salts: int = 64) -> DataFrame:
    """table_name, kept_id, copy_id: a row for each record that copies one with a smaller id, which is the least of its set.

    ``keys`` comes from ``keyed``. Keys of more than hot_rows rows are found exactly with partial counts, aggregated in two salted
    levels and joined back by a broadcast of at most max_hot_keys keys; all others take one shuffle, in which every row is set beside
    the least id of its key; no list of ids is ever made. Ties can't arise, as the least id is kept; a row given twice with one id
    isn't a copy of itself. Empty: no rows.
    """
    cold, rows, hot = _hot(store(keys), hot_rows, max_hot_keys, salts)  # stored: the texts are read and put into canonical form once
    out = cold.select("table_name", F.min("id").over(Window.partitionBy(*KEY)).alias("kept_id"), F.col("id").alias("copy_id"))
    if rows is not None:
        out = out.unionAll(rows.join(F.broadcast(hot), KEY).select("table_name", "kept_id", F.col("id").alias("copy_id")))
    return out.where("copy_id <> kept_id")


def collapsed(keys: DataFrame, hot_rows: int = 10_000, max_hot_keys: int = 20_000, salts: int = 64) -> DataFrame:
    """table_name, kept_id, n_copies: one row per set of equal records with the number of rows in it, itself included."""
    cold, _, hot = _hot(store(keys), hot_rows, max_hot_keys, salts)
    out = cold.groupBy(*KEY).agg(F.min("id").alias("kept_id"), F.count("*").alias("n")).select("table_name", "kept_id", F.col("n").alias("n_copies"))
    return out if hot is None else out.unionAll(hot.select("table_name", "kept_id", F.col("n").alias("n_copies")))
