"""Operators on streams (an extension: batch and stream share the same functions).

Parsing, validation, encoding, gene parsing, trimming, labels, liabilities and scores are narrow maps of one DataFrame to another, so they
run unchanged on a streaming one. What needs state, counts of rejects by time, is an aggregate with a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from chainforge.operators.parse_records import FIELDS, parse_records


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_stream(stream: DataFrame, record_id: Column, line: Column) -> DataFrame:
    """The records of a stream of lines, as ``parse_records`` gives them: reason is null for valid ones."""
    return parse_records(stream, record_id, line, FIELDS)


def write_parted(parsed: DataFrame, good_path: str, bad_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write valid and rejected records of a parsed stream to two folders.

    Each batch is one pass: the parsed rows are cached for the two writes. A batch that is repeated after a failure overwrites its
    own folder, so the result holds each record once.
    """

    def both(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        kept.where("reason IS NOT NULL").select(batch.columns[0], "reason").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        kept.unpersist()

    return parsed.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_by_time(stream: DataFrame, at: str, key: Column, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """start, stop, key, n: rows by event time and key; rows later than the watermark are left out, as their windows are closed.

    The state is one row per open window and key.
    """
    w = F.window(at, window, slide) if slide else F.window(at, window)
    counted = stream.withWatermark(at, late).groupBy(w.alias("w"), key.alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "key", "n")
