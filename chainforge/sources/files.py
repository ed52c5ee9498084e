"""Readers and writers of sequence files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainforge.functions.alphabet import encode
from chainforge.operators.mixture import CategoricalMixture
from chainforge.operators.search import dense_numbers


def _paths(paths) -> list[str]:
    if not isinstance(paths, (list, tuple)) or not paths or not all(isinstance(p, str) for p in paths):
        raise ValueError("paths is a list of file names")
    return list(paths)


def _place(spark: SparkSession, paths: list[str]) -> Column:
    """A sortable text of file, block and row: the order of the given paths, of the files in a folder, and of their rows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    at = F.lit(len(paths))
    for i, p in reversed(list(enumerate(paths))):
        path = jvm.org.apache.hadoop.fs.Path(p)
        whole = re.sub("^file:/+", "/", path.getFileSystem(conf).makeQualified(path).toUri().toString()).rstrip("/")
        at = F.when((file == whole) | file.startswith(whole + "/"), F.lit(i)).otherwise(at)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.concat(F.lpad(at.cast("string"), 9, "0"), F.lit(":"), name, F.lit(":"), file, F.lit(":"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 18, "0"), F.lit(":"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))


def count_records(df: DataFrame, most: int = 2**32 - 1) -> int:
    """The number of rows, counted before a database is built from them; more than ``most`` raise an error, none is 0."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows; a database holds {most} at most")
    return n


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """place, seqinfo, sequence, error: one row per record.

    A line that begins with > starts a record; its sequence may take several lines; blank lines don't count; files that end in .gz are
    unpacked. error is null, ``no name`` or ``no sequence``. Large plain files are split at record starts; a .gz is one task.
    """
    raw = spark.read.option("lineSep", "\n>").text(_paths(paths)).select("value", _place(spark, paths).alias("place"))
    lines = F.transform(F.split(F.regexp_replace("value", r"^\s*>", ""), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " ")))
    rows = raw.where(F.length(F.trim("value")) > 0).select("place", lines.alias("l"))
    out = rows.select("place", F.element_at("l", 1).alias("seqinfo"), F.array_join(F.slice("l", F.lit(2), F.size("l")), "").alias("sequence"))
    return out.withColumn("error", F.when(F.col("seqinfo") == "", "no name").when(F.col("sequence") == "", "no sequence"))


def read_csv_rows(spark: SparkSession, paths: list[str], n_columns: int, skip_rows: int = 0, delimiter: str = ",", multiline: bool = False) -> DataFrame:
    """place, c0, c1, ...: CSV rows as texts without the first skip_rows lines of every file; empty rows don't count.

    Fields beyond n_columns are left out and missing ones null. multiline: quoted fields may hold line breaks; then a file is one task, and
    skip_rows counts rows that aren't empty. Else large plain files are split, and skip_rows counts all lines.
    """
    if skip_rows < 0 or n_columns < 1:
        raise ValueError("skip_rows isn't negative and n_columns is positive")
    columns = [f"c{i}" for i in range(n_columns)]
    schema = ", ".join(f"{c} string" for c in columns)
    options = {"sep": delimiter, "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}
    reader = spark.read.schema(schema).options(**options).option("multiLine", True).csv if multiline else spark.read.text
    raw = reader(_paths(paths))
    rows = raw.select(_place(spark, paths).alias("place"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), *(columns if multiline else ["value"]))
    if skip_rows:
        first = rows.where("__b = 0").groupBy("__f").agg(F.min("__m").alias("__first"))  # a row per file
        rows = rows.join(F.broadcast(first), "__f", "left").where((F.col("__b") > 0) | (F.col("__m") >= F.col("__first") + skip_rows)).drop("__first")
    if not multiline:
        rows = rows.where(F.length("value") > 0).withColumn("__r", F.from_csv("value", schema, options)).select("place", "__f", "__b", "__m", "__r.*")
    return rows.select("place", *columns).where(F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in columns)) != "")


def with_ids(df: DataFrame, order: str = "place") -> DataFrame:
    """df with seq_id 1, 2, ... in the order of its files and rows."""
    return df.join(dense_numbers(df, order).withColumnRenamed("number", "seq_id"), order).drop(order)


def write_fasta(df: DataFrame, seqinfo: Column, sequence: Column, path: str) -> None:
    """A folder of FASTA files; rows without name or sequence are left out."""
    df.where(F.length(seqinfo) > 0).where(F.length(sequence) > 0).select(F.concat(F.lit(">"), F.regexp_replace(seqinfo, r"[\r\n]+", " "), F.lit("\n"), F.regexp_replace(sequence, r"\s", "")).alias("value")).write.text(path)


def write_rejects(df: DataFrame, text: Column, code: Column, path: str) -> None:
    """A folder of rejected rows, a tab and the code after each; FASTA rejects pass >info and the sequence is a second line."""
    df.where(code.isNotNull()).select(F.concat_ws("\t", text, code).alias("value")).write.text(path)


def read_germlines(spark: SparkSession, paths: list[str], database: str = "imgt") -> DataFrame:
    """gene_name, species, receptor, retrieved, aligned_seq from files {species}_{database}_{receptor}_..._{date}.fa.gz.

    Files of other databases are left out. Two files of one species and receptor raise an error.
    """
    kept: dict[tuple[str, str], str] = {}
    for p in _paths(paths):
        parts = p.rsplit("/", 1)[-1].split(".")[0].split("_")
        if len(parts) < 4 or parts[1] != database:
            continue
        if (parts[0], parts[2]) in kept:
            raise ValueError(f"two germline files of {parts[0]} {parts[2]}")
        kept[parts[0], parts[2]] = p
    if not kept:
        raise ValueError(f"no germline file of {database!r}")
    named = F.split(F.regexp_extract(F.col("place"), r"^\d+:([^:]*):", 1), "[_.]")
    raw = read_fasta(spark, list(kept.values()))
    date = F.regexp_extract(F.col("place"), r"_([^_:.]+)\.[^:]*:", 1)
    return raw.where("error IS NULL").select(F.col("seqinfo").alias("gene_name"), F.element_at(named, 1).alias("species"), F.element_at(named, 3).alias("receptor"), date.alias("retrieved"), F.col("sequence").alias("aligned_seq"))


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    """chain, kmer from a CSV without header."""
    return spark.read.schema("chain string, kmer string").csv(path).where("chain IS NOT NULL AND kmer IS NOT NULL").select(F.trim("chain").alias("chain"), F.trim("kmer").alias("kmer"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """pos, allowed array<string> from lines ``pos,aa,aa,...`` up to ``//``; ``#`` lines are comments, ``-`` allows anything."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|//|$)"))
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return lines.select(F.element_at(parts, 1).cast("int").alias("pos"), F.filter(F.slice(parts, 2, 100), lambda x: (x != "-") & (x != "")).alias("allowed"))


def load_model(mu_path: str, weights_path: str, clip: float | None = None) -> CategoricalMixture:
    """A model from two .npy files, mu clipped from below if asked for."""
    mu, w = np.load(mu_path), np.load(weights_path)
    return CategoricalMixture(len(w), mu.shape[1]).load(np.maximum(mu, clip) if clip else mu, w)


def encode_to_parquet(df: DataFrame, seq: Column, length: int, path: str, chunk_rows: int = 10_000) -> DataFrame:
    """Encoded sequences in files of at most chunk_rows rows, read back."""
    if chunk_rows <= 0:
        raise ValueError("chunk_rows is positive")
    df.where(F.length(seq) > 0).select(encode(seq, length).alias("codes")).write.option("maxRecordsPerFile", chunk_rows).parquet(path)
    return df.sparkSession.read.parquet(path)


def element(line: Column, n: int) -> Column:
    """Element n (from 0) of a comma-separated line, null if blank or missing."""
    value = F.trim(F.get(F.split(line, ","), F.lit(n)))
    return F.when(value != "", value)
