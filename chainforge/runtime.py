"""Session helpers: reading tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session has none and is local (tests, a single machine) a folder of this machine is made and used. On a cluster that
    would leave every executor with a part on its own disk, so it raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="chainforge-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder's owner cleans it
        pass


@atexit.register
def release() -> None:
    """Delete all tables stored so far. For a long session, once the results of its queries are written: nothing may read them after this.

    The end of the application does the same.
    """
    while _written:
        _delete(*_written.pop())


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with the stored tables."""
    path = f"{shared_dir(spark)}/chainforge-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


class Stored:
    """A result written once to the shared folder, so that a lost executor costs a re-read and no recomputation."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        ship(self.spark)
        self.path = folder(self.spark)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read ``df`` after this."""
        _delete(self.spark, self.path)
        if (self.spark, self.path) in _written:
            _written.remove((self.spark, self.path))


def store(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back."""
    return Stored(df).df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per application; the readers of tables below call it.

    With it neither the machines' Python path nor --py-files need name the package.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # it came in an archive, which is shipped already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="chainforge-"), "chainforge_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.join("chainforge", os.path.relpath(at, root)))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if its scan has fewer partitions than the cluster has cores.

    For narrow maps that cost much more than their input: a table in a few files, or a file of one row group, would else keep most
    cores idle. A table of enough files is passed through and not shuffled. Streams are
    passed through. Only for plans without shuffles of their own.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores)
