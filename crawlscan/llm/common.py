"""Helpers that the training-data operators share: shared-folder tables, sized broadcasts, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Deletes the shuffle files of a finished write; without it they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A side is broadcast only when its counted rows stay at or under this bound.
BROADCAST_ROWS = 200_000
WAVES = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-JVM local session may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='crawlscan-shared-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts lineage and outlives any executor.  Tables that the returned DataFrame
    still reads stay until ``spark.checkpoint.dir`` is cleaned, like checkpoints.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/crawlscan-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, key: str, codec: str = "zstd", *, few: bool = False) -> DataFrame:
        """Write ``df`` and return it as read back.

        ``few`` is for results of shuffles, which ``few_tasks`` write, as a file costs far more than a
        shuffle partition.
        """
        at = f"{self.path}/{key}"
        df = few_tasks(df) if few else df
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(at)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def result(self, df: DataFrame, key: str) -> DataFrame:
        """Store the last table of a call and delete all others."""
        out = self.save(df, key, few=True)
        fs, path = self._fs(self.path)
        for s in fs.listStatus(path):
            if s.getPath().getName() != key:
                fs.delete(s.getPath(), True)
        return out

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, key: str) -> None:
        """Delete a table that nothing reads any more."""
        fs, path = self._fs(f"{self.path}/{key}")
        fs.delete(path, True)


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in at most ``WAVES`` tasks a core, each of which works through shuffle partitions in turn.

    A task needs no more memory than for one partition, and what each costs besides its rows (a file, a
    call of Python) falls.
    """
    return df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it counts at most ``max_rows`` rows, else as it is.

    ``df`` should be a stored table, as it is counted.  Beyond the bound Spark plans a shuffled
    join, whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drop_chars(text: Column, chars: str) -> Column:
    """``text`` without the given characters."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
