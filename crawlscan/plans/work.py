"""Work planning: which archives of a paths list to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscan.functions.hosts import filename, trimmed
from crawlscan.schemas import PATHS


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(idx, uri) of a paths file, plain or gzip: trimmed lines that are not blank, numbered from 1.

    A paths list is small next to the archives it names; its lines keep their order.  Raises if the
    file cannot be read or names nothing.
    """
    lines = spark.read.text(path).coalesce(1)
    numbered = lines.select(trimmed("value").alias("uri"), F.monotonically_increasing_id().alias("at")).filter("uri <> ''")
    out = numbered.select(F.row_number().over(Window.orderBy("at")).alias("idx"), "uri")
    if out.isEmpty():
        raise ValueError(f"{path}: no paths")
    return out


def paths_of(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(idx, uri) of URIs in memory."""
    kept = [u.strip() for u in uris if u.strip()]
    return spark.createDataFrame([(k + 1, u) for k, u in enumerate(kept)], PATHS)


def _ranked(paths: DataFrame, processed: DataFrame) -> DataFrame:
    """``paths`` with its file name, whether it is processed, and how many unprocessed lines are up to it."""
    done = processed.select(F.col("filename").alias("done")).distinct()
    named = paths.withColumn("filename", filename(F.col("uri")))
    marked = named.join(done, F.col("filename") == F.col("done"), "left").withColumn("seen", F.col("done").isNotNull()).drop("done")
    upto = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("rank", F.sum((~F.col("seen")).cast("long")).over(upto))


def work_list(paths: DataFrame, processed: DataFrame, limit: int | None = None) -> DataFrame:
    """(idx, uri, filename) of the unprocessed paths, the first ``limit`` of them if given.

    Names that occur twice in the list are two items.
    """
    ranked = _ranked(paths, processed).filter("NOT seen")
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select("idx", "uri", "filename")


def plan_work(paths: DataFrame, processed: DataFrame, limit: int | None = None) -> tuple[list, int]:
    """The rows of ``work_list`` in order, and ``skip_count``, from one pass over the list."""
    ranked = _ranked(paths, processed)
    ranked = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    item = F.when(~F.col("seen"), F.struct("idx", "uri", "filename"))
    found = ranked.agg(F.array_sort(F.collect_list(item)).alias("work"), F.count_if("seen").alias("skipped")).first()
    return found["work"], found["skipped"]


def archive_url(uri: Column, base_url: str) -> Column:
    """Where a listed archive is fetched from."""
    return F.concat(F.lit(base_url), uri)


def skip_count(paths: DataFrame, processed: DataFrame, limit: int | None = None) -> DataFrame:
    """(skipped): processed paths met before the scan of the list ends.

    The scan ends at the first unprocessed path beyond ``limit``.
    """
    ranked = _ranked(paths, processed).filter("seen")
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).agg(F.count(F.lit(1)).alias("skipped"))
