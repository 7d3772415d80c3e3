"""A batch run: plan, scan, extract, drop failed archives, deduplicate, merge, commit, summarise."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscan.functions.hosts import LITERAL, hosts_in
from crawlscan.operators.sources import as_sources, dedupe_sources
from crawlscan.plans.work import plan_work
from crawlscan.schemas import RESULTS
from crawlscan.sources.state import Committed, State, read_json_results, read_processed_log
from crawlscan.sources.warc import read_warc

#: Names of the four ways to read, and what they mean here: tolerance and word boundaries.
STRATEGIES = {
    "baseline": ("skip_bad_records", "unicode"),
    "bytes": ("fail_archive", "unicode"),
    "memchr": ("fail_archive", "ascii"),
    "mmap": ("lenient", "ascii"),
}
#: Those that read files on disk only.
DISK_ONLY = ("baseline", "mmap")


def strategy_options(strategy: str, stream: bool = False) -> tuple[str, str]:
    """(mode, boundary) of a strategy.

    ``stream`` asks for reading without files on disk, which two strategies cannot; they warn.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {sorted(STRATEGIES)}")
    if stream and strategy in DISK_ONLY:
        warnings.warn(f"{strategy} does not stream; archives are read from disk", stacklevel=2)
    return STRATEGIES[strategy]


def scan_archives(spark: SparkSession, archives: list[str], *, mode: str = "fail_archive", boundary: str = "ascii", base_url: str | None = None, folder: str | None = None) -> DataFrame:
    """Hits and status rows of archives, in one pass and without bodies.

    A status row (record_idx -1, null onion) ends each archive; content_length is its record count,
    error why it failed, if it did, and the seconds tell what fetching and reading took.
    """
    rows = read_warc(spark, archives, mode=mode, base_url=base_url, folder=folder)
    status = F.col("record_idx") == -1
    found = F.when(status, F.array(F.lit(None).cast("string"))).otherwise(hosts_in(F.col("body"), binary=True, boundary=boundary))
    likely = rows.filter(status | F.contains("body", F.lit(LITERAL.encode())))
    return likely.select("archive", "record_idx", "target_uri", "warc_date", "content_length", "error", "fetch_seconds", "read_seconds", F.explode(found).alias("onion"))


def run_batch(
    spark: SparkSession, paths: DataFrame, state_path: str, *, resolve: Callable[[str], str] = str, limit: int | None = None,
    mode: str = "fail_archive", boundary: str = "ascii", delete: bool = False, base_url: str | None = None, folder: str | None = None,
) -> DataFrame:
    """Process the unprocessed archives of ``paths`` (idx, uri) into the state folder.

    ``resolve`` gives the URI to read for a listed URI; with ``base_url`` and ``folder`` each archive's task
    fetches it into the folder first.  An archive that fails, in the fetch or later, adds nothing and is
    tried again next time; the others are not touched by that.  Returns one row (``SUMMARY``); seconds are
    sums over archives, and their means over the processed ones.  The driver holds a row for each archive
    of the work list, never their data.
    """
    state = State(spark, state_path)
    work, skipped = plan_work(paths, state.processed(), limit)
    bad_names = sum(not w["filename"] for w in work)
    todo = [w for w in work if w["filename"]]
    archives = [w["uri"] if base_url else resolve(w["uri"]) for w in todo]
    if not archives:
        before = state.hosts_total()
        return spark.createDataFrame([(0, skipped, bad_names, 0, before, 0, before, 0, 0.0, 0.0, None, None)], SUMMARY)
    stage = f"{state.path}/_stage/{uuid.uuid4().hex}"
    scan_archives(spark, archives, mode=mode, boundary=boundary, base_url=base_url, folder=folder).write.parquet(stage)
    scanned = spark.read.parquet(stage)
    ends = scanned.filter("record_idx = -1").select("archive", "content_length", "error", "fetch_seconds", "read_seconds").collect()
    good = [r for r in ends if r["error"] is None]
    failed = {r["archive"] for r in ends if r["error"] is not None}
    names = sorted({r["archive"] for r in good} - failed)
    hits = scanned.filter("record_idx >= 0")
    if failed:
        hits = hits.join(spark.createDataFrame([(name,) for name in sorted(failed)], "archive string"), "archive", "left_anti")
    done = state.commit(dedupe_sources(as_sources(hits)), spark.createDataFrame([(name,) for name in names], "filename string"))
    if delete:
        finished = set(names)
        for w, uri in zip(todo, archives, strict=True):
            if w["filename"] in finished:
                _delete(spark, f"{folder}/{w['filename']}" if base_url else uri)
    _delete(spark, stage)
    seconds = [sum(r[c] or 0.0 for r in good) for c in ("fetch_seconds", "read_seconds")]
    row = (
        len(good), skipped, len(ends) - len(good) + bad_names, sum(r["content_length"] for r in good), done.hosts_before, done.hosts_new,
        done.hosts_before + done.hosts_new, done.sources_new, *seconds, *(s / len(good) if good else None for s in seconds),
    )
    return spark.createDataFrame([row], SUMMARY)


def import_earlier(spark: SparkSession, state_path: str, json: str | None = None, log: str | None = None) -> Committed:
    """Add earlier results (a JSON document) and processed archives (a text log) to a state.

    Archives that only the results name are read again.  What is there already stays as it is.
    """
    found = read_json_results(spark, json) if json else spark.createDataFrame([], RESULTS)
    names = read_processed_log(spark, log) if log else spark.createDataFrame([], "filename string")
    once = found.groupBy("onion", "url", "archive").agg(F.min("date").alias("date")).select(*RESULTS.fieldNames())
    return State(spark, state_path).commit(once, names, found.select(F.col("archive").alias("filename")))


SUMMARY = (
    "processed long, skipped long, failed long, records long, hosts_before long, hosts_new long, hosts_total long, sources_new long, "
    "fetch_seconds double, read_seconds double, mean_fetch_seconds double, mean_read_seconds double"
)


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as e:  # noqa: BLE001  a source that cannot be deleted is no reason to fail
        warnings.warn(f"{uri} was not deleted: {e}", stacklevel=2)
