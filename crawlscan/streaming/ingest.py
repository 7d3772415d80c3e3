"""Incremental ingest: archives that arrive in a folder, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlscan.plans.batch import run_batch
from crawlscan.plans.work import paths_of

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest(
    spark: SparkSession, folder: str, state_path: str, checkpoint: str, *, glob: str = "*.warc.gz", max_files: int = 100,
    mode: str = "fail_archive", boundary: str = "ascii", available_now: bool = True,
) -> StreamingQuery:
    """Run a batch over every group of new archives in ``folder``.

    The stream carries paths alone; bodies are read by the ``warc`` source.  A group that is replayed
    after a failure finds its archives in the manifest, so it adds nothing twice.
    """
    feed = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(folder)

    def each(batch: DataFrame, _: int) -> None:
        uris = sorted(r["path"] for r in batch.select("path").collect())  # at most max_files
        if uris:
            run_batch(batch.sparkSession, paths_of(batch.sparkSession, uris), state_path, mode=mode, boundary=boundary)

    writer = feed.select(F.col("path")).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
