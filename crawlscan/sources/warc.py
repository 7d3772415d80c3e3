"""The ``warc`` data source: a Spark reader with one partition per archive, and a writer.

Reader options: ``archives`` (JSON list of URIs; or load(path) for one), ``mode``, ``types`` and ``include_body``.
An archive that fails must not give half of its hits, but rows stream out before a failure is known.
So the reader never raises, whatever the bytes: each archive ends with a status row (record_idx -1,
content_length the number of its records, error null or why it failed, and the seconds that fetching
and reading took), and callers drop the hits of failed archives.

An archive is read from where it is, local paths, http(s) and what Arrow reaches, or, with the options
``base_url`` and ``folder``, is first fetched into a folder that tasks share, unless it is there.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from crawlscan.schemas import RECORD
from crawlscan.sources.fetch import fetch, open_stream, open_uri
from crawlscan.sources.warc_format import Gunzip, Record, format_record, gzip_member, read_lenient, read_stream

MODES = ("fail_archive", "lenient", "skip_bad_records")
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096
_ARROW = pa.schema(
    [("archive", pa.string()), ("record_idx", pa.int64()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("content_length", pa.int64())]
    + [("body", pa.binary()), ("error", pa.string()), ("fetch_seconds", pa.float64()), ("read_seconds", pa.float64())]
)


class Archive(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = options.get("path")
        self.archives = json.loads(options["archives"]) if "archives" in options else [path]
        self.mode = options.get("mode", "fail_archive")
        self.every_type = options.get("types", "response") != "response"
        self.with_body = options.get("include_body", "true").lower() == "true"
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not self.archives or self.archives == [None]:
            raise ValueError("the option archives, or a path, must name an archive")

        self.base_url, self.folder = options.get("base_url"), options.get("folder")
        if (self.base_url is None) != (self.folder is None):
            raise ValueError("base_url and folder go together")

    def partitions(self) -> list[InputPartition]:
        return [Archive(uri) for uri in self.archives]

    def _records(self, uri: str) -> Iterator[Record]:
        with open_stream(uri) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            if uri.endswith(".gz"):
                stream = io.BufferedReader(Gunzip(stream), 1 << 18)
            flags = {"every_type": self.every_type, "with_body": self.with_body}
            yield from read_lenient(stream, **flags) if self.mode == "lenient" else read_stream(stream, tolerant=self.mode == "skip_bad_records", **flags)

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        name = partition.uri.rpartition("/")[2]
        rows: list[tuple] = []
        held, number, error = 0, 0, None
        fetching = reading = 0.0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        try:
            uri, start = partition.uri, time.perf_counter()
            if self.base_url is not None:
                uri, _ = fetch(uri, base_url=self.base_url, folder=self.folder)
                fetching = time.perf_counter() - start
            records = self._records(uri)
            while True:
                start = time.perf_counter()
                r = next(records, None)
                reading += time.perf_counter() - start
                if r is None:
                    break
                rows.append((name, number, r.warc_type, r.target_uri, r.warc_date, r.content_length, r.body, None, None, None))
                number += 1
                held += len(r.body or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows, held = [], 0
        except Exception as e:  # noqa: BLE001  one archive must not end the others
            error = f"{type(e).__name__}: {e}"
        rows.append((name, -1, "status", "", "", number, None, error, fetching, reading))
        yield batch()


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Writes rows of each archive, which must come together and in order, to ``<path>/<archive>``.

    A member holds one record.  Files are written to a folder of this job, from which they get their
    names when the whole job commits; what failed or repeated tasks left there goes with it.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, folder = open_uri(self.path)
        fs.create_dir(f"{folder}/{self.job}", recursive=True)
        files, name, out = [], None, None
        try:
            for row in rows:
                if row["archive"] != name:
                    if out is not None:
                        out.close()
                    name = row["archive"]
                    temp = f"{folder}/{self.job}/{name}.{uuid.uuid4().hex}"
                    files.append((temp, f"{folder}/{name}"))
                    out = fs.open_output_stream(temp, compression=None)
                record = format_record(row["warc_type"] or "", bytes(row["body"] or b""), row["target_uri"], row["warc_date"])
                out.write(gzip_member(record) if name.endswith(".gz") else record)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = open_uri(self.path)
        for m in messages:
            for temp, final in m.files if m else ():
                if not self.overwrite and fs.get_file_info(final).type != pfs.FileType.NotFound:
                    raise FileExistsError(final)
                fs.move(temp, final)

        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder = open_uri(self.path)
        if fs.get_file_info(f"{folder}/{self.job}").type != pfs.FileType.NotFound:
            fs.delete_dir(f"{folder}/{self.job}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_warc(
    spark: SparkSession, archives: list[str], *, mode: str = "fail_archive", types: str = "response", include_body: bool = True, base_url: str | None = None, folder: str | None = None,
) -> DataFrame:
    """Records and status rows of archives; ``types`` is ``response`` or ``all``.

    With ``base_url`` and ``folder`` each task fetches its archive first; one that cannot be fetched fails
    alone.

    The same rows as ``spark.read.format("warc")``, one archive in a task, but through Python workers
    that Spark keeps between queries, which the data source interface starts anew for every plan.
    """
    spark.dataSource.register(WarcDataSource)
    options = {"archives": json.dumps(archives), "mode": mode, "types": types, "include_body": str(include_body).lower(), "base_url": base_url, "folder": folder}
    reader = WarcReader({k: v for k, v in options.items() if v is not None})
    reader.archives = []  # tasks get theirs as rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                yield from reader.read(Archive(uri))

    listed = spark.createDataFrame(list(enumerate(archives)), "idx int, uri string").repartitionByRange(len(archives), "idx")
    return listed.select("uri").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str, *, overwrite: bool = True) -> None:
    """Write records (archive, record_idx, warc_type, target_uri, warc_date, body) as archives under ``path``.

    A task owns whole archives and files appear under their names when all are written, as with
    ``write.format("warc")``.
    """
    records.sparkSession.dataSource.register(WarcDataSource)
    shaped = records.select("archive", F.col("record_idx").cast("long").alias("record_idx"), "warc_type", "target_uri", "warc_date", F.octet_length("body").cast("long").alias("content_length"), F.col("body").cast("binary").alias("body"), F.lit(None).cast("string").alias("error"))
    dealt = shaped.repartition("archive").sortWithinPartitions("archive", "record_idx")
    writer = WarcWriter({"path": path}, overwrite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = writer.write(row for batch in batches for row in batch.to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*written.files, strict=True)] if written.files else [pa.array([], pa.string())] * 2, names=["temp", "final"])

    try:
        files = dealt.mapInArrow(run, "temp string, final string").collect()  # a row per archive
        writer.commit([Written([(f["temp"], f["final"]) for f in files])])
    except BaseException:
        writer.abort([])
        raise


def good_records(rows: DataFrame, stage: str) -> DataFrame:
    """Records of archives that did not fail; the rows are read once and stored under ``stage``."""
    rows.write.mode("overwrite").parquet(stage)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(stage)
    failed = stored.filter("record_idx = -1 AND error IS NOT NULL").select("archive")
    return stored.filter("record_idx >= 0").join(failed, "archive", "left_anti")
