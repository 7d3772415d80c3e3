"""Registry of the engine's own queries, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscan.corpus import crawl, crawl_sql
from crawlscan.functions.hosts import digits_as_long, extract_hosts, filename, host_version, is_response
from crawlscan.functions.shared import scratch_dir
from crawlscan.operators import sources as S
from crawlscan.plans.batch import STRATEGIES, import_earlier, run_batch, scan_archives, strategy_options
from crawlscan.plans.work import archive_url, paths_of, read_paths, skip_count, work_list
from crawlscan.sources.fetch import open_uri
from crawlscan.sources.state import State, read_json_results, read_processed_log
from crawlscan.sources.warc import good_records, read_warc, write_warc
from crawlscan.sources.warc_format import gzip_member
from crawlscan.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the SQL side: its regex engine has ASCII word boundaries.
_PATTERN = r"\b(?:[a-z2-7]{16}|[a-z2-7]{56})\.onion\b"
_HITS = f"""WITH crawl AS ({crawl_sql(duckdb=True)}),
resp AS (SELECT * FROM crawl WHERE lower(warc_type) = 'response' AND length(body) > 0),
hits AS (SELECT archive, record_idx, target_uri, warc_date, unnest(regexp_extract_all(body, '{_PATTERN}')) AS onion FROM resp),
ded AS (SELECT onion, target_uri AS url, min_by(warc_date, record_idx) AS date, archive FROM hits GROUP BY onion, target_uri, archive) """
_LISTED = """WITH paths AS (SELECT row_number() OVER (ORDER BY page_id) AS idx, url AS uri, page_id FROM pages),
ranked AS (SELECT idx, uri, list_extract(string_split(uri, '/'), -1) AS filename, page_id % 4 = 0 AS seen,
  sum(CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END) OVER (ORDER BY idx) AS rnk FROM (SELECT idx, concat('crawl/a/', cast(page_id AS varchar), '.warc.gz') AS uri, page_id FROM paths)) """
_LIMIT = 10


def query(sql: str) -> Callable:
    """Register a query under its name with its DuckDB SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response records of the derived crawl with a body."""
    return crawl(spark, sf_dir).filter(is_response(F.col("warc_type")) & (F.length("body") > 0))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_hosts(responses(spark, sf_dir))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dedupe_sources(S.as_sources(hits(spark, sf_dir)))


@query(_HITS + "SELECT archive, record_idx, target_uri, warc_date, onion FROM hits")
def extract_host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("archive", "record_idx", "target_uri", "warc_date", "onion")


@query(_HITS + "SELECT onion, url, date, archive FROM ded")
def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir)


@query(_HITS + "SELECT onion, CAST(to_json(list(struct_pack(url := url, date := date, archive := archive) ORDER BY archive, url)) AS VARCHAR) AS sources FROM ded GROUP BY onion")
def nested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nest_sources(deduped(spark, sf_dir)).select("onion", F.to_json("sources").alias("sources"))


@query(_HITS + "SELECT archive, count(DISTINCT onion) AS hosts FROM ded GROUP BY archive")
def hosts_per_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hosts_per_archive(deduped(spark, sf_dir))


@query(_HITS + "SELECT archive, count(*) AS new_hosts FROM (SELECT onion, min(archive) AS archive FROM ded GROUP BY onion) GROUP BY archive")
def new_hosts_by_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.new_hosts_by_archive(deduped(spark, sf_dir))


@query(_HITS + "SELECT count(DISTINCT onion) AS hosts FROM ded")
def total_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.total_hosts(deduped(spark, sf_dir))


@query(_HITS + "SELECT CASE length(onion) WHEN 22 THEN 2 WHEN 62 THEN 3 END AS version, count(DISTINCT onion) AS hosts FROM ded GROUP BY 1")
def hosts_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).groupBy(host_version(F.col("onion")).alias("version")).agg(F.countDistinct("onion").alias("hosts"))


@query(_HITS + "SELECT archive, count(*) AS records, CAST(sum(octet_length(encode(body))) AS BIGINT) AS bytes FROM resp GROUP BY archive")
def response_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).groupBy("archive").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("body")).alias("bytes"))


@query(_HITS + "SELECT lower(warc_type) AS warc_type, count(*) AS records FROM crawl GROUP BY 1")
def record_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl(spark, sf_dir).groupBy(F.lower("warc_type").alias("warc_type")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS filename FROM pages")
def filename_from_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", filename(F.col("url")).alias("filename"))


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A paths list of one archive per page, and every fourth of them as processed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    uri = F.concat(F.lit("crawl/a/"), F.col("page_id").cast("string"), F.lit(".warc.gz"))
    rows = pages.select(F.expr("row_number() OVER (ORDER BY page_id)").alias("idx"), uri.alias("uri"))
    return rows, pages.filter("page_id % 4 = 0").select(filename(uri).alias("filename"))


@query(_LISTED + f"SELECT CAST(idx AS INTEGER) AS idx, uri, filename FROM ranked WHERE NOT seen AND rnk <= {_LIMIT}")
def limited_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_list(*_listed(spark, sf_dir), _LIMIT)


@query(_LISTED + "SELECT CAST(idx AS INTEGER) AS idx, uri, filename FROM ranked WHERE NOT seen")
def full_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_list(*_listed(spark, sf_dir))


@query(_LISTED + f"SELECT count(*) AS skipped FROM ranked WHERE seen AND rnk <= {_LIMIT}")
def skipped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_count(*_listed(spark, sf_dir), _LIMIT)


_EARLIER = "archive IN ('SEG-00000.warc.gz', 'SEG-00003.warc.gz', 'SEG-00005.warc.gz')"


@query(_HITS + f"SELECT onion, url, date, archive FROM ded WHERE {_EARLIER} UNION ALL SELECT onion, url, '2026-01-01T00:00:00Z', archive FROM ded WHERE NOT {_EARLIER}")
def merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All archives processed again after some: what was there keeps its dates."""
    found = S.as_sources(hits(spark, sf_dir))
    existing = S.dedupe_sources(found.filter(_EARLIER))
    again = S.dedupe_sources(found.withColumn("date", F.lit("2026-01-01T00:00:00Z")))
    return S.merge_sources(existing, again)


@query(_HITS + "SELECT onion FROM ded WHERE onion NOT IN (SELECT onion FROM ded WHERE archive = 'SEG-00000.warc.gz') GROUP BY onion")
def new_hosts_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduped(spark, sf_dir)
    return S.new_hosts(found, found.filter("archive = 'SEG-00000.warc.gz'"))


_LENGTHS = "(VALUES ('12345'), ('0'), ('  42  '), ('-5'), ('12a3'), (''), ('none')) AS t(v)"


@query(f"SELECT v, coalesce(try_cast(nullif(regexp_replace(v, '[^0-9]', '', 'g'), '') AS BIGINT), 0) AS n FROM {_LENGTHS}")
def content_length_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT v FROM {_LENGTHS}").select("v", digits_as_long(F.col("v")).alias("n"))


_V2, _OTHER, _V3 = "k5r2tqz7wm3nxy4p", "mm22nn33oo44pp55", "zy2x7wq5" * 7
#: Bodies around the edges of the host grammar.
CASES = [
    f"http://{_V2}.onion", f"read on at {_V3}.onion, or not", f"{_V2}.onionized", "short23.onion", f"{_V2[:8]}9{_V2[9:]}.onion", f"{_V2}.onion {_OTHER}.onion|{_V3}.onion",
    f"{_V2}.onion opens", f"closes {_V2}.onion", "companionship, onion soup and dominion", "", f"é{_V2}.onion", f"{_V2}.onioné", f"mail.{_V2}.onion", f"a-{_V2}.onion", f"_{_V2}.onion",
    f"Z{_V2}.onion", f"9{_V2}.onion", f"b{_V2}.onion", f"{_V2.upper()}.onion", f"{_V2}.ONION", f"{_V2}.onion.onion", f'<img src="http://{_V2}.onion/x.png">', f"{_V2[:15]}.onion {_V3}a.onion",
]
_CASES = "(VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(CASES)) + ") AS t(id, body)"


@query(f"SELECT CAST(id AS INTEGER) AS id, unnest(regexp_extract_all(body, '{_PATTERN}')) AS onion FROM {_CASES}")
def boundary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched on bytes, as records are."""
    return extract_hosts(spark.sql(f"SELECT id, encode(body, 'UTF-8') AS body FROM {_CASES}")).select("id", "onion")


def archives(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, list[str]]:
    """The crawl written as archives: their folder and URIs."""
    folder = scratch_dir(spark, name)
    records = crawl(spark, sf_dir)
    write_warc(records, folder)
    return folder, _listing(folder)


def _listing(folder: str) -> list[str]:
    fs, path = open_uri(folder)
    return sorted(f"{folder}/{f.base_name}" for f in fs.get_file_info(FileSelector(path)) if f.base_name.endswith(".warc.gz"))


@query(_HITS + "SELECT archive, target_uri, warc_date, CAST(octet_length(encode(body)) AS BIGINT) AS content_length, md5(body) AS body_md5 FROM resp")
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, uris = archives(spark, sf_dir, "roundtrip")
    return good_records(read_warc(spark, uris), scratch_dir(spark, "records")).select("archive", "target_uri", "warc_date", "content_length", F.md5("body").alias("body_md5"))


@query(_HITS + "SELECT onion, url, date, archive FROM ded")
def warc_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a paths list over archives to the stored state."""
    folder, uris = archives(spark, sf_dir, "pipeline")
    run_batch(spark, paths_of(spark, uris), f"{folder}-state")
    return State(spark, f"{folder}-state").results()


def _change(uris: list[str], archive: str, change: Callable[[bytes], bytes]) -> None:
    """Rewrite the bytes of an archive."""
    fs, path = open_uri(next(u for u in uris if u.endswith(archive)))
    with fs.open_input_file(path) as f:
        data = f.read()
    with fs.open_output_stream(path, compression=None) as out:
        out.write(change(data))


def _claiming(length: int) -> bytes:
    """A gzip member with a response that claims so many bytes."""
    return gzip_member(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nshort" % length)


@query(_HITS + "SELECT onion, url, date, archive FROM ded WHERE archive IN ('SEG-00000.warc.gz', 'SEG-00001.warc.gz')")
def failed_archive_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that are cut short, corrupt or claim impossible lengths add nothing; the others are whole."""
    folder, uris = archives(spark, sf_dir, "failed")
    _change(uris, "SEG-00002.warc.gz", lambda b: b + _claiming(999_999_999_999_999))
    _change(uris, "SEG-00003.warc.gz", lambda b: b[: len(b) * 2 // 3])
    _change(uris, "SEG-00004.warc.gz", lambda b: b[:10] + b"\xff" + b[11:])  # an impossible kind of deflate block
    _change(uris, "SEG-00005.warc.gz", lambda b: b + _claiming(2**64 - 1))
    _change(uris, "SEG-00006.warc.gz", lambda b: b + gzip_member(b"\xff\n"))
    run_batch(spark, paths_of(spark, uris), f"{folder}-state")
    return State(spark, f"{folder}-state").results()


@query(
    _HITS + "SELECT count(DISTINCT archive) AS processed, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS failed, (SELECT count(*) FROM resp) AS records, "
    "CAST(0 AS BIGINT) AS hosts_before, (SELECT count(DISTINCT onion) FROM ded) AS hosts_new, (SELECT count(DISTINCT onion) FROM ded) AS hosts_total, (SELECT count(*) FROM ded) AS sources_new FROM crawl"
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, uris = archives(spark, sf_dir, "summary")
    counts = ("processed", "skipped", "failed", "records", "hosts_before", "hosts_new", "hosts_total", "sources_new")
    return run_batch(spark, paths_of(spark, uris), f"{folder}-state").select(*counts)  # without times


@query(_HITS + "SELECT onion, url, date, archive FROM ded")
def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one list, the first limited: together they hold what one run would."""
    folder, uris = archives(spark, sf_dir, "resume")
    run_batch(spark, paths_of(spark, uris), f"{folder}-state", limit=3)
    run_batch(spark, paths_of(spark, uris), f"{folder}-state")
    return State(spark, f"{folder}-state").results()


@query(_HITS + "SELECT onion, url, date, archive FROM ded")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives from a folder, a few in each micro-batch."""
    folder, _ = archives(spark, sf_dir, "stream")
    ingest(spark, folder, f"{folder}-state", f"{folder}-checkpoint", max_files=3).awaitTermination()
    return State(spark, f"{folder}-state").results()


@query(_HITS + "SELECT archive, count(*) AS hits FROM hits GROUP BY archive")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per archive straight from the reader, in the mode that keeps what precedes damage."""
    _, uris = archives(spark, sf_dir, "scan")
    return scan_archives(spark, uris, mode="lenient").filter("record_idx >= 0").groupBy("archive").agg(F.count(F.lit(1)).alias("hits"))


def _stored_lines(spark: SparkSession, sf_dir: str, name: str, **options: str) -> str:
    """A text with an archive for each page, in order, among blanks; the folder of its file."""
    uri = F.concat(F.lit(" crawl/"), F.col("page_id").cast("string"), F.lit(".warc.gz\u3000"))
    lines = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(F.array(uri, F.lit(""), F.lit("\t ")))).toDF("page_id", "k", "value")
    folder = scratch_dir(spark, name)
    lines.coalesce(1).sortWithinPartitions("page_id", "k").select("value").write.options(**options).text(folder)
    return folder


_NUMBERED = "SELECT CAST(row_number() OVER (ORDER BY page_id) AS INTEGER) AS idx, concat('crawl/', page_id, '.warc.gz') AS uri FROM pages"


@query(_NUMBERED)
def paths_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain paths list: lines trimmed, blanks dropped, numbered in their order."""
    return read_paths(spark, _stored_lines(spark, sf_dir, "paths"))


@query(_NUMBERED)
def paths_scan_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_paths(spark, _stored_lines(spark, sf_dir, "paths-gz", compression="gzip"))


@query("SELECT concat('crawl/', page_id, '.warc.gz') AS filename FROM pages")
def processed_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with blanks, written twice over: each name once."""
    folder = _stored_lines(spark, sf_dir, "log")
    spark.read.text(folder).write.text(f"{folder}/again")
    return read_processed_log(spark, f"{folder}/{{*.txt,again/*.txt}}")


@query("SELECT page_id, concat('https://data.example.org/', 'crawl/', page_id, '.warc.gz') AS url FROM pages")
def archive_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("crawl/"), F.col("page_id").cast("string"), F.lit(".warc.gz"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", archive_url(uri, "https://data.example.org/").alias("url"))


# Boundaries by letters, marks and digits of any script; the SQL side has no look-around.
_EDGE = r"[^\pL\pM\pN_]"
_UNICODE = rf"(?:^|{_EDGE})((?:[a-z2-7]{{16}}|[a-z2-7]{{56}})\.onion)(?:$|{_EDGE})"


@query(_HITS + f"SELECT archive, record_idx, unnest(regexp_extract_all(body, '{_UNICODE}', 1)) AS onion FROM resp")
def extract_unicode_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of any script next to a host join it, on text and on bytes alike."""
    records = responses(spark, sf_dir)
    by_text = extract_hosts(records, boundary="unicode").select("archive", "record_idx", "onion")
    by_bytes = extract_hosts(records.withColumn("body", F.encode("body", "UTF-8")), boundary="unicode").select("archive", "record_idx", "onion")
    return by_text.intersectAll(by_bytes)


_COUNTS = f"SELECT archive, CAST(sum(len(regexp_extract_all(body, '{_PATTERN}'))) AS BIGINT) AS a, CAST(sum(len(regexp_extract_all(body, '{_UNICODE}', 1))) AS BIGINT) AS u FROM resp GROUP BY archive"


@query(_HITS + f"SELECT s AS strategy, archive, CASE WHEN s IN ('baseline', 'bytes') THEN u ELSE a END AS hits FROM ({_COUNTS}), (VALUES ('baseline'), ('bytes'), ('memchr'), ('mmap')) AS t(s)")
def strategy_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every archive by each of the four ways to read."""
    _, uris = archives(spark, sf_dir, "strategies")

    def scan(strategy: str) -> DataFrame:
        mode, boundary = strategy_options(strategy)
        found = scan_archives(spark, uris, mode=mode, boundary=boundary).filter("record_idx >= 0")
        return found.groupBy(F.lit(strategy).alias("strategy"), "archive").agg(F.count(F.lit(1)).alias("hits"))

    return functools.reduce(DataFrame.unionByName, map(scan, STRATEGIES))


@query(_HITS + "SELECT archive, count(*) AS records FROM resp GROUP BY archive")
def tolerant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to read that passes over bad records: what follows a line that is no text, and what precedes damage."""
    _, uris = archives(spark, sf_dir, "tolerant")
    _change(uris, "SEG-00001.warc.gz", lambda b: gzip_member(b"\xff\xfe\n") + b)
    _change(uris, "SEG-00003.warc.gz", lambda b: b + _claiming(2**64 - 1))
    _change(uris, "SEG-00005.warc.gz", lambda b: b + gzip_member(b"WARC/1.0\r\n")[:-9])
    return read_warc(spark, uris, mode="skip_bad_records").filter("record_idx >= 0").groupBy("archive").agg(F.count(F.lit(1)).alias("records"))


_BYTES = {1: f"FF{_V2.encode().hex()}2E6F6E696F6EFE", 2: f"C3A9{_V2.encode().hex()}2E6F6E696F6E", 3: f"00{_V2.encode().hex()}2E6F6E696F6E8090", 4: f"{_V2.encode().hex()}2E6F6E696F6EC3"}


@query(f"SELECT * FROM (VALUES (1, 'ascii', '{_V2}.onion'), (2, 'ascii', '{_V2}.onion'), (3, 'ascii', '{_V2}.onion'), (4, 'ascii', '{_V2}.onion'), (1, 'unicode', '{_V2}.onion'), (3, 'unicode', '{_V2}.onion'), (4, 'unicode', '{_V2}.onion')) AS t(id, boundary, onion)")
def invalid_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8 next to a host are boundaries; a letter is one for the ASCII rule alone."""
    rows = spark.sql("SELECT * FROM (VALUES " + ", ".join(f"({k}, X'{b}')" for k, b in _BYTES.items()) + ") AS t(id, body)")
    found = [extract_hosts(rows, boundary=b).select("id", F.lit(b).alias("boundary"), "onion") for b in ("ascii", "unicode")]
    return found[0].unionByName(found[1])


@query(_HITS + "SELECT onion, url, date, archive FROM ded")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results as one JSON document, stored and read back."""
    folder = scratch_dir(spark, "json")
    S.json_document(S.nest_sources(deduped(spark, sf_dir))).coalesce(1).write.option("lineSep", "\n").text(folder)
    return read_json_results(spark, folder)


@query(_HITS + "SELECT CAST(to_json(struct_pack(onion := onion, sources := list(struct_pack(url := url, date := date, archive := archive) ORDER BY archive, url))) AS VARCHAR) AS value FROM ded GROUP BY onion")
def json_lines_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.json_lines(S.nest_sources(deduped(spark, sf_dir)))


@query(_HITS + "SELECT onion, url, date, archive FROM ded")
def fetched_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task fetches its archive; one that is not there leaves the others alone."""
    folder, uris = archives(spark, sf_dir, "fetched")
    names = [u.rpartition("/")[2] for u in uris]
    run_batch(spark, paths_of(spark, [names[0], "missing.warc.gz", *names[1:]]), f"{folder}-state", base_url=f"{folder}/", folder=f"{folder}-kept")
    return State(spark, f"{folder}-state").results()


@query(_HITS + "SELECT DISTINCT archive FROM crawl WHERE archive = 'SEG-00003.warc.gz'")
def deleted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that are left when a run deletes those whose results are stored: the one that failed."""
    folder, uris = archives(spark, sf_dir, "deleted")
    _change(uris, "SEG-00003.warc.gz", lambda b: b[: len(b) * 2 // 3])
    run_batch(spark, paths_of(spark, uris), f"{folder}-state", delete=True)
    return spark.createDataFrame([(u.rpartition("/")[2],) for u in _listing(folder)], "archive string")


@query(_HITS + "SELECT onion, url, CASE WHEN archive = 'SEG-00000.warc.gz' THEN 'earlier' ELSE date END AS date, archive FROM ded")
def imported_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier results and a log from files, then a run over the rest."""
    folder, uris = archives(spark, sf_dir, "imported")
    earlier = deduped(spark, sf_dir).filter("archive = 'SEG-00000.warc.gz'").withColumn("date", F.lit("earlier"))
    S.json_document(S.nest_sources(earlier)).coalesce(1).write.text(f"{folder}-json")
    spark.createDataFrame([("SEG-00000.warc.gz",)], "value string").coalesce(1).write.text(f"{folder}-log")
    import_earlier(spark, f"{folder}-state", f"{folder}-json", f"{folder}-log")
    run_batch(spark, paths_of(spark, uris), f"{folder}-state")
    return State(spark, f"{folder}-state").results()
