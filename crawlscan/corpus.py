"""A deterministic crawl derived from the ``pages`` table, for queries and tests; the same SQL in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CRAWL = """
SELECT page_id AS record_idx,
  concat('SEG-', lpad(cast(page_id % 7 AS {S}), 5, '0'), '.warc.gz') AS archive,
  CASE WHEN page_id % 5 = 0 THEN 'request' WHEN page_id % 5 = 1 THEN 'RESPONSE' ELSE 'response' END AS warc_type,
  concat('https://site', cast(page_id % 10 AS {S}), '.example.com/p') AS target_uri,
  concat('2025-10-01T00:', lpad(cast(page_id % 47 AS {S}), 2, '0'), ':00Z') AS warc_date,
  concat(html, ' http://', substr(translate(md5(cast(page_id % 20 AS {S})), '0189', 'ghij'), 1, 16),
    CASE page_id % 6 WHEN 0 THEN '.onion/' WHEN 1 THEN '.onions' WHEN 2 THEN '.onioné' WHEN 3 THEN '.ONION' WHEN 4 THEN '.onion_' ELSE '.onion' END,
    CASE WHEN page_id % 3 = 0 THEN concat(' www.', substr(concat(translate(md5(target), '0189', 'ghij'), translate(md5(concat(target, 'x')), '0189', 'ghij')), 1, 56), '.onion')
      ELSE ' tooshort.onion' END) AS body
FROM (SELECT *, cast(page_id % 15 AS {S}) AS target FROM {T}) t
"""


def crawl_sql(*, duckdb: bool) -> str:
    """SELECT text of the crawl over the view ``pages``."""
    return _CRAWL.format(S="varchar" if duckdb else "string", T="pages" if duckdb else "{pages}")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_idx, archive, warc_type, target_uri, warc_date, body) from ``pages``."""
    return spark.sql(crawl_sql(duckdb=False), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))
