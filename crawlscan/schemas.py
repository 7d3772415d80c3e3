"""Fixed schemas of the crawl engine."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "date", "archive")])
PATHS = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("uri", T.StringType())])
RESULTS = T.StructType([T.StructField(n, T.StringType()) for n in ("onion", "url", "date", "archive")])
RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("record_idx", T.LongType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("warc_date", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("error", T.StringType()),
        T.StructField("fetch_seconds", T.DoubleType()),
        T.StructField("read_seconds", T.DoubleType()),
    ]
)
JSON_MAP = "map<string,array<struct<url:string,date:string,archive:string>>>"
