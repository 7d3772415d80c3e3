"""Sources of hosts: first-wins deduplication, merging, nesting and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["onion", "url", "archive"]


def as_sources(hits: DataFrame) -> DataFrame:
    """(onion, url, date, archive, record_idx) of hits with the names of the record schema."""
    return hits.select("onion", F.col("target_uri").alias("url"), F.col("warc_date").alias("date"), "archive", "record_idx")


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """One row per (onion, url, archive); the date of the first record wins.

    A minimum by record number is exact and combines before the shuffle, which ``dropDuplicates`` with
    its arbitrary survivor is not.  Null dates lose to no one: the first record's date counts, null or not.
    """
    first = F.min(F.struct("record_idx", "date"))
    return sources.groupBy(*KEY).agg(first.alias("first")).select("onion", "url", F.col("first.date").alias("date"), "archive")


def new_sources(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Deduplicated sources whose key is not among ``existing``."""
    return sources.join(existing.select(*KEY), KEY, "left_anti").select("onion", "url", "date", "archive")


def merge_sources(existing: DataFrame, sources: DataFrame) -> DataFrame:
    """Existing sources, with their dates, and the new ones."""
    columns = ["onion", "url", "date", "archive"]
    both = existing.select(*columns, F.lit(0).alias("gen")).unionByName(sources.select(*columns, F.lit(1).alias("gen")))
    return both.groupBy(*KEY).agg(F.min_by("date", "gen").alias("date")).select(*columns)


def nest_sources(sources: DataFrame) -> DataFrame:
    """(onion, sources): the sources of each host as an array sorted by archive and url."""
    ordered = F.array_sort(F.collect_list(F.struct("archive", "url", "date")))
    return sources.groupBy("onion").agg(F.transform(ordered, lambda s: F.struct(s["url"].alias("url"), s["date"].alias("date"), s["archive"].alias("archive"))).alias("sources"))


def json_lines(nested: DataFrame) -> DataFrame:
    """One JSON text per host: the form for results of any size."""
    return nested.select(F.to_json(F.struct("onion", "sources")).alias("value"))


def json_document(nested: DataFrame, *, pretty: bool = True) -> DataFrame:
    """All hosts as one JSON object, in one row: for results that fit into one."""
    entries = F.array_sort(F.collect_list(F.struct("onion", "sources")))
    return nested.agg(F.to_json(F.map_from_entries(entries), {"pretty": "true" if pretty else "false"}).alias("value"))


def hosts_per_archive(sources: DataFrame) -> DataFrame:
    return sources.groupBy("archive").agg(F.countDistinct("onion").alias("hosts"))


def new_hosts_by_archive(sources: DataFrame) -> DataFrame:
    """How many hosts each archive shows first, archives in the order of their names."""
    return sources.groupBy("onion").agg(F.min("archive").alias("archive")).groupBy("archive").agg(F.count(F.lit(1)).alias("new_hosts"))


def total_hosts(sources: DataFrame) -> DataFrame:
    return sources.agg(F.countDistinct("onion").alias("hosts"))


def new_hosts(sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct hosts that ``existing`` does not have."""
    return sources.select("onion").distinct().join(existing.select("onion").distinct(), "onion", "left_anti")
