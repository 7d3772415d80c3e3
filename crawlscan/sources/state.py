"""State between runs: sources found so far and the manifest of finished archives.

A state folder holds generations.  A run writes its new sources as ``results/gen=N``, the hosts that it
shows first as ``hosts/gen=N`` and then its archives, with the number of all hosts, as ``manifest/gen=N``;
what belongs to a generation without a manifest is not visible.  So results always come first and a
crash leaves nothing half-done.  A run reads the earlier sources of its own archives only (an archive's
sources are in the generations that list it), and of the others the index of hosts.  After
``COMPACT_AT`` generations all are rewritten as one ``base=N``, which takes their place when its manifest
is there.  One writer at a time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscan.functions.hosts import trimmed
from crawlscan.operators.sources import new_sources
from crawlscan.schemas import JSON_MAP, RESULTS

MANIFEST = "filename string, finished boolean, hosts_total long"
HOSTS = "onion string"
TABLES = {"results": RESULTS, "hosts": HOSTS, "manifest": MANIFEST}
COMPACT_AT = 64


class Committed(NamedTuple):
    """What a run added, and the hosts before it."""

    generation: int
    sources_new: int
    hosts_new: int
    hosts_before: int


class State:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _parts(self) -> list[str]:
        """Folder names of the visible generations: the latest base, if any, and those after it."""
        fs, p = self._fs(f"{self.path}/manifest/*=*/_SUCCESS")
        found = [(int(n), kind) for kind, n in (s.getPath().getParent().getName().split("=") for s in fs.globStatus(p) or ())]
        base = max((n for n, kind in found if kind == "base"), default=-1)
        return [f"{kind}={n}" for n, kind in sorted(found) if n > base or (n, kind) == (base, "base")]

    def _read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/{part}" for part in (self._parts() if parts is None else parts)]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def _write(self, table: str, part: str, rows: DataFrame) -> int:
        at = f"{self.path}/{table}/{part}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(TABLES[table]).parquet(at).count()  # from the files' footers

    def results(self) -> DataFrame:
        """(onion, url, date, archive) of all committed runs; empty if there are none."""
        return self._read("results")

    def hosts(self) -> DataFrame:
        """(onion) of all committed runs, each once."""
        return self._read("hosts")

    def processed(self) -> DataFrame:
        """(filename) of finished archives."""
        return self._read("manifest").filter("finished").select("filename").distinct()

    def hosts_total(self) -> int:
        """Number of hosts of all committed runs."""
        parts = self._parts()
        return self._read("manifest", parts[-1:]).first()["hosts_total"] if parts else 0

    def commit(self, sources: DataFrame, finished: DataFrame, unfinished: DataFrame | None = None) -> Committed:
        """Add deduplicated ``sources`` that are not there yet, then mark ``finished`` (filename).

        Archives of ``sources`` that are not finished are in ``unfinished`` (filename); they will be read
        again.  Without an archive nothing is written.
        """
        parts = self._parts()
        before = self._read("manifest", parts[-1:]).first()["hosts_total"] if parts else 0
        names = finished.select("filename", F.lit(True).alias("finished"))
        if unfinished is not None:
            names = names.union(unfinished.select("filename", F.lit(False)))
        names = names.groupBy("filename").agg(F.max("finished").alias("finished"))
        if names.isEmpty():
            return Committed(0, 0, 0, before)
        gen = 1 + (int(parts[-1].partition("=")[2]) if parts else 0)
        listed = self._read("manifest", parts).withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2))
        again = {r["part"] for r in listed.join(names.select("filename"), "filename", "left_semi").select("part").distinct().collect()} if parts else set()
        known = self._read("results", [p for p in parts if p in again])
        added = self._write("results", f"gen={gen}", new_sources(sources, known))
        new = self.generation(gen).select("onion").distinct()
        if parts:  # what is met again is at most what the run adds, so the index is scanned where it lies
            new = new.join(self._read("hosts", parts).join(new, "onion", "left_semi"), "onion", "left_anti")
        fresh = self._write("hosts", f"gen={gen}", new)
        self._write("manifest", f"gen={gen}", names.withColumn("hosts_total", F.lit(before + fresh)).coalesce(1))
        if len(parts) + 1 >= COMPACT_AT:
            self.compact()
        return Committed(gen, added, fresh, before)

    def generation(self, gen: int) -> DataFrame:
        """Sources that one run added."""
        return self._read("results", [f"gen={gen}"])

    def compact(self) -> None:
        """Rewrite all generations as one.  A crash leaves either the old ones or the new one visible."""
        parts = self._parts()
        if len(parts) < 2:
            return
        base, total = f"base={parts[-1].partition('=')[2]}", self.hosts_total()
        for table in ("results", "hosts"):
            self._write(table, base, self._read(table, parts))
        self._write("manifest", base, self._read("manifest", parts).groupBy("filename").agg(F.max("finished").alias("finished")).withColumn("hosts_total", F.lit(total)))
        for part in parts:
            for table in ("manifest", "results", "hosts"):
                fs, p = self._fs(f"{self.path}/{table}/{part}")
                fs.delete(p, True)


def read_json_results(spark: SparkSession, path: str) -> DataFrame:
    """Sources from a JSON document {host: [{url, date, archive}]}; a missing, older or broken file is empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path):
        return spark.createDataFrame([], RESULTS)
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.explode(F.coalesce(F.from_json("value", JSON_MAP), F.create_map().cast(JSON_MAP))).alias("onion", "sources"))
    return found.select("onion", F.explode("sources").alias("s")).select("onion", "s.url", "s.date", "s.archive")


def read_processed_log(spark: SparkSession, path: str) -> DataFrame:
    """(filename) from a text log: trimmed, blanks dropped; a missing file is empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path):
        return spark.createDataFrame([], "filename string")
    return spark.read.text(path).select(trimmed("value").alias("filename")).filter("filename <> ''").distinct()
