"""Command line: process a paths list into a state folder and print the summary."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from crawlscan.operators.sources import json_document, nest_sources
from crawlscan.plans.batch import DISK_ONLY, STRATEGIES, import_earlier, run_batch, strategy_options
from crawlscan.plans.local import available_memory, local_jobs
from crawlscan.plans.work import read_paths
from crawlscan.sources.state import State


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="crawlscan", description=__doc__)
    p.add_argument("input", help="paths list, plain or .gz")
    p.add_argument("-l", "--limit", type=int, help="process so many archives at most")
    p.add_argument("-j", "--jobs", type=int, help="archives read at once on this machine, by default one a core (a cluster has its own setting)")
    p.add_argument("-d", "--delete", action="store_true", help="delete archives once their results are stored")
    p.add_argument("-s", "--strategy", choices=sorted(STRATEGIES), default="memchr")
    p.add_argument("-m", "--stream", action="store_true", help="with --base-url, read archives over the network and keep none")
    p.add_argument("--state", default="state", help="state folder")
    p.add_argument("--archives", default=".", help="folder or URI prefix of the archives")
    p.add_argument("--base-url", help="where listed archives are; each task downloads its own")
    p.add_argument("--import-json", help="add the results of this JSON document to the state first")
    p.add_argument("--import-log", help="mark the archives of this text log as processed first")
    p.add_argument("--json", help="also write all results as one JSON document to this file")
    a = p.parse_args(argv)
    builder = SparkSession.builder.appName("crawlscan").config("spark.ui.showConsoleProgress", "true")
    spark = (builder.master(f"local[{local_jobs(a.jobs, available_memory())}]") if a.jobs is not None else builder).getOrCreate()
    mode, boundary = strategy_options(a.strategy, a.stream)
    options: dict = {"resolve": lambda uri: uri if "://" in uri or os.path.isabs(uri) else f"{a.archives.rstrip('/')}/{uri}"}
    if a.base_url:
        streams = a.stream and a.strategy not in DISK_ONLY
        options = {"resolve": lambda uri: a.base_url + uri} if streams else {"base_url": a.base_url, "folder": os.path.abspath(a.archives) if "://" not in a.archives else a.archives}
    if a.import_json or a.import_log:
        import_earlier(spark, a.state, a.import_json, a.import_log)
    run_batch(spark, read_paths(spark, a.input), a.state, limit=a.limit, mode=mode, boundary=boundary, delete=a.delete and not (a.base_url and a.stream), **options).show(vertical=True, truncate=False)
    if a.json:
        text = json_document(nest_sources(State(spark, a.state).results())).first()["value"]
        with open(f"{a.json}.part", "w", encoding="utf-8") as out:
            out.write(text)
        os.replace(f"{a.json}.part", a.json)


if __name__ == "__main__":
    main()
