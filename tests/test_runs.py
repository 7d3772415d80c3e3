"""Planning, deduplication, merging, state, batch and streaming runs."""

import functools
import gzip
import http.server
import json
import os
import re
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from crawlscan.operators import sources as S
from crawlscan.plans import local
from crawlscan.plans.batch import import_earlier, run_batch, strategy_options
from crawlscan.plans.work import paths_of, read_paths, skip_count, work_list
from crawlscan.sources import state as state_module
from crawlscan.sources.fetch import fetch
from crawlscan.sources.state import State, read_json_results, read_processed_log
from crawlscan.sources.warc_format import format_record
from crawlscan.streaming.ingest import ingest

HOSTS = [c * 16 + ".onion" for c in "abcde"]


def simulate(uris, done, limit):
    work, skipped = [], 0
    for k, u in enumerate(uris, 1):
        if u.rpartition("/")[2] in done:
            skipped += 1
            continue
        if limit is not None and len(work) >= limit:
            break
        work.append((k, u))
    return work, skipped


@pytest.mark.parametrize("limit", [None, 0, 1, 3, 100])
def test_work_list_equals_a_direct_scan(spark, limit):
    uris = [f"p/{k % 9}/{k}.gz" for k in range(12)] + ["q/3.gz", "r/5.gz", "p/5.gz"]
    done = {"0.gz", "3.gz", "7.gz", "8.gz"}
    processed = spark.createDataFrame([(d,) for d in done], "filename string")
    work, skipped = simulate(uris, done, limit)
    assert [(r["idx"], r["uri"]) for r in work_list(paths_of(spark, uris), processed, limit).orderBy("idx").collect()] == work
    assert skip_count(paths_of(spark, uris), processed, limit).first()[0] == skipped


def test_paths_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a/1.gz\n\n  b/2.gz  \n\t\n c\n")
    with open(tmp_path / "p.txt.gz", "wb") as f:
        f.write(gzip.compress(b"a/1.gz\n") + gzip.compress(b"b/2.gz\n"))
    assert [tuple(r) for r in read_paths(spark, str(tmp_path / "p.txt")).orderBy("idx").collect()][:2] == [(1, "a/1.gz"), (2, "b/2.gz")]
    assert [r["uri"] for r in read_paths(spark, str(tmp_path / "p.txt.gz")).orderBy("idx").collect()] == ["a/1.gz", "b/2.gz"]
    (tmp_path / "none.txt").write_text("\n \n")
    with pytest.raises(ValueError):
        read_paths(spark, str(tmp_path / "none.txt"))


def test_first_date_wins_and_existing_wins(spark):
    rows = [("h", "u", "2025-02", "a", 5), ("h", "u", "2025-03", "a", 2), ("h", "u", None, "b", 1), ("h", "u", "2025-01", "b", 3)]
    got = S.dedupe_sources(spark.createDataFrame(rows, "onion string, url string, date string, archive string, record_idx long"))
    assert sorted((r["archive"], r["date"]) for r in got.collect()) == [("a", "2025-03"), ("b", None)]
    old = spark.createDataFrame([("h", "u", "old", "a")], "onion string, url string, date string, archive string")
    merged = S.merge_sources(old, got)
    assert sorted((r["archive"], r["date"]) for r in merged.collect()) == [("a", "old"), ("b", None)]
    assert [r["archive"] for r in S.new_sources(got, old).collect()] == ["b"]


def test_json_round_trip(spark, tmp_path):
    rows = [("h1", "u2", "d", "a2"), ("h1", "u1", "d", "a1"), ("h2", "u", "d", "a")]
    nested = S.nest_sources(spark.createDataFrame(rows, "onion string, url string, date string, archive string"))
    text = S.json_document(nested).first()["value"]
    assert json.loads(text) == {"h1": [{"url": "u1", "date": "d", "archive": "a1"}, {"url": "u2", "date": "d", "archive": "a2"}], "h2": [{"url": "u", "date": "d", "archive": "a"}]}
    assert len(S.json_lines(nested).collect()) == 2
    (tmp_path / "r.json").write_text(text)
    assert sorted(map(tuple, read_json_results(spark, str(tmp_path / "r.json")).collect())) == sorted(rows)
    for bad in ('["h1", "h2"]', "{not json", ""):
        (tmp_path / "bad.json").write_text(bad)
        assert read_json_results(spark, str(tmp_path / "bad.json")).count() == 0
    assert read_json_results(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "log").write_text("a\n\n b \na\n")
    assert sorted(r[0] for r in read_processed_log(spark, str(tmp_path / "log")).collect()) == ["a", "b"]
    assert read_processed_log(spark, str(tmp_path / "no-log")).count() == 0


def archive(folder, name, bodies, cut=0):
    data = gzip.compress(b"".join(format_record("response", b.encode(), f"https://s/{k}", f"2025-0{k + 1}") for k, b in enumerate(bodies)))
    path = folder / name
    path.write_bytes(data[: len(data) - cut])
    return str(path)


def test_runs_resume_and_isolate_failures(spark, tmp_path):
    one = archive(tmp_path, "1.warc.gz", [f"{HOSTS[0]} {HOSTS[0]}", HOSTS[1]])
    two = archive(tmp_path, "2.warc.gz", [HOSTS[2]], cut=12)
    three = archive(tmp_path, "3.warc.gz", [HOSTS[0], "nothing"])
    paths, state = paths_of(spark, [one, two, three, str(tmp_path) + "/"]), str(tmp_path / "state")
    first = run_batch(spark, paths, state, limit=2).first()
    assert (first["processed"], first["failed"], first["hosts_new"], first["sources_new"]) == (1, 1, 2, 2)
    assert sorted(r[0] for r in State(spark, state).processed().collect()) == ["1.warc.gz"]
    archive(tmp_path, "2.warc.gz", [HOSTS[2]])  # whole now
    second = run_batch(spark, paths, state).first()
    assert (second["processed"], second["skipped"], second["failed"], second["hosts_before"], second["hosts_new"], second["hosts_total"], second["sources_new"]) == (2, 1, 1, 2, 1, 3, 2)
    assert State(spark, state).results().count() == 4
    third = run_batch(spark, paths, state, delete=True).first()
    assert (third["processed"], third["skipped"]) == (0, 3)


def test_results_without_a_manifest_are_not_seen(spark, tmp_path):
    state = State(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("h", "u", "d", "a")], "onion string, url string, date string, archive string")
    rows.write.parquet(f"{state.path}/results/gen=1")
    assert state.results().count() == 0
    state.commit(rows, spark.createDataFrame([("a",)], "filename string"))
    assert state.results().count() == 1 and state.processed().count() == 1
    state.commit(rows.withColumn("date", F.lit("later")), spark.createDataFrame([("a",)], "filename string"))
    assert [r["date"] for r in state.results().collect()] == ["d"]


def test_delete_after_commit(spark, tmp_path):
    one, bad = archive(tmp_path, "1.warc.gz", [HOSTS[0]]), archive(tmp_path, "2.warc.gz", [HOSTS[1]], cut=12)
    run_batch(spark, paths_of(spark, [one, bad]), str(tmp_path / "state"), delete=True)
    assert not (tmp_path / "1.warc.gz").exists() and (tmp_path / "2.warc.gz").exists()


def test_streaming_replays_add_nothing(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for k in range(4):
        archive(feed, f"{k}.warc.gz", [HOSTS[k]])
    for checkpoint in ("c1", "c2"):  # the second sees every file again
        ingest(spark, str(feed), str(tmp_path / "state"), str(tmp_path / checkpoint), max_files=2).awaitTermination()
        assert State(spark, str(tmp_path / "state")).results().count() == 4


def test_strategies():
    assert strategy_options("memchr") == ("fail_archive", "ascii")
    with pytest.warns(UserWarning):
        assert strategy_options("mmap", stream=True) == ("lenient", "ascii")
    with pytest.raises(ValueError):
        strategy_options("other")


def test_fetch(tmp_path):
    (tmp_path / "from").mkdir()
    (tmp_path / "from" / "a.gz").write_bytes(b"data")
    base = f"file://{tmp_path}/from/"
    path, fresh = fetch("a.gz", base_url=base, folder=str(tmp_path / "to"))
    assert fresh and open(path, "rb").read() == b"data"
    assert fetch("a.gz", base_url=base, folder=str(tmp_path / "to")) == (path, False)
    with pytest.raises(OSError):
        fetch("b.gz", base_url=base, folder=str(tmp_path / "to"))
    assert sorted(p.name for p in (tmp_path / "to").iterdir()) == ["a.gz"]


@pytest.fixture(scope="module")
def web(tmp_path_factory):
    """A web server on this machine over a folder."""
    root = tmp_path_factory.mktemp("web")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(root))
    handler.log_message = lambda *_: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        yield root, f"http://127.0.0.1:{server.server_port}/"
        server.shutdown()


@pytest.mark.parametrize("stream", [False, True])
def test_archives_come_over_http_each_by_its_task(spark, tmp_path, web, stream):
    """One that is not there, and one that is damaged, leave the others alone."""
    root, base = web
    for k in range(3):
        archive(root, f"{k}.warc.gz", [HOSTS[k]], cut=12 * (k == 2))
    paths = paths_of(spark, ["0.warc.gz", "none.warc.gz", "1.warc.gz", "2.warc.gz"])
    options = {"resolve": lambda uri: base + uri} if stream else {"base_url": base, "folder": str(tmp_path / "kept")}
    row = run_batch(spark, paths, str(tmp_path / "state"), **options).first()
    assert (row["processed"], row["failed"], row["hosts_new"], row["records"]) == (2, 2, 2, 2)
    assert row["read_seconds"] > 0 and row["mean_read_seconds"] == row["read_seconds"] / 2 and (row["fetch_seconds"] > 0) == (not stream)
    assert sorted(r[0] for r in State(spark, str(tmp_path / "state")).processed().collect()) == ["0.warc.gz", "1.warc.gz"]
    if not stream:
        assert sorted(p.name for p in (tmp_path / "kept").iterdir()) == ["0.warc.gz", "1.warc.gz", "2.warc.gz"]


def test_earlier_results_and_logs_are_imported(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({HOSTS[0]: [{"url": "u", "date": "old", "archive": "1.warc.gz"}]}))
    (tmp_path / "log").write_text("0.warc.gz\n")
    state = str(tmp_path / "state")
    assert import_earlier(spark, state, str(tmp_path / "r.json"), str(tmp_path / "log"))[1:] == (1, 1, 0)
    uris = [archive(tmp_path, f"{k}.warc.gz", [HOSTS[k - 1]]) for k in (0, 1)]
    row = run_batch(spark, paths_of(spark, uris), state).first()  # the archive that the results alone name is read
    assert (row["processed"], row["skipped"], row["hosts_before"], row["hosts_new"], row["sources_new"]) == (1, 1, 1, 0, 1)
    assert sorted((r["url"], r["date"]) for r in State(spark, state).results().collect()) == [("https://s/0", "2025-01"), ("u", "old")]


def test_compaction_keeps_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_module, "COMPACT_AT", 3)
    state = State(spark, str(tmp_path / "s"))
    for k in range(7):
        rows = spark.createDataFrame([(HOSTS[k % 5], "u", f"d{k}", f"a{k}"), (HOSTS[0], "u", f"d{k}", "a0")], "onion string, url string, date string, archive string")
        done = state.commit(rows.dropDuplicates(["onion", "url", "archive"]), spark.createDataFrame([(f"a{k}",), ("a0",)], "filename string"))
        assert done.hosts_before + done.hosts_new == state.hosts_total() == min(k + 1, 5) == state.hosts().count()
        assert len(state._parts()) < 3
    assert state.processed().count() == 7
    assert sorted((r["archive"], r["date"]) for r in state.results().collect()) == [(f"a{k}", f"d{k}") for k in range(7)]
    assert {p.name for p in (tmp_path / "s" / "results").iterdir()} == set(state._parts())


def test_jobs_of_one_machine(tmp_path):
    cores = local.core_count()
    assert cores >= 1 and local.local_jobs() == cores and local.local_jobs(1) == local.local_jobs(0) == 1
    with pytest.warns(UserWarning, match="cores"):
        assert local.local_jobs(5 * cores) == 2 * cores
    with pytest.warns(UserWarning, match="memory"):
        assert local.local_jobs(cores + 1, local.JOB_BYTES) == 1
    (tmp_path / "meminfo").write_text("MemTotal: 9 kB\nMemAvailable:    2048 kB\n")
    assert local.available_memory(str(tmp_path / "meminfo")) == 2 << 20 and local.available_memory(str(tmp_path / "none")) is None


def test_command_line(tmp_path):
    """A whole run in a shell: earlier results, a damaged archive, the JSON document."""
    for k in range(3):
        archive(tmp_path, f"{k}.warc.gz", [HOSTS[k]], cut=12 * (k == 2))
    (tmp_path / "paths.txt").write_text("x/0.warc.gz\nx/1.warc.gz\nx/2.warc.gz\n")
    (tmp_path / "log").write_text("1.warc.gz\n")
    command = [sys.executable, "-m", "crawlscan", str(tmp_path / "paths.txt"), "--base-url", f"file://{tmp_path}/", "--archives", str(tmp_path / "x"), "--state", str(tmp_path / "state")]
    (tmp_path / "x").mkdir()
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").rename(tmp_path / "x" / f"{k}.warc.gz")
    done = subprocess.run([*command, "-j", "2", "--json", str(tmp_path / "out.json"), "--import-log", str(tmp_path / "log")], capture_output=True, text=True, timeout=200, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads((tmp_path / "out.json").read_text()) == {HOSTS[0]: [{"url": "https://s/0", "date": "2025-01", "archive": "0.warc.gz"}]}
    assert re.search(r"processed\s*\| 1 ", done.stdout) and re.search(r"skipped\s*\| 1 ", done.stdout) and re.search(r"failed\s*\| 1 ", done.stdout)
