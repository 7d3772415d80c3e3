"""WARC framing, reader and writer."""

import gzip
import io
import json
import random
import zlib

import pytest

from crawlscan.sources import warc, warc_format
from crawlscan.sources.warc import read_warc, write_warc
from crawlscan.sources.warc_format import BadArchive, format_record, header_number, read_lenient, read_stream


def stream(data):
    return list(read_stream(io.BufferedReader(io.BytesIO(data))))


def lenient(data):
    return list(read_lenient(io.BytesIO(data)))


def sample():
    """Records of several types; the second response names the marker of a record inside its body."""
    return b"".join(
        [
            format_record("metadata", b"made: by hand"),
            format_record("response", b"HTTP/1.0 404 Gone\r\n\r\nalpha", "ftp://one.test/a", "1999-12-31T23:59:59Z"),
            format_record("request", b"HEAD /b", "ftp://two.test/b"),
            format_record("RESPONSE", b"beta WARC/1.0 within", "ftp://two.test/b", "2000-01-01T00:00:00Z"),
            format_record("revisit", b""),
        ]
    )


def test_both_parsers_give_the_responses():
    got = stream(sample())
    assert [(r.target_uri, r.warc_date) for r in got] == [("ftp://one.test/a", "1999-12-31T23:59:59Z"), ("ftp://two.test/b", "2000-01-01T00:00:00Z")]
    assert got[1].body == b"beta WARC/1.0 within"
    assert [r.body for r in lenient(sample())] == [r.body for r in got]


def test_framing_rules():
    assert stream(format_record("response", b"")) == []
    assert [r.body for r in stream(b"warc-type: x\nWARC/1.0\nwarc-type: RESPONSE\ncontent-length: 5\n\nhello\n\n")] == [b"hello"]
    assert [r.content_length for r in stream(b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Type: response\r\nContent-Length: 9\r\nContent-Length: 2\r\n\r\nab")] == [2]
    only = stream(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: -5\r\n\r\nhello")[0]
    assert (only.target_uri, only.warc_date, only.body) == ("", "", b"hello")
    assert stream(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5") == []
    assert stream(b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 50\r\n\r\nshort") == []
    assert [header_number(v) for v in (b"12345", b"0", b"  42  ", b"-5", b"12a3", b"")] == [12345, 0, 42, 5, 123, 0]


def test_damage():
    cut = format_record("response", b"whole") + format_record("response", b"cut short")[:-8]
    with pytest.raises(BadArchive):
        stream(cut)
    assert [r.body for r in lenient(cut)] == [b"whole"]
    with pytest.raises(BadArchive):
        stream(b"WARC/1.0\r\nWARC-Type: response\r\nX: \xff\r\nContent-Length: 1\r\n\r\na")
    assert [r.body for r in lenient(b"WARC/1.0\r\nWARC-Type: response\r\nX: \xff\r\nContent-Length: 1\r\n\r\na")] == [b"a"]
    assert [r.body for r in lenient(b"WARC/1.0\nWARC-Type: response\nContent-Length: 1\n\na")] == []


def test_reader_reports_failures_and_keeps_going(spark, tmp_path):
    whole, cut, plain, missing = (str(tmp_path / n) for n in ("a.warc.gz", "b.warc.gz", "c.warc", "gone.warc.gz"))
    members = [gzip.compress(sample()), gzip.compress(sample())]  # two members in a file
    with open(whole, "wb") as f:
        f.write(b"".join(members))
    with open(cut, "wb") as f:
        f.write(members[0] + members[1][: len(members[1]) // 2])
    with open(plain, "wb") as f:
        f.write(sample())
    rows = read_warc(spark, [whole, cut, plain, missing]).collect()
    status = {r["archive"]: r for r in rows if r["record_idx"] == -1}
    assert status["a.warc.gz"]["error"] is None and status["a.warc.gz"]["content_length"] == 4
    assert status["c.warc"]["error"] is None and status["c.warc"]["content_length"] == 2
    assert status["b.warc.gz"]["error"] and status["gone.warc.gz"]["error"]
    by_format = spark.read.format("warc").option("archives", json.dumps([whole, cut, plain])).load()
    key = lambda r: (r["archive"], r["record_idx"], bytes(r["body"] or b""))
    assert sorted(map(key, by_format.collect())) == sorted(key(r) for r in rows if r["archive"] != "gone.warc.gz")
    every = read_warc(spark, [plain], types="all", include_body=False).filter("record_idx >= 0").collect()
    assert [r["warc_type"] for r in every] == ["metadata", "response", "request", "RESPONSE", "revisit"] and all(r["body"] is None for r in every)
    with pytest.raises(Exception, match="mode"):
        read_warc(spark, [plain], mode="other").collect()


LENGTHS = (999_999_999_999_999, (1 << 63) + 5, (1 << 64) - 1, 1 << 31)


@pytest.mark.parametrize("length", LENGTHS)
@pytest.mark.parametrize("kind", [b"response", b"request"])
def test_lengths_that_are_not_there(kind, length):
    head = b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: " + str(length).encode() + b"\r\n\r\nabc"
    data = format_record("response", b"first") + head
    if kind == b"response" or length >> 63:
        with pytest.raises(BadArchive):
            stream(data)
    assert [r.body for r in read_stream(io.BufferedReader(io.BytesIO(data)), tolerant=True)] == [b"first"]
    assert [r.body for r in lenient(data)] == [b"first"]


def test_lines_without_end_take_no_memory(monkeypatch):
    monkeypatch.setattr(warc_format, "LINE", 64)
    data = b"x" * 64 + b"WARC/1.0" + b"\xc3\xa9" * 50 + b"\r\n" + sample()
    assert len(stream(data)) == 2
    with pytest.raises(BadArchive):
        stream(b"y" * 90 + b"\xff\n" + sample())


def test_gunzip_equals_the_library(monkeypatch):
    rng = random.Random(3)
    for chunk in (1, 7, 1 << 16):
        monkeypatch.setattr(warc_format, "GZIP_CHUNK", chunk)
        for _ in range(20):
            parts = [rng.randbytes(rng.choice([0, 1, 50, 3000])) for _ in range(rng.randrange(4))]
            data = b"".join(gzip.compress(p) + b"\0" * rng.choice([0, 0, 9]) for p in parts)
            assert io.BufferedReader(warc_format.Gunzip(io.BytesIO(data)), 64).read() == b"".join(parts)
            if parts:
                with pytest.raises(EOFError):
                    io.BufferedReader(warc_format.Gunzip(io.BytesIO(gzip.compress(b"abc" * 99)[:-1])), 64).read()
    with pytest.raises(zlib.error):
        io.BufferedReader(warc_format.Gunzip(io.BytesIO(b"no gzip"))).read()


def test_a_window_slides_over_the_stream(monkeypatch):
    monkeypatch.setattr(warc_format, "CHUNK", 3)
    got = lenient(b"WARC" + b"noise " * 9 + sample() * 3)
    assert [r.body for r in got] == [r.body for r in stream(sample())] * 3
    assert [r.content_length for r in read_lenient(io.BytesIO(sample()), every_type=True, with_body=False)] == [13, 26, 7, 20, 0]


@pytest.mark.parametrize("mode", warc.MODES)
def test_damaged_archives_end_with_a_status(tmp_path, mode):
    """Flipped bytes anywhere, and every cut: a status row comes last, and rows before it are records of the archive."""
    rng, whole = random.Random(1), gzip.compress(sample()) + gzip.compress(sample())
    bodies = {r.body for r in stream(sample())}
    for k in range(120):
        data = bytearray(whole)
        if k % 3 == 0:
            del data[rng.randrange(len(data)) :]
        for _ in range(k % 3):
            data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        (tmp_path / f"{k}.warc.gz").write_bytes(data)
        reader = warc.WarcReader({"path": str(tmp_path / f"{k}.warc.gz"), "mode": mode})
        rows = [r for batch in reader.read(reader.partitions()[0]) for r in batch.to_pylist()]
        assert [r["record_idx"] for r in rows] == [*range(len(rows) - 1), -1] and rows[-1]["content_length"] == len(rows) - 1
        assert rows[-1]["error"] or mode == "skip_bad_records" or {r["body"] for r in rows[:-1]} <= bodies
        if mode == "skip_bad_records" and k % 3 == 0:
            assert rows[-1]["error"] is None and {r["body"] for r in rows[:-1]} <= bodies


def test_a_record_that_cannot_be_read_is_skipped():
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nX-\xff: y\r\nContent-Length: 3\r\n\r\nbad\r\n\r\n"
    data = format_record("response", b"one") + bad + format_record("response", b"two")
    assert [r.body for r in read_stream(io.BufferedReader(io.BytesIO(data)), tolerant=True)] == [b"one", b"bad", b"two"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = [("a.warc", 0, "response", "u", "d", bytearray(b"x")), ("no/such/folder.warc", 1, "response", "u", "d", bytearray(b"y"))]
    df = spark.createDataFrame(rows, "archive string, record_idx long, warc_type string, target_uri string, warc_date string, body binary")
    with pytest.raises(Exception, match="folder"):
        write_warc(df, str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())


def test_written_archives_read_back(spark, tmp_path):
    data = [("x.warc.gz", k, "response" if k % 2 else "request", f"u{k}", f"d{k}", bytearray(f"body {k}".encode())) for k in range(20)]
    df = spark.createDataFrame(data + [("y.warc.gz", 0, "response", None, None, bytearray(b"\xff\x00"))], "archive string, record_idx long, warc_type string, target_uri string, warc_date string, body binary")
    write_warc(df, str(tmp_path / "out"))
    back = read_warc(spark, [str(tmp_path / "out" / n) for n in ("x.warc.gz", "y.warc.gz")]).filter("record_idx >= 0").collect()
    assert sorted((r["archive"], r["target_uri"], bytes(r["body"])) for r in back) == sorted([("x.warc.gz", f"u{k}", f"body {k}".encode()) for k in range(1, 20, 2)] + [("y.warc.gz", "", b"\xff\x00")])
    shaped = df.selectExpr("archive", "record_idx", "warc_type", "target_uri", "warc_date", "octet_length(body) AS content_length", "body", "CAST(NULL AS STRING) AS error")
    shaped.coalesce(1).sortWithinPartitions("archive", "record_idx").write.format("warc").mode("append").save(str(tmp_path / "by-format"))
    for name in ("x.warc.gz", "y.warc.gz"):
        assert (tmp_path / "by-format" / name).read_bytes() == (tmp_path / "out" / name).read_bytes()
