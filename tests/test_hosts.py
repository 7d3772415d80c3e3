"""Host extraction against an independent byte-level oracle."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlscan.functions.hosts import digits_as_long, extract_hosts, filename, host_version
from crawlscan.queries import CASES

V2, V2B, V3 = "n4ow6uvt2ghy7zzq", "bb66cc77dd22ee33", "r3ts5x" * 9 + "ka"
ALPHABET = set(b"abcdefghijklmnopqrstuvwxyz234567")
WORD = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def oracle(body: bytes) -> list[str]:
    out, at = [], body.find(b".onion")
    while at >= 0:
        start = at
        while start and body[start - 1] in ALPHABET:
            start -= 1
        end = at + 6
        if at - start in (16, 56) and (start == 0 or body[start - 1] not in WORD) and (end == len(body) or body[end] not in WORD):
            out.append(body[start:end].decode())
        at = body.find(b".onion", end)
    return out


def extracted(spark, bodies, **options):
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate(bodies)], "id int, body binary")
    found = {k: [] for k in range(len(bodies))}
    for r in extract_hosts(df, **options).collect():
        found[r["id"]].append(r["onion"])
    return [found[k] for k in range(len(bodies))]


def test_cases_match_the_byte_oracle(spark):
    bodies = [c.encode() for c in CASES] + [b"\xff" + V2.encode() + b".onion", b"\x00\xff " + V2.encode() + b".onion \x80\x90", f"GET /\r\nX: {V3}.onion\r\n\r\n".encode()]
    assert extracted(spark, bodies) == [oracle(b) for b in bodies]


def test_expected_values(spark):
    got = extracted(spark, [f"a {V2}.onion b {V2B}.onion".encode(), f"{V3}.onion".encode(), f"{V2}.onions".encode(), b"", None])
    assert got == [[f"{V2}.onion", f"{V2B}.onion"], [f"{V3}.onion"], [], [], []]


def test_unicode_boundary(spark):
    bodies = [f"é{V2}.onion".encode(), f"{V2}.onioné".encode(), b"\xff" + f"{V2}.onion".encode(), f" {V2}.onion ".encode()]
    assert [len(x) for x in extracted(spark, bodies, boundary="unicode")] == [0, 0, 1, 1]
    assert [len(x) for x in extracted(spark, bodies, boundary="ascii")] == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        extracted(spark, bodies, boundary="none")


def test_random_bodies_match_the_byte_oracle(spark):
    pieces = st.sampled_from([V2, V3, V2B, ".onion", "onion", ".", " ", "_", "é", "s", "a", "/", "\n", "1", "2"])
    seen = []

    @settings(max_examples=200, deadline=None)
    @given(st.lists(pieces, max_size=8).map("".join))
    def collect(text):
        seen.append(text.encode())

    collect()
    assert extracted(spark, seen) == [oracle(b) for b in seen]


def test_extraction_plan_has_no_python_and_drops_the_body(spark):
    df = spark.createDataFrame([(1, bytearray(b"x"))], "id int, body binary")
    plan = extract_hosts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Generate" in plan and "Exchange" not in plan
    assert extract_hosts(df).columns == ["id", "onion"]


def test_helpers(spark):
    values = ["12345", "0", "  42  ", "-5", "12a3", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(digits_as_long(F.col("v"))).collect()] == [12345, 0, 42, 5, 123, 0, 0]
    df = spark.createDataFrame([("a/b/c.gz",), ("plain",), ("a/b/",)], "v string")
    assert [r[0] for r in df.select(filename(F.col("v"))).collect()] == ["c.gz", "plain", ""]
    df = spark.createDataFrame([(f"{V2}.onion",), (f"{V3}.onion",)], "v string")
    assert [r[0] for r in df.select(host_version(F.col("v"))).collect()] == [2, 3]
