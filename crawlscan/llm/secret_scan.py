"""Secret scanning: three fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of token characters of at least ``WINDOW``, less what fixed-pattern spans cover.
Within it each character class (hex digits, letters and digits, the same in one case, base64) has its
own runs, and a window slides over each run with incremental counts: one character enters, one leaves,
and the sum of c * log2(c) changes by a table lookup.  Windows at or over the class's threshold merge
into spans, which count if they mix what the class asks for: digits with letters of both cases, or, in
one case, digits on both sides of letters (so words with a year or a number at one place do not count).
The allow-list passes over known harmless strings, and findings that are nothing else; a harmless part
before or after a secret does not hide it.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import by_bytes

# The base patterns with the length that a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: class -> (its runs, characters that a span must mix, bits per character that a window needs).
CLASSES = (
    (re.compile(r"[0-9A-Fa-f]{20,}"), (re.compile(r"[0-9]"), re.compile(r"[A-Fa-f]")), 3.2),
    (re.compile(r"[A-Za-z0-9]{20,}"), (re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")), 3.6),
    (re.compile(r"[A-Z0-9]{20,}"), (re.compile(r"[0-9][A-Z]+[0-9]"),), 3.3),
    (re.compile(r"[a-z0-9]{20,}"), (re.compile(r"[0-9][a-z]+[0-9]"),), 3.3),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), (re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")), 3.8),
)
#: Candidates that are passed over whole.
ALLOWED = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),  # UUID
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T?[0-9:-]*"),  # date
    re.compile(r"(?:[A-Za-z]+[-_/])+[A-Za-z]+"),  # words joined by marks
)
#: Parts of a finding that are no secret; it counts only if at least ``WINDOW`` characters remain without them.
HARMLESS = re.compile(
    r"example|sample|dummy|placeholder|changeme|redacted|lorem|x{4,}|0123456789|1234567890|abcdefghijklm(?:nopqrstuvwxyz)?|nopqrstuvwxyz|"
    + ALLOWED[0].pattern, re.IGNORECASE,
)
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # the new character enters before the old one leaves


def entropy_spans(run: str, threshold: float) -> list[tuple[int, int]]:
    """Merged windows of ``run`` with at least ``threshold`` bits per character."""
    limit = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9  # H = log2(W) - sum(c log2 c) / W
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= WINDOW:
            gone = run[i - WINDOW]
            n = counts[gone]
            total += _TERM[n - 1] - _TERM[n]
            counts[gone] = n - 1
        if i >= WINDOW - 1 and total <= limit:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _union(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _uncovered(first: int, last: int, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a range outside ``covered``, which are apart and in order."""
    k = bisect.bisect_right(covered, first, key=lambda c: c[1])
    while k < len(covered) and covered[k][0] < last:
        if covered[k][0] > first:
            yield first, covered[k][0]
        first = covered[k][1]
        k += 1
    if first < last:
        yield first, last


def _method_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    covered = _union([(a, b) for a, _, b in base])
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in ALLOWED):
            continue
        for first, last in _uncovered(m.start(), m.end(), covered):
            for runs, needs, threshold in CLASSES:
                for r in runs.finditer(text[first:last]):
                    found += [(first + r.start() + a, first + r.start() + b) for a, b in entropy_spans(r[0], threshold) if all(n.search(r[0], a, b) for n in needs)]
    return [(a, 3, b) for a, b in _union(found) if len(HARMLESS.sub("", text[a:b])) >= WINDOW]


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and further spans of a text as (start, kind number, end), in code points, ends exclusive.

    Cheap tests come first: a match of any kind but ``assign`` needs a run of 20 characters without
    white space, and ``assign`` needs a colon or an equals sign.
    """
    if not text:
        return [], []
    base: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if max(map(len, text.split()), default=0) < WINDOW:
        return sorted(base), []
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    return base, _method_spans(text, base)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every document.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.  Returns one row
    per input row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 (of the base spans as
    written) and spans (all of them).  Null and empty texts have no spans; repeated rows each get
    their row; no rows in, no rows out.  A long text takes time in proportion to its length, and memory
    for itself and its spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            counts, digests, lists = [], [], []
            for text in batch.column("text").to_pylist():
                base, more = spans(text)
                kinds = [k for _, k, _ in base]
                counts.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more)))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                lists.append(written(sorted(base + more)))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(lists, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    base, more = spans(text)
    if not base and not more:
        return text
    out, at = [], 0
    for a, _, b in sorted(base + more):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; every row and other column stays as it is.

    Null and empty texts stay so; repeated rows are treated alike; no rows in, no rows out.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = pa.array([redacted(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
