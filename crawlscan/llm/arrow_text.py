"""Vectorised text work on Arrow batches: byte-bounded slices, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of bare words: ASCII other than letters and digits.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers: list[np.ndarray] = []


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0))
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the positions of a piece."""
    if not _powers:
        up, down = np.full(PIECE_BYTES + 1, _BASE, U64), np.full(PIECE_BYTES + 1, _BASE_INVERSE, U64)
        up[0] = down[0] = 1
        _powers.extend((np.cumprod(up), np.cumprod(down)))
    return _powers[0], _powers[1]


def _sums(part: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(part) + 1, U64)
    np.cumsum(_BYTE_CODE[part] * _tables()[0][: len(part)], out=sums[1:])
    return sums


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a text column and the offsets of its rows; nulls are empty."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array, separators: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words (A-Z lowered) in order, and each row's offsets into them.

    ``separators`` marks the bytes between words; by default space and U+0009..U+000D.  For each
    number in ``prefixes`` an array follows with the hashes of the words' first so many bytes.

    Bytes are worked through in pieces, so besides the text only eight bytes a word are held, however
    long a row is.  Pieces end between words or rows; a word that fills a piece goes on in the next.
    """
    data, offsets = text_bytes(column)
    row_starts = offsets[:-1][np.diff(offsets) > 0]
    down = _tables()[1]
    starts, values, sizes, heads = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)], [[np.zeros(0, U64)] for _ in prefixes]
    at, goes_on = 0, False
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        solid = ~separators[data[at:end]]
        rows = row_starts[np.searchsorted(row_starts, at) : np.searchsorted(row_starts, end, "right")] - at
        goes_next = False
        if end < len(data) and rows[-1:].tolist() != [end - at]:
            breaks = max([*(np.flatnonzero(~solid)[-1:] + 1), *rows[-1:]], default=0)
            goes_next = breaks == 0
            if breaks:
                end, solid = at + int(breaks), solid[:breaks]
        rows = rows[rows < end - at]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[rows] = solid[rows]
        stops[:-1] &= ~solid[1:]
        ends_row = rows[rows > 0] - 1
        stops[ends_row] = solid[ends_row]
        a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        sums = _sums(_LOWER[data[at:end]])
        value, size = (sums[b] - sums[a]) * down[a], b - a
        head = [mixed((sums[np.minimum(b, a + p)] - sums[a]) * down[a] + U64((1 << 40) + p)) for p in prefixes]
        skip = int(goes_on and len(a) > 0 and a[0] == 0)
        if skip:
            values[-1][-1:] += value[:1] * U64(pow(int(_BASE), int(sizes[-1][-1]), 1 << 64))
            sizes[-1][-1] += size[0]
        if len(a) > skip:
            starts.append(a[skip:] + at)
            values.append(value[skip:])
            sizes.append(size[skip:])
            for kept, h in zip(heads, head, strict=True):
                kept.append(h[skip:])
        at, goes_on = end, goes_next
    hashes = np.concatenate(values)
    hashes += np.concatenate(sizes).astype(U64)
    return mixed(hashes), np.searchsorted(np.concatenate(starts), offsets), *(np.concatenate(h) for h in heads)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans [start, end) of at most ``PIECE_BYTES``, in order and without overlap."""
    down, out, k = _tables()[1], np.zeros(len(starts), U64), 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE_BYTES, side="right")))
        sums = _sums(data[starts[k] : ends[stop - 1]])
        a, b = starts[k:stop] - starts[k], ends[k:stop] - starts[k]
        out[k:stop] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U64)
        k = stop
    return mixed(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; ``x`` is used up."""
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's ``width``-word shingles.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    words, offsets = word_hashes(column)[:2]
    out = []
    odd = [mixed(np.asarray([k + 1], U64))[0] | U64(1) for k in range(width)]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        k = min(width, b - a)
        if not k:
            out.append(words[:0])
            continue
        h = words[a : b - k + 1] * odd[0]
        for j in range(1, k):
            h ^= h >> U64(29)
            h += words[a + j : b - k + 1 + j] * odd[j]
        out.append(_distinct(mixed(h + U64(k))))
    return out
