"""Token-ID files coded with a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, serves every file.  A file is a run of groups of
whole documents; a group's ids are cut into coding blocks of ``BLOCK`` ids, each coded on its own with
interleaved lanes.  The index at the end of a file holds a checkpoint (byte offset, id count, lanes)
and a checksum for every block, so blocks decode independently and in parallel.

File layout, little-endian: ``b"ANSF"``, u32 version, u32 crc32 of the table, block payloads, index
(JSON), u64 index offset, u32 crc32 of the index, ``b"FSNA"``.  A payload is the final lane states
(u64 each) and the renormalisation words (u32 each) in decoding order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_text import PIECE_BYTES, by_bytes, span_hashes, text_bytes
from .common import Workspace

U64, U32 = np.uint64, np.uint32
BITS = 20  # frequencies sum to 2 ** BITS
LOW = U64(1 << 31)  # states stay in [LOW, LOW << 32)
LANES = 512
BLOCK = 1 << 17
MAGIC, TAIL = b"ANSF", b"FSNA"
CACHE_UNITS, CACHE_IDS = 2_000_000, 16_000_000  # at most 28 bytes a unit, besides its ids
JOINED_UNITS = 1000
LONG_UNIT = 256  # bytes; longer units are not looked up by their hash
AROUND = 8  # bytes before and after a piece that can tell where units start in it
GROUP_BYTES = UNITS_BYTES = 4 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])


class Table:
    """Scaled frequencies of all ids, shared by every file."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(U64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=U32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Counts scaled to 2 ** BITS; every counted id keeps at least 1, the commonest absorb the rounding."""
        total = max(1, int(counts.sum()))
        freq = np.where(counts > 0, np.maximum(1, counts.astype(float) * (1 << BITS) // total), 0).astype(np.int64)
        if not counts.any():
            freq[0] = 1
        order = np.argsort(-freq, kind="stable")
        gap, k = (1 << BITS) - int(freq.sum()), 0
        while gap:
            j = order[k % len(order)]
            step = gap if gap > 0 else max(gap, 1 - int(freq[j])) if freq[j] else 0
            freq[j] += step
            gap -= step
            k += 1
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, int]:
    """Payload and lane count of one block; ids are padded with the last one to whole steps."""
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    steps = -(-len(ids) // lanes)
    grid = np.concatenate([ids, np.full(steps * lanes - len(ids), ids[-1], ids.dtype)]).reshape(steps, lanes)
    freq, start = table.freq[grid], table.start[grid]
    limit = freq << U64(31 - BITS + 32)
    x, words = np.full(lanes, LOW, U64), []
    for t in range(steps - 1, -1, -1):
        out = x >= limit[t]
        if out.any():
            words.append(x[out].astype(U32))  # the low 32 bits
            x = np.where(out, x >> U64(32), x)
        q = x // freq[t]
        x = (q << U64(BITS)) + (x - q * freq[t]) + start[t]
    return x.astype("<u8").tobytes() + (np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""), lanes


def decode_block(payload: bytes, n: int, lanes: int, table: Table) -> np.ndarray:
    """The ``n`` ids of a block."""
    x = np.frombuffer(payload, "<u8", lanes).copy()
    words = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(U64)
    steps, at, mask = -(-n // lanes), 0, U64((1 << BITS) - 1)
    out = np.empty((steps, lanes), U32)
    for t in range(steps):
        slot = x & mask
        s = table.symbol[slot]
        out[t] = s
        x = table.freq[s] * (x >> U64(BITS)) + slot - table.start[s]
        low = x < LOW
        k = int(np.count_nonzero(low))
        if k:
            x[low] = (x[low] << U64(32)) | words[at : at + k]
            at += k
    if at != len(words):
        raise ValueError("a block's words do not match its ids")
    return out.ravel()[:n]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which byte-level splitting surely breaks the texts into pieces.

    These are the starts of texts, a single space or line feed between two characters that are not
    white space, what follows such a line feed, and a comma or full stop after a letter (ASCII, or one
    of U+00C0..U+00FF).  Bytes are worked through in pieces, with what stands around each.
    """
    found, rows = [np.zeros(0, np.int64)], offsets[:-1][np.diff(offsets) > 0]
    for at in range(0, len(data), PIECE_BYTES):
        a, b = max(0, at - AROUND), min(len(data), at + PIECE_BYTES + AROUND)
        cuts = np.unique(np.concatenate([[a], rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)], [b]])) - a
        starts = _starts_in(data[a:b], cuts) + a
        found.append(starts[(starts >= at) & (starts < at + PIECE_BYTES) & ((starts > a) | (a == 0))])
    return np.concatenate(found)


def _starts_in(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(data)
    blank = _BLANK[data]
    at = [np.roll(data, -k) for k in (1, 2)]
    two = (data == 0xC2) & ((at[0] == 0x85) | (at[0] == 0xA0))
    general = (data == 0xE2) & (at[0] == 0x80) & (((at[1] >= 0x80) & (at[1] <= 0x8A)) | (at[1] == 0xA8) | (at[1] == 0xA9) | (at[1] == 0xAF))
    three = general | ((data == 0xE1) & (at[0] == 0x9A) & (at[1] == 0x80)) | ((data == 0xE2) & (at[0] == 0x81) & (at[1] == 0x9F)) | ((data == 0xE3) & (at[0] == 0x80) & (at[1] == 0x80))
    for k, wide in ((2, two), (3, three)):
        for j in range(k if wide.any() else 0):
            blank[(np.flatnonzero(wide) + j) % n] = True
    filled = np.diff(offsets) > 0
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    before, after = ~np.roll(blank, 1), ~np.roll(blank, -1)
    before[first] = False
    after[last] = False
    lone = before & after
    feed = (data == 10) & lone
    letter = _LETTER[data] | ((np.roll(data, 1) == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7))
    ends_word = np.roll(letter, 1)
    ends_word[first] = False
    start = ((data == 32) & lone) | feed | np.roll(feed, 1) | (((data == 44) | (data == 46)) & ends_word)
    start[first] = True
    return np.flatnonzero(start)


def breaks_like_bytes(path: str) -> bool:
    """Whether a tokenizer file splits texts as ``unit_starts`` assumes: by the byte-level pattern, and nothing before it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    return bool(plain and not spec.get("normalizer") and not any(re.search(r"[\s,.]", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])))


def token_sizes(path: str) -> np.ndarray | None:
    """Bytes of text behind each id, or null if the ids of a text may stand for more or less than its bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    changes = [spec.get("truncation"), spec.get("padding"), *(model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))]
    if model.get("type") != "BPE" or any(changes) or not set(ByteLevel.alphabet()) <= set(model["vocab"]):
        return None
    sizes = {k: len(token) for token, k in model["vocab"].items()}  # a character stands for a byte
    sizes |= {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", [])}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


class UnitCache:
    """Ids of units by their 64-bit hashes: an open-addressing table in arrays, filled to a half at most."""

    def __init__(self, dtype: str):
        self.ids = np.zeros(1 << 16, dtype)
        self.clear()

    def clear(self) -> None:
        self.units = self.n_ids = 0
        self._empty(1 << 16)

    def _empty(self, slots: int) -> None:
        self.key, self.place, self.size = np.zeros(slots, U64), np.full(slots, -1, np.int32), np.zeros(slots, np.uint16)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or else the free one (place -1) at which its search ends."""
        mask = len(self.key) - 1
        slot = (keys & U64(mask)).astype(np.int64)
        todo = np.flatnonzero((self.key[slot] != keys) & (self.place[slot] >= 0))
        while len(todo):
            slot[todo] = at = (slot[todo] + 1) & mask
            todo = todo[(self.key[at] != keys[todo]) & (self.place[at] >= 0)]
        return slot

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add distinct keys that are not there, with the number of ids of each."""
        places = self.n_ids + np.cumsum(sizes) - sizes
        self.units, end = self.units + len(keys), self.n_ids + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(2 * end - self.n_ids, self.ids.dtype)])
        self.ids[self.n_ids : end] = ids
        self.n_ids = end
        if 2 * self.units > len(self.key):
            held, slots = self.place >= 0, len(self.key)
            keys, places, sizes = (np.concatenate(x) for x in ((self.key[held], keys), (self.place[held], places), (self.size[held], sizes)))
            while 2 * self.units > slots:
                slots *= 2
            self._empty(slots)
        while len(keys):
            slot, first = np.unique(self.slots(keys), return_index=True)  # of keys that meet, one goes in
            self.key[slot], self.place[slot], self.size[slot] = keys[first], places[first], sizes[first]
            keys, places, sizes = (np.delete(x, first) for x in (keys, places, sizes))


class UnitEncoder:
    """Ids of texts by a cache of units: the stretches between ``unit_starts``.

    As the tokenizer breaks at each start, the ids of a text are those of its units in turn.  Units of at
    most ``LONG_UNIT`` bytes are told apart by 64-bit hashes, and only those that are not in the cache are
    encoded; longer ones, which could be made to collide, are each encoded.  With a tokenizer that
    splits in another way, every text is a unit and each is encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.units = breaks_like_bytes(path)
        self.sizes = token_sizes(path) if self.units else None
        self.cache = UnitCache(self.dtype)

    def _each(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of byte spans in turn, each encoded as a text, and the number of ids of each."""
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.dtype), *got]), np.array([len(x) for x in got], np.int64)

    def _joined(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for short units, many to a text, where they are surely its units again."""
        if self.sizes is None or not len(starts):
            return self._each(data, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        data = data[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
        cut = np.zeros(len(bounds), bool)
        cut[::JOINED_UNITS] = cut[-1] = True
        while True:
            sure = unit_starts(data, bounds[cut])
            unit = np.searchsorted(bounds, sure, side="right") - 1
            whole = bounds[unit] == sure
            apart = np.append(np.bincount(unit[whole], minlength=len(starts)) == 0, False)
            inner = unit[~whole]
            apart[inner] = apart[inner + 1] = True  # what breaks inside goes by itself
            if not (apart & ~cut).any():
                break
            cut |= apart
        ids, _ = self._each(data, bounds[cut][:-1], bounds[cut][1:])
        upto = np.append(np.cumsum(self.sizes[ids]), -1)
        last = np.searchsorted(upto[:-1], bounds[1:])
        if len(ids) != last[-1] + 1 or (upto[last] != bounds[1:]).any():  # ids stand for other bytes than they should
            return self._each(data, bounds[:-1], bounds[1:])
        return ids, np.diff(last, prepend=-1)

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units of a piece in turn, and the number of ids of each unit."""
        cache = self.cache
        if cache.units > CACHE_UNITS or cache.n_ids > CACHE_IDS:
            cache.clear()
        long = ends - starts > LONG_UNIT if self.units else np.ones(len(starts), bool)
        short, apart = np.flatnonzero(~long), np.flatnonzero(long)
        keys = span_hashes(data, starts[short], ends[short])
        slot = cache.slots(keys)
        place, n = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        place[short], n[short] = cache.place[slot], cache.size[slot]
        new = np.flatnonzero(cache.place[slot] < 0)
        if len(new):
            kinds, first = np.unique(keys[new], return_index=True)
            unit = short[new[first]]
            cache.add(kinds, *self._joined(data, starts[unit], ends[unit]))
            slot = cache.slots(keys[new])
            place[short[new]], n[short[new]] = cache.place[slot], cache.size[slot]
        flat = cache.ids
        if len(apart):
            ids, n[apart] = self._each(data, starts[apart], ends[apart])
            place[apart] = cache.n_ids + np.cumsum(n[apart]) - n[apart]
            flat = np.concatenate([flat[: cache.n_ids], ids])
        return flat[np.repeat(place - np.cumsum(n) + n, n) + np.arange(n.sum())], n

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end_id``, and the number of ids of each.

        Units go through in pieces of the texts, so a long text takes no more than itself and its ids.
        """
        data, offsets = text_bytes(column)
        starts = np.unique(offsets[:-1][np.diff(offsets) > 0]) if not self.units else unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        ids, counts, k = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)], 0
        while k < len(starts):
            stop = max(k + 1, int(np.searchsorted(ends, starts[k] + UNITS_BYTES, side="right")))
            for held, part in zip((ids, counts), self._encoded(data, starts[k:stop], ends[k:stop]), strict=True):
                held.append(part)
            k = stop
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])[np.searchsorted(starts, offsets)]
        return np.insert(np.concatenate(ids), upto[1:], end_id), np.diff(upto) + 1


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


GROUPS = "part int, grp int, doc_ids array<long>, lens array<long>, wide boolean, ids binary"


def token_groups(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Groups of whole documents in ascending doc_id order (nulls first): ids and lengths.

    Documents are dealt by ranges of doc_id, so a partition's number and a group's number order all groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        part, wide = TaskContext.get().partitionId(), np.dtype(enc.dtype).itemsize == 4
        for grp, batch in enumerate(by_bytes(batches, "text", GROUP_BYTES)):
            ids, lens = enc.encode(batch.column("text"), end_id)
            columns = [pa.array([part], pa.int32()), pa.array([grp], pa.int32()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([lens.tolist()], pa.list_(pa.int64())), pa.array([wide]), pa.array([ids.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "grp", "doc_ids", "lens", "wide", "ids"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return dealt.mapInArrow(run, GROUPS)


def count_ids(groups: DataFrame) -> np.ndarray:
    """Counts of all ids; each task sends its counts once, so the driver gets one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob, wide in zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist(), strict=True):
                n = np.bincount(np.frombuffer(blob, "<u4" if wide else "<u2"))
                size = max(len(n), len(total))
                total = np.pad(total, (0, size - len(total))) + np.pad(n, (0, size - len(n)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    got = groups.select("wide", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(max(1, (pc.max(got["id"]).as_py() or 0) + 1), np.int64)
    counts[np.asarray(got["id"])] = np.asarray(got["n"])
    return counts


def open_fs(uri: str) -> tuple[pfs.FileSystem, str]:
    """File system and path of a URI; local paths and file:, and whatever else Arrow can reach."""
    return pfs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_bytes(uri: str, data: bytes) -> None:
    """Write through a temporary name, so a file is whole or absent."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    temp = f"{path}.{os.getpid()}-{os.urandom(4).hex()}.tmp"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, path)


MANIFEST = "part int, grp int, path string, n_docs long, n_ids long, n_bytes long"


def write_files(groups: DataFrame, table: Table, folder: str) -> DataFrame:
    """Write a file per run of consecutive groups that a task holds; returns the manifest.

    A file's name tells its first group; names in order hold documents in order.  Writing again gives
    the same bytes, so a task that runs twice does no harm.
    """
    shared = groups.sparkSession.sparkContext.broadcast(table.freq)  # one number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = Table(shared.value)
        first = last = None
        body, index, done = [], [], []
        size = 0

        def close() -> None:
            meta = json.dumps({"groups": index}).encode()
            data = b"".join([MAGIC, struct.pack("<II", 1, tab.crc), *body, meta, struct.pack("<QI", 12 + size, zlib.crc32(meta)), TAIL])
            path = f"{folder}/ids-{first[0]:06d}-{first[1]:06d}.ans"
            write_bytes(path, data)
            done.append((*first, path, sum(len(g["lens"]) for g in index), sum(sum(g["lens"]) for g in index), len(data)))

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["part"], row["grp"])
                if last is not None and here != (last[0], last[1] + 1):
                    close()
                    first, body, index, size = None, [], [], 0
                first, last = first or here, here
                ids = np.frombuffer(row["ids"], "<u4" if row["wide"] else "<u2").astype(np.int64)
                blocks = []
                for at in range(0, len(ids), BLOCK):
                    payload, lanes = encode_block(ids[at : at + BLOCK], tab)
                    blocks.append([12 + size, len(payload), len(ids[at : at + BLOCK]), lanes, zlib.crc32(payload)])
                    body.append(payload)
                    size += len(payload)
                index.append({"doc_ids": row["doc_ids"], "lens": row["lens"], "blocks": blocks})
        if last is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 6, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names=["part", "grp", "path", "n_docs", "n_ids", "n_bytes"])

    return groups.mapInArrow(run, MANIFEST)


def read_groups(uri: str, table: Table) -> Iterator[tuple[list, list[int], np.ndarray]]:
    """(doc_ids, lengths, ids) of each group of a file, checked against its checksums."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        total = f.size()
        head, tail = f.read_at(12, 0), f.read_at(16, total - 16)
        if head[:4] != MAGIC or tail[12:] != TAIL or struct.unpack("<I", head[8:])[0] != table.crc:
            raise ValueError(f"{uri}: not a file of this table")
        offset, crc = struct.unpack("<QI", tail[:12])
        meta = f.read_at(total - 16 - offset, offset)
        if zlib.crc32(meta) != crc:
            raise ValueError(f"{uri}: the index is damaged")
        for group in json.loads(meta)["groups"]:
            parts = []
            for at, size, n, lanes, check in group["blocks"]:
                payload = f.read_at(size, at)
                if zlib.crc32(payload) != check:
                    raise ValueError(f"{uri}: the block at {at} is damaged")
                parts.append(decode_block(payload, n, lanes, table))
            yield group["doc_ids"], group["lens"], np.concatenate(parts)


def read_files(manifest: DataFrame, table: Table) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    spark = manifest.sparkSession
    shared = spark.sparkContext.broadcast(table.freq)
    before = F.sum("n_ids").over(Window.orderBy("part", "grp").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    placed = manifest.withColumn("first", F.coalesce(before, F.lit(0))).select("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = Table(shared.value)
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                for doc_ids, lens, ids in read_groups(path, tab):
                    ends = np.cumsum(lens)
                    raw = ids.astype("<u4").tobytes()
                    crcs = [zlib.crc32(memoryview(raw)[4 * (e - n) : 4 * e]) for e, n in zip(ends, lens, strict=True)]
                    columns = [pa.array(doc_ids, pa.int64()), pa.array(at + ends - np.array(lens), pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at += int(ends[-1])

    spread = placed.repartition(max(1, min(4096, manifest.count())), "path")  # a file per task, as far as that goes
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, tokenizer: str, *, end_id: int = 0, folder: str | None = None) -> tuple[DataFrame, Table, str]:
    """Write every whole text's ids, each document followed by ``end_id``, as files under ``folder``.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.  Documents go in
    ascending doc_id order, null ids first, equal ids by text; null and empty texts are the end id alone;
    an empty table writes no file.  A long text takes memory for itself and its ids.  Returns the manifest, the table and the folder; the table is also
    stored as ``table.u4`` in the folder.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    folder = folder or f"{ws.path}/files"
    groups = ws.save(token_groups(docs, tokenizer, end_id), "groups")
    table = Table.of(count_ids(groups))
    write_bytes(f"{folder}/table.u4", table.freq.astype("<u4").tobytes())
    manifest = ws.save(write_files(groups, table, folder), "manifest")
    ws.drop("groups")
    return manifest, table, folder


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens, ids_crc32 of each document from the files."""
    manifest, table, _ = encode_corpus(docs, tokenizer)
    return read_files(manifest, table)


def load_table(spark: SparkSession, folder: str) -> Table:
    """The table that ``encode_corpus`` stored in ``folder``."""
    fs, path = open_fs(f"{folder}/table.u4")
    with fs.open_input_file(path) as f:
        return Table(np.frombuffer(f.read(), "<u4").astype(np.int64))
