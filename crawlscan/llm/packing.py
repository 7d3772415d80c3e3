"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Items are dealt by hash into blocks of about ``BLOCK_ITEMS``, and each block is packed on its own: items
by falling size, each into the tightest bin that is large enough and has no conflict.  Open bins are
kept by what they have left, with a bit set of the values present, so the successor of a size is found
by bit tricks; the search goes on through fuller to emptier bins until one is compatible.  Every bin
carries bitmaps: a stack of planes counts its documents by source up to ``per_source``, and one plane
marks its duplicate clusters, no two members of which share a bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, word_count

CAPACITY = 2048
PER_SOURCE = 4
BLOCK_ITEMS = 4000


class Bins:
    """Open bins of one block.

    ``at[left]`` lists the bins with ``left`` units free and ``present`` has a bit for each such value.
    Sources and clusters are numbered within the block, so the bitmaps are exact.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0
        self.planes: list[list[int]] = []  # of each bin, plane k: sources with more than k documents
        self.clusters: list[int] = []
        self.fill: list[int] = []

    def compatible(self, b: int, source: int, cluster: int) -> bool:
        return not (self.planes[b][-1] & source or self.clusters[b] & cluster)

    def find(self, size: int, source: int, cluster: int) -> int | None:
        """The tightest compatible bin with room for ``size``; among equals the earliest opened."""
        left = self.present >> size << size
        while left:
            room = (left & -left).bit_length() - 1
            for k, b in enumerate(self.at[room]):
                if self.compatible(b, source, cluster):
                    self.at[room].pop(k)
                    if not self.at[room]:
                        self.present &= ~(1 << room)
                    return b
            left &= left - 1
        return None

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin number and offset of an item that is put into its best bin, or a new one."""
        b = self.find(size, source, cluster)
        if b is None:
            b = len(self.fill)
            self.fill.append(0)
            self.planes.append([0] * self.per_source)
            self.clusters.append(0)
        offset = self.fill[b]
        carry = source
        for k, plane in enumerate(self.planes[b]):
            self.planes[b][k], carry = plane | carry, plane & carry
        self.clusters[b] |= cluster
        self.fill[b] += size
        room = self.capacity - self.fill[b]
        if room:
            line = self.at[room]
            k = len(line)
            while k and line[k - 1] > b:
                k -= 1
            line.insert(k, b)
            self.present |= 1 << room
        return b, offset


def pack_block(sizes: list[int], sources: list, clusters: list, ties: list, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item of a block, in the items' order; packed by falling size, then tie."""
    bit: dict = {}
    source_bits = [1 << bit.setdefault(s, len(bit)) for s in sources]
    counts: dict = {}
    for c in clusters:
        counts[c] = counts.get(c, 0) + 1
    bit = {}
    cluster_bits = [0 if c is None or counts[c] == 1 else 1 << bit.setdefault(c, len(bit)) for c in clusters]
    bins, out = Bins(capacity, per_source), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], ties[k])):
        out[k] = bins.place(sizes[k], source_bits[k], cluster_bits[k])
    return out


def text_cluster(text: Column) -> Column:
    """Default duplicate cluster: a hash of the lower-cased words."""
    return F.xxhash64(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " "))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, block_items: int = BLOCK_ITEMS, size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """Where each piece of each document goes.

    ``docs`` needs doc_id, text and source; other columns are ignored, whatever their names.  A document
    larger than ``capacity`` words is cut into full pieces, which fill a bin each, and a rest.  Returns
    one row per piece: doc_id, piece, start (of the piece in its document, in words), n_words, block, bin
    (within the block) and offset (of the piece in its bin).  Documents without words have one row
    with a null bin; a null source is a source of its own; copies never share a bin, nor do rows that
    repeat a document; no rows in, no rows out.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.monotonically_increasing_id().alias("row"),
        (word_count(F.col("text")) if size is None else size).cast("long").alias("n"), (text_cluster(F.col("text")) if cluster is None else cluster).cast("long").alias("cluster"),
    )
    items = ws.save(items.withColumn("pieces", F.greatest(F.ceil(F.col("n") / capacity), F.lit(1))), "items")
    n_blocks = max(1, -(-(items.agg(F.sum("pieces")).first()[0] or 0) // block_items))
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    cut = cut.withColumn("start", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity), F.col("n") - F.col("start")))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(n_blocks)))  # by row, so repeated rows spread too
    nothing = F.lit(None).cast("long")
    empty = dealt.filter("n_words = 0").select("doc_id", "piece", "start", "n_words", nothing.alias("block"), nothing.alias("bin"), nothing.alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            ties = list(zip(t["tie"].to_pylist(), t["piece"].to_pylist(), strict=True))
            spots = pack_block(t["n_words"].to_pylist(), t["source"].to_pylist(), t["cluster"].to_pylist(), ties, capacity, per_source)
            columns = [t[c].combine_chunks() for c in ("doc_id", "piece", "start", "n_words", "block")]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*spots, strict=True))], names=["doc_id", "piece", "start", "n_words", "block", "bin", "offset"])

        held, at = [], None
        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at is not None and blocks[a] != at:
                    yield packed(held)
                    held = []
                at = blocks[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(held)

    rest = dealt.filter("n_words > 0").select("doc_id", "piece", "start", "n_words", "block", "source", "cluster", F.xxhash64("doc_id", "cluster", "source").alias("tie"))
    rest = rest.repartition("block").sortWithinPartitions("block", "n_words", "tie").mapInArrow(run, "doc_id long, piece long, start long, n_words long, block long, bin long, offset long")
    return rest.unionByName(empty)
