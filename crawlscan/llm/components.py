"""Connected components of a link table by contraction, without gathering the links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small

MAX_ROUNDS = 80
#: Links, contracted until no more than so many are left, are joined in one task: 16 bytes each.
FINISH_LINKS = 500_000


def union_find(pairs: Iterator[tuple[int, int]], parent: dict[int, int] | None = None) -> Iterator[tuple[int, int]]:
    """The pairs that join what was not joined before: a spanning forest.  ``parent`` may hold earlier joins."""
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            yield a, b


def labels_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _finish(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            t = pa.Table.from_batches(held)
            nodes, label = labels_of(np.asarray(t["u"]), np.asarray(t["v"]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["k", "top"])

    return edges.coalesce(1).mapInArrow(run, "k long, top long")


def components(links: DataFrame, ws: Workspace, name: str, finish: int = FINISH_LINKS) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); the component is its smallest node.

    Nodes are ordered by a 64-bit hash, which is one-to-one for a long.  In a round each node moves to the
    first of its neighbours and itself, and links between what is left go on: in this random order a
    round leaves a fraction of the nodes, whatever the shape of the graph, so a table shrinks
    geometrically until its links fit into one task.  Minima combine before their shuffle and the joins
    are of stored tables, whose hot keys adaptive execution splits.  Every round is stored in the shared
    folder, so a lost executor costs at most that round.
    """
    key = lambda c: F.xxhash64(F.col(c).cast("long"))
    ids = ws.save(links.filter("a <> b").select("a", "b").distinct(), f"{name}-links", few=True)
    edges, moves = ids.select(key("a").alias("u"), key("b").alias("v")), []
    for k in range(MAX_ROUNDS):
        n = edges.count()
        if n <= finish:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("top"))
        moved = ws.save(first.filter("top <> k"), f"{name}-move{k}", few=True)
        moves.append(moved)
        where = small(moved)
        for c in ("u", "v"):
            step = where.select(F.col("k").alias(c), F.col("top").alias(f"{c}_top"))
            edges = edges.join(step, c, "left").withColumn(c, F.coalesce(f"{c}_top", c)).drop(f"{c}_top")
        edges = ws.save(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-{k}", few=True)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    moves.append(ws.save(_finish(edges), f"{name}-last"))
    labels = ids.select(F.col("a").alias("node")).union(ids.select(F.col("b").alias("node"))).distinct().withColumn("k", key("node"))
    for moved in moves:
        labels = labels.join(small(moved), "k", "left").select("node", F.coalesce("top", "k").alias("k"))
    labels = ws.save(labels, f"{name}-labels", few=True)
    least = small(ws.save(labels.groupBy("k").agg(F.min("node").alias("component")), f"{name}-least", few=True))
    return labels.join(least, "k").select("node", "component")
