"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A hash function flips signs and applies the fast Walsh-Hadamard transform three times, a pseudo-random
rotation, and takes the axis (with sign) nearest to the result; ``k`` functions make a bucket of a
table.  A vector is stored in its own bucket of each table and probes the buckets that are next best
by the loss of the replaced coordinates.  ``k`` grows with the number of vectors so that unrelated
vectors rarely meet, and the number of tables with ``k`` so that few pairs at cosine 0.95 escape all of
them: of 14,000 measured at widths 8 to 256 none did, of 5,000 at 768 and 1024 three; closer pairs
escape far less often.

Equal vectors form a class first.  Buckets with company are verified in blocks by matrix products in
double precision.  A pair that meets in several buckets counts in the first of them alone, which its
two vectors' codes tell, so links are counted exactly without listing pairs: a block returns sums per
vector and the links of a spanning forest.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import by_bytes
from .common import Workspace, few_tasks, small
from .components import components

#: functions per table -> (tables, probes with the own bucket among them), measured at cosine 0.95.
PLAN = {1: (5, 4), 2: (6, 8), 3: (9, 8), 4: (11, 16), 5: (14, 24), 6: (18, 32)}
BLOCK = 1024
SLICE = 4 << 20  # bytes of vectors compared at once, or a block
SMALL = 48  # members of a block up to which blocks are compared many at once
COLUMNS = 512  # vectors rotated at once
ALTERNATIVES = 3
SETTLE = 20_000  # vectors (and sixteenths of pairs) gathered before their codes are computed


def functions_for(n: int, dim: int = 64) -> int:
    """How many functions make a bucket, for ``n`` vectors: about four buckets a vector."""
    return int(np.clip(np.ceil(np.log(max(4 * n, 2)) / np.log(2 * max(dim, 2))), 1, max(PLAN)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the columns, in place and without its factor; the height is a power of two."""
    d, n = x.shape
    step = 1
    while step < d:
        y = x.reshape(d // (2 * step), 2, step, n)
        total = y[:, 0] + y[:, 1]
        np.subtract(y[:, 0], y[:, 1], out=y[:, 1])
        y[:, 0] = total
        step *= 2
    return x


@functools.lru_cache(8)
def _signs(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng(9001 + dim).choice(np.array([-1.0, 1.0], np.float32), (number, 3, dim, 1))


def codes(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, tables, probes) bucket codes of unit vectors; the first probe is the own bucket.

    Rows are rotated ``COLUMNS`` at a time, as columns of a block that stays in the processor's cache.
    All of it is additions in a fixed order, so a vector has the same codes in whatever company.
    """
    tables, probes = PLAN[k]
    dim = max(2, 1 << (x.shape[1] - 1).bit_length())
    signs, depth = _signs(dim, tables * k), min(ALTERNATIVES, dim)
    combos = np.array(list(itertools.product(range(depth), repeat=k)))
    combos = combos[np.argsort(combos.sum(1), kind="stable")][: max(4 * probes, 64)]
    out = np.zeros((len(x), tables, probes), np.int64)
    for first in range(0, len(x), COLUMNS):
        part = x[first : first + COLUMNS]
        n = len(part)
        columns = np.zeros((dim, n), np.float32)
        columns[: x.shape[1]] = part.T
        at = np.arange(n)
        for t in range(tables):
            loss, code = np.zeros((n, len(combos)), np.float32), np.zeros((n, len(combos)), np.int64)
            for j in range(k):
                r = columns
                for s in signs[t * k + j]:
                    r = hadamard(r * s)
                size = np.abs(r)
                axis, value = np.empty((n, depth), np.int64), np.empty((n, depth), np.float32)
                for rank in range(depth):
                    best = size.argmax(axis=0)
                    value[:, rank] = size[best, at]
                    axis[:, rank] = 2 * best + (r[best, at] < 0)
                    size[best, at] = -1
                pick = combos[:, j]
                loss += ((value[:, :1] - value) ** 2)[:, pick]
                code = code * (2 * dim) + axis[:, pick]
            order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            chosen = np.take_along_axis(code, order, 1)
            out[first : first + n, t, : chosen.shape[1]] = chosen
            out[first : first + n, t, chosen.shape[1] :] = chosen[:, :1]
    return out


def unit(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors of one width, as rows."""
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_width(blobs: list[bytes]) -> Iterator[np.ndarray]:
    widths = np.array([len(b) for b in blobs])
    for w in np.unique(widths):
        yield np.flatnonzero(widths == w)


def entries(classes: DataFrame, k: int) -> DataFrame:
    """(dim, tab, code, rep, own) of every bucket that a class is stored in (own) or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, probes = PLAN[k]
        for batch in batches:
            blobs, reps = batch.column("blob").to_pylist(), np.asarray(batch.column("rep"))
            for rows in _by_width(blobs):
                c = codes(unit([blobs[r] for r in rows]), k)
                own = np.zeros(c.shape, bool)
                own[:, :, 0] = True
                tab = np.broadcast_to(np.arange(tables)[None, :, None], c.shape)
                fresh = own | (c != c[:, :, :1])
                rep = np.broadcast_to(reps[rows][:, None, None], c.shape)[fresh]
                dim = np.full(len(rep), len(blobs[rows[0]]) // 8, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(tab[fresh].astype(np.int32)), pa.array(c[fresh]), pa.array(rep), pa.array(own[fresh])], names=["dim", "tab", "code", "rep", "own"])

    return classes.select("rep", "blob").mapInArrow(run, "dim int, tab int, code long, rep long, own boolean")


def first_meeting(cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and bucket where pairs first meet; x has the smaller id.  Codes are (pairs, tables, probes)."""
    own = cx[:, :, 0] == cy[:, :, 0]
    at_x = (cy == cx[:, :, :1]).any(2)
    at_y = (cx == cy[:, :, :1]).any(2)
    tab = (own | at_x | at_y).argmax(1)
    pairs = np.arange(len(cx))
    code = np.where(at_x[pairs, tab], cx[pairs, tab, 0], cy[pairs, tab, 0])
    return tab, code


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Each batch, and whether it is the last."""
    before = None
    for batch in batches:
        if before is not None:
            yield False, before
        before = batch
    if before is not None:
        yield True, before


def verify(blocks: DataFrame, k: int, cosine: float) -> DataFrame:
    """Sums and links from blocks sorted by (dim, tab, code, i, j).

    ``kind`` 0: (x = class, y = vectors linked to each of its members); 1: a link (x, y) of the forest.
    """

    def kept(table: pa.Table, ia: np.ndarray, ib: np.ndarray, x: np.ndarray) -> tuple | None:
        """Vectors that are in the pairs, and the pairs, the smaller id first, with where they were found.

        ``x`` has the unit vectors of all rows.  A pair of two owners counts from its smaller id alone.
        """
        rep, own = np.asarray(table["rep"]), np.asarray(table["own"])
        keep = (rep[ia] != rep[ib]) & ~(own[ib] & (rep[ib] < rep[ia]))
        ia, ib = ia[keep], ib[keep]
        if not len(ia):
            return None
        used, at = np.unique(np.concatenate([ia, ib]), return_inverse=True)
        tab, code, n = (np.asarray(table[c]) for c in ("tab", "code", "n"))
        where = tab[ia], code[ia]
        ia, ib = at[: len(ia)], at[len(ia) :]
        rep = rep[used]
        turned = rep[ia] > rep[ib]
        return x[used], rep, n[used], np.where(turned, ib, ia), np.where(turned, ia, ib), *where

    def of_block(table: pa.Table) -> tuple | None:
        """Pairs of enough cosine of one block."""
        role, own = np.asarray(table["role"]), np.asarray(table["own"])
        x = unit(table["blob"].to_pylist())
        a, b = np.flatnonzero((role == 1) | ((role == 0) & own)), np.flatnonzero(role != 1)
        ia, ib = np.nonzero(x[a] @ x[b].T >= cosine)
        return kept(table, a[ia], b[ib], x)

    def of_small(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> tuple | None:
        """The same of many small blocks that are whole groups, those of one size at once."""
        x, own, pairs = unit(table["blob"].to_pylist()), np.asarray(table["own"]), [(np.zeros(0, np.int64),) * 2]
        for size in np.unique(sizes):
            rows = starts[sizes == size][:, None] + np.arange(size)
            near = (x[rows] @ x[rows].transpose(0, 2, 1) >= cosine) & own[rows][:, :, None]
            block, i, j = np.nonzero(near)
            pairs.append((rows[block, i], rows[block, j]))
        return kept(table, *(np.concatenate(p) for p in zip(*pairs, strict=True)), x)

    def settled(parts: list[tuple]) -> pa.RecordBatch:
        """Sums and forest of the pairs that count where they were found; codes are computed once for all."""
        starts = np.cumsum([0, *(len(p[1]) for p in parts)])
        reps, first, number = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
        n = np.concatenate([p[2] for p in parts])[first]
        c = codes(np.concatenate([p[0] for p in parts])[first], k)
        lo = number[np.concatenate([p[3] + s for p, s in zip(parts, starts, strict=False)])]
        hi = number[np.concatenate([p[4] + s for p, s in zip(parts, starts, strict=False)])]
        here = [np.concatenate([p[j] for p in parts]) for j in (5, 6)]
        counts = np.zeros(len(lo), bool)
        for s in range(0, len(lo), 20_000):
            tab, code = first_meeting(c[lo[s : s + 20_000]], c[hi[s : s + 20_000]])
            counts[s : s + 20_000] = (tab == here[0][s : s + 20_000]) & (code == here[1][s : s + 20_000])
        lo, hi = lo[counts], hi[counts]
        total = np.bincount(lo, n[hi], len(reps)) + np.bincount(hi, n[lo], len(reps))
        some = np.flatnonzero(total)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.get(v, v) != v:
                parent[v] = parent.get(parent[v], parent[v])
                v = parent[v]
            return v

        links = []
        for u, v in zip(reps[lo].tolist(), reps[hi].tolist(), strict=True):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[ru] = rv
                links.append((u, v))
        xs = np.concatenate([reps[some], np.array([u for u, _ in links], np.int64)])
        ys = np.concatenate([total[some].astype(np.int64), np.array([v for _, v in links], np.int64)])
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(links)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(xs), pa.array(ys)], names=["kind", "x", "y"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple | None]:
        """The pairs of all blocks; a block that a batch may cut waits for the next."""
        held = None
        for last, batch in _with_last(by_bytes(batches, "blob", SLICE)):
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            keys = np.column_stack([np.asarray(table[c]).astype(np.int64) for c in ("dim", "tab", "code", "i", "j")])
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)] * (len(keys) > 0)])
            whole = len(cuts) - 1 if last else max(0, len(cuts) - 2)
            held = table.slice(cuts[whole]) if len(keys) else None
            starts, sizes = cuts[:whole], np.diff(cuts)[:whole]
            small_ones = (np.asarray(table["role"])[starts] == 0) & (sizes <= SMALL) if whole else np.zeros(0, bool)
            for dim in np.unique(keys[starts[small_ones], 0]):
                mine = small_ones & (keys[starts, 0] == dim)
                rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[mine], sizes[mine], strict=True)])
                yield of_small(table.take(pa.array(rows)), np.cumsum(sizes[mine]) - sizes[mine], sizes[mine])
            for s, n in zip(starts[~small_ones], sizes[~small_ones], strict=True):
                yield of_block(table.slice(s, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for part in found(batches):
            if part is None:
                continue
            if parts and parts[0][0].shape[1] != part[0].shape[1]:  # another vector length
                yield settled(parts)
                parts, size = [], 0
            parts.append(part)
            size += len(part[1]) + len(part[3]) // 16
            if size > SETTLE:
                yield settled(parts)
                parts, size = [], 0
        if parts:
            yield settled(parts)

    return blocks.mapInArrow(run, "kind int, x long, y long")


def near_vectors(vectors: DataFrame, *, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and components of vectors with cosine >= ``cosine``.

    Other columns are ignored, whatever their names.  Vectors that are null, empty, zero or hold null or
    non-finite components are linked with nothing, nor are vectors of different lengths, or rows
    without an id (their component is null and they are kept).  Returns one row per input row: the id,
    n_links (other vectors linked directly), component_id (smallest id reachable by links, itself
    included) and kept (id = component_id).  Rows that share an id count as one node of the components.
    No rows in, no rows out.
    """
    if cosine < 0.95:
        raise ValueError("the numbers of tables and probes are set for a cosine of 0.95 or more")
    ws = Workspace(vectors.sparkSession, "vectors")
    v = F.col(vector_col).cast("array<double>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    key = ["width", "digest_a", "digest_b"]  # tells vectors apart, so they are shuffled once
    rows = rows.select("vec_id", "v", F.size("v").alias("width"), *(F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(k), "v")).alias(c) for k, c in enumerate(key[1:])))
    ids = ws.save(rows.drop("v"), "ids")
    grouped = rows.filter("v IS NOT NULL").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([np.asarray(x.values, np.float64).tobytes() for x in batch.column("v")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data], names=[*batch.schema.names[:-1], "blob"])

    classes = ws.save(few_tasks(grouped).mapInArrow(blobs, "width int, digest_a long, digest_b long, rep long, n long, blob binary"), "classes")
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("dim")).first()
    k = functions_for(shape["n"], shape["dim"] or 64)
    where = ["dim", "tab", "code"]
    posted = ws.save(entries(classes, k), "entries")
    met = posted.groupBy(*where).agg(F.count(F.lit(1)).alias("members"), F.count_if("own").alias("owners")).filter("members > 1 AND owners > 0")
    met = ws.save(met.select(*where, F.ceil(F.col("owners") / BLOCK).alias("rows"), F.ceil(F.col("members") / BLOCK).alias("columns")), "met", few=True)
    m = posted.join(met, where)
    one = (F.col("rows") == 1) & (F.col("columns") == 1)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spot = lambda i, j, role: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(role).alias("role"))
    as_owner = F.when(F.col("own"), F.transform(every(F.col("columns")), lambda j: spot(F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rows")), j, 1)))
    as_member = F.transform(every(F.col("rows")), lambda i: spot(i, F.pmod(F.xxhash64("rep", F.lit(2)), F.col("columns")), 2))
    spots = F.when(one, F.array(spot(F.lit(0), F.lit(0), 0))).otherwise(F.concat(F.coalesce(as_owner, F.expr("cast(array() as array<struct<i:bigint,j:bigint,role:int>>)")), as_member))
    block = [*where, "i", "j"]
    dealt = m.withColumn("spot", F.explode(spots)).select(*where, "spot.i", "spot.j", "spot.role", "own", "rep").join(classes.select("rep", "n", "blob"), "rep")
    dealt = few_tasks(dealt.select(*block, "role", "own", "rep", "n", "blob").repartition(*block).sortWithinPartitions(*block))
    found = ws.save(verify(dealt, k, cosine), "found")
    sums = found.filter("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("linked"))
    parts = components(found.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")), ws, "cc").withColumnRenamed("node", "rep")
    known = classes.select(*key, "rep", "n").join(sums, "rep", "left").join(small(parts), "rep", "left")
    known = known.select(*key, (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("part"))
    out = ids.join(known, key, "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", "vec_id").alias("component_id"))
    return ws.result(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "links")


#: Every pair compared, and components by reachability, in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sound AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS part FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, part AS component_id, v.vec_id = part AS kept FROM v LEFT JOIN parts ON v.vec_id = parts.vec_id LEFT JOIN counts ON v.vec_id = counts.vec_id
"""
