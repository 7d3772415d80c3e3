"""MinHash near-duplicate detection by an inverted join on signature coordinates.

1. Sign: one pass gives each document the size and a 128-bit digest of its shingle set and a
   signature of ``K`` minimum hashes.  Documents with equal sets form a class at once; its smallest id
   stands for it.
2. Post: every class is posted under its coordinate-value pairs.  Linked classes agree on at least
   ``MATCHES`` of ``K`` coordinates (at similarity 0.8 a pair agrees on 51 of 64 on average; fewer than
   32 has a probability below 1e-7), and two classes that do so share a pair among any K - MATCHES + 1
   of each under one common order.  Ordered by rarity, pairs that occur once fill that prefix first and
   need no posting; most classes thereby leave the join, and frequent pairs are skipped.
3. Stars: a list's members are first compared with its pivot, the member that shares most with all
   others: collisions of their signatures are counted, those at the threshold are confirmed on full
   shingle sets, the pivot's once per task, in a stream.  So large groups of near copies join by as
   many links as they have members.
4. Blocks: a pivot's group is every member of the lists it leads; both sides of any link are in one such
   group.  Members that are not yet in the group's largest component are compared with the whole
   group, by blocks.  A block has an inverted index of its coordinate-value pairs: for each member the
   K - MATCHES + 1 shortest of its lists are merged, which finds every candidate, and the longer lists
   are skipped and only looked up for candidates.  Members with a candidate at the threshold go on to
   full sets, where a block gives the links of a spanning forest only.
5. Components: links of stars, then links between their components.  Pairs within a component cannot
   change the result, so no link is lost and no group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, by_bytes, mixed, shingle_sets
from .common import Workspace, few_tasks, small
from .components import components, union_find

K, MATCHES = 64, 32
PREFIX = K - MATCHES + 1
CHUNK_ROWS = 2000  # members compared with one pivot by one task
SIG_BLOCK, TEXT_BLOCK = 1024, 256  # members of a side of a block
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 2**63, K, dtype=np.int64).astype(U64)
_ODD = _RNG.integers(0, 2**62, K, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, K) uint32 minima of each non-empty set; rows of empty sets are all ones."""
    out = np.full((len(sets), K), 0xFFFFFFFF, np.uint32)
    full = [j for j, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[j] for j in full])
        starts = np.cumsum([0, *(len(sets[j]) for j in full[:-1])])
        for k in range(K):
            out[full, k] = np.minimum.reduceat(((flat ^ _XOR[k]) * _ODD[k]) >> U64(32), starts)
    return out


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([s.sum(dtype=U64) if len(s) else U64(0) for s in sets], U64)
    two = np.array([mixed(s ^ U64(0xA5A5A5A5)).sum(dtype=U64) if len(s) else U64(0) for s in sets], U64)
    return one.view(np.int64), two.view(np.int64)


def sign(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest_a, digest_b, sig (K little-endian uint32) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            a, b = _digests(sets)
            sig = signatures(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            blobs = pa.array([row.tobytes() if n else None for row, n in zip(sig, sizes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(a), pa.array(b), blobs], names=["doc_id", "n_shingles", "digest_a", "digest_b", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest_a long, digest_b long, sig binary")


def tokens(classes: DataFrame) -> DataFrame:
    """(token, rep) of every coordinate: the coordinate number and its value, as one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(K, dtype=np.int64) << 32
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, K)
            reps = np.repeat(np.asarray(batch.column("rep")), K)
            yield pa.RecordBatch.from_arrays([pa.array((sig.astype(np.int64) + place).ravel()), pa.array(reps)], names=["token", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "token long, rep long")


def postings(classes: DataFrame, ws: Workspace) -> DataFrame:
    """(token, rep, weight) of each class's prefix, without tokens that occur once.

    The weight of a class is how often others share its tokens.  Counts are stored, so that both
    sides of the join are plain shuffles and a token that very many classes share is split.
    """
    counts = ws.save(tokens(classes).groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1"), "counts", few=True)
    shared = tokens(classes).join(counts, "token")
    by_class = shared.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("ts"), F.sum("freq").alias("weight"))
    kept = by_class.withColumn("keep", F.lit(PREFIX - K) + F.size("ts")).filter("keep > 0")
    return kept.select(F.explode(F.slice("ts", F.lit(1), F.col("keep"))).alias("t"), "rep", "weight").select("t.token", "rep", "weight")


def _top(what: str, size: str) -> Column:
    """The ``what`` with the largest ``size``, ties by a hash: a maximum by a long, which hashing aggregates."""
    return F.max_by(what, F.shiftleft(F.least(F.col(size), F.lit((1 << 31) - 1)), 32) + F.xxhash64(what).bitwiseAND(F.lit((1 << 32) - 1)))


def collide(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree on at least ``MATCHES`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, K) for c in ("sa", "sb"))
            yield batch.filter(pa.array((x == y).sum(1) >= MATCHES)).select(["a", "b"])

    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    return few_tasks(both.select("a", "b", "sa", "sb")).mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (pivot a, member b) with 100 * |A & B| >= percent * |A | B| on full shingle sets.

    Members of a pivot are dealt over salts by number; each (pivot, salt) group streams through one
    task with the pivot's set in hand.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    members = salted.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "text")
    pivots = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, np.zeros(0, U64)
        for batch in by_bytes(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            keys = zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), batch.column("role").to_pylist(), batch.column("b").to_pylist(), sets, strict=True)
            a, b = [], []
            for pivot_id, salt, role, member, s in keys:
                if role == 0:
                    at, pivot = (pivot_id, salt), s
                elif at == (pivot_id, salt):
                    common = len(np.intersect1d(pivot, s, assume_unique=True))
                    if common and 100 * common >= percent * (len(pivot) + len(s) - common):
                        a.append(pivot_id)
                        b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = pivots.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return few_tasks(dealt).mapInArrow(run, "a long, b long")


def dealt_blocks(members: DataFrame, block: int, ws: Workspace, name: str) -> DataFrame:
    """Members (p, x, component, ...) of each pivot's group dealt into blocks of comparisons (p, i, j).

    The minor side (not in the group's largest component) has rows i, the whole group columns j; each
    block holds at most about ``block`` rows of either side.  ``role`` is 0 for rows of a group that is
    one block, 1 for the minor side, 2 for the whole.  The shapes of the groups are stored, so they are
    broadcast if few, and otherwise the join with them is of plain shuffles and hot groups are split.
    """
    per = members.groupBy("p", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = per.groupBy("p").agg(F.sum("n").alias("n"), F.max("n").alias("top"), _top("component", "n").alias("major")).filter("top < n")
    shape = shape.select("p", "major", F.ceil((F.col("n") - F.col("top")) / block).alias("rows"), F.ceil(F.col("n") / block).alias("columns"))
    m = members.join(small(ws.save(shape, f"{name}-shape", few=True)), "p").withColumn("minor", F.col("component") != F.col("major"))
    one = (F.col("rows") == 1) & (F.col("columns") == 1)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spot = lambda i, j, role: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(role).alias("role"))
    as_minor = F.when(F.col("minor"), F.transform(every(F.col("columns")), lambda j: spot(F.pmod(F.xxhash64("x", F.lit(1)), F.col("rows")), j, 1)))
    as_whole = F.transform(every(F.col("rows")), lambda i: spot(i, F.pmod(F.xxhash64("x", F.lit(2)), F.col("columns")), 2))
    spots = F.when(one, F.array(spot(F.lit(0), F.lit(0), 0))).otherwise(F.concat(F.coalesce(as_minor, F.expr("cast(array() as array<struct<i:bigint,j:bigint,role:int>>)")), as_whole))
    return m.withColumn("spot", F.explode(spots)).select("p", "spot.i", "spot.j", "spot.role", "minor", "x", "component")


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block (p, i, j) at a time, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = np.column_stack([np.asarray(batch.column(c)) for c in ("p", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if at is not None and tuple(keys[a]) != at:
                yield pa.Table.from_batches(held)
                held = []
            at = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sides(block: pa.Table) -> tuple[np.ndarray, ...]:
    """Row numbers of the minor side and of the whole side, ids and components."""
    role, minor = np.asarray(block["role"]), np.asarray(block["minor"])
    return np.flatnonzero((role == 1) | ((role == 0) & minor)), np.flatnonzero(role != 1), np.asarray(block["x"]), np.asarray(block["component"])


def collisions(sig: np.ndarray, other: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of ``sig`` in turn, the rows of ``other`` that agree with it on ``MATCHES`` coordinates.

    The K - MATCHES + 1 shortest posting lists of a row are merged: who agrees on ``MATCHES`` coordinates
    is in one of them.  The others are skipped, and looked up for those candidates alone.
    """
    place = np.arange(K, dtype=np.int64) << 32
    posted = (other.astype(np.int64) + place).ravel()
    order = np.argsort(posted, kind="stable")
    posted, owner = posted[order], order // K
    for row in sig:
        own = row.astype(np.int64) + place
        lo, hi = np.searchsorted(posted, own, "left"), np.searchsorted(posted, own, "right")
        lists = np.argsort(hi - lo, kind="stable")
        short, long = lists[:PREFIX], lists[PREFIX:]
        short = short[hi[short] > lo[short]]
        if not len(short):
            yield short
            continue
        found, counts = np.unique(np.concatenate([owner[lo[c] : hi[c]] for c in short]), return_counts=True)
        near = counts + K - PREFIX >= MATCHES
        found, counts = found[near], counts[near]
        yield found[counts + (other[found][:, long] == row[long]).sum(1) >= MATCHES]


def active(members: DataFrame, sigs: DataFrame, ws: Workspace) -> DataFrame:
    """Members (p, x) with a partner in another component of the group that agrees on ``MATCHES`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _per_block(batches):
            a, b, x, component = _sides(block)
            sig = np.frombuffer(b"".join(block["sig"].to_pylist()), np.uint32).reshape(-1, K)
            hit = np.zeros(len(x), bool)
            for k, found in zip(a, collisions(sig[a], sig[b]), strict=True):
                good = b[found][component[b[found]] != component[k]]
                hit[good] = True
                hit[k] |= len(good) > 0
            found = pa.array(x[hit], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block["p"][0].as_py()), pa.int64()), found], names=["p", "x"])

    rows = dealt_blocks(members, SIG_BLOCK, ws, "active").join(sigs.select(F.col("rep").alias("x"), "sig"), "x").select("p", "i", "j", "role", "minor", "x", "component", "sig")
    return few_tasks(rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")).mapInArrow(run, "p long, x long").distinct()


def block_links(members: DataFrame, texts: DataFrame, width: int, percent: int, ws: Workspace) -> DataFrame:
    """Links (a, b) between components of a group, on full shingle sets: a spanning forest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _per_block(batches):
            a, b, _, component = _sides(block)
            sets = [s for part in by_bytes(iter(block.to_batches()), "text") for s in shingle_sets(part.column("text"), width)]
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(b)), sizes[b])
            values = np.concatenate([sets[k] for k in b])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]

            def pairs() -> Iterator[tuple[int, int]]:
                for k in a:
                    lo, hi = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
                    n = hi - lo
                    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                    common = np.bincount(owner[at], minlength=len(b))
                    good = (100 * common >= percent * (sizes[k] + sizes[b] - common)) & (common > 0) & (component[b] != component[k])
                    yield from ((int(component[k]), int(component[b[g]])) for g in np.flatnonzero(good))

            links = list(union_find(pairs()))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["a", "b"])

    rows = dealt_blocks(members, TEXT_BLOCK, ws, "block").join(texts.withColumnRenamed("doc_id", "x"), "x").select("p", "i", "j", "role", "minor", "x", "component", "text")
    return few_tasks(rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose ``width``-word shingle sets are at least ``percent`` % similar.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.  Words are maximal
    runs without white space, A-Z lowered; a text with fewer than ``width`` words has its whole sequence
    as one shingle; null and empty texts have none and are linked with nothing.  Returns one row per
    input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)
    and kept (doc_id = component_id).  Rows that share a doc_id count as one node; a row without
    doc_id is never linked, has a null component_id and is kept.  No rows in, no rows out.
    """
    if percent < 80:
        raise ValueError("the signature thresholds are set for a similarity of 0.8 or more")
    ws = Workspace(docs.sparkSession, "minhash")
    digest = ["n_shingles", "digest_a", "digest_b"]
    signed = ws.save(sign(docs, width), "signed")
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = ws.save(full.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes", few=True)
    posts = ws.save(postings(classes, ws), "posts", few=True)

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """Texts of the given doc_ids, stored; rows that repeat both count once."""
        found = small(ws.save(ids.distinct(), f"{name}-ids", few=True))
        return ws.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, "doc_id").dropDuplicates(["doc_id", "text"]), f"{name}-texts", few=True)

    pivots = ws.save(posts.groupBy("token").agg(_top("rep", "weight").alias("p")), "pivots", few=True)
    group = ws.save(posts.join(pivots, "token").select("p", F.col("rep").alias("x")).distinct(), "group", few=True)
    hits = ws.save(collide(group.filter("p <> x").select(F.col("p").alias("a"), F.col("x").alias("b")), classes), "hits", few=True)
    salts = hits.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).alias("salts"))
    salts = small(ws.save(salts, "salts", few=True))
    texts = texts_of(hits.select(F.explode(F.array("a", "b")).alias("doc_id")), "star")
    links = confirm(hits.join(salts, "a"), texts, width, percent)
    stars = small(components(links, ws, "star").select(F.col("node").alias("x"), "component"))

    members = ws.save(group.join(stars, "x", "left").withColumn("component", F.coalesce("component", "x")), "members", few=True)
    alive = ws.save(active(members, classes, ws).join(members, ["p", "x"]), "active", few=True)
    more = block_links(alive, texts_of(alive.select(F.col("x").alias("doc_id")), "block"), width, percent, ws)
    joined = small(components(more, ws, "block").select(F.col("node").alias("component"), F.col("component").alias("whole")))

    of_class = classes.select(*digest, F.col("rep").alias("x")).join(stars, "x", "left").withColumn("component", F.coalesce("component", "x")).join(joined, "component", "left")
    of_class = of_class.select(*digest, F.coalesce("whole", "component").alias("class_component"))
    joined = signed.select("doc_id", *digest).join(of_class, digest, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id")))
    out = joined.withColumn("component_id", component).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return ws.result(out, "components")


#: Two-word shingles at 0.8 by an exact join on shingles, and components by reachability, in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS sh FROM d),
sets AS (SELECT rid, doc_id, len(sh)::BIGINT AS n, sh, md5(array_to_string(sh, chr(10))) AS digest FROM s),
classes AS (SELECT digest, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM sets WHERE n > 0 AND doc_id IS NOT NULL GROUP BY digest),
posted AS (SELECT digest, n, unnest(sh) AS x FROM classes),
common AS (SELECT a.digest AS a, b.digest AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM posted a JOIN posted b ON a.x = b.x AND a.digest < b.digest GROUP BY 1, 2),
near AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT digest, digest FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT r.a AS digest, min(c.rep) AS part FROM reach r JOIN classes c ON r.b = c.digest GROUP BY 1)
SELECT doc_id, sets.n AS n_shingles, CASE WHEN sets.n > 0 THEN part ELSE doc_id END AS component_id, coalesce(doc_id = CASE WHEN sets.n > 0 THEN part ELSE doc_id END, true) AS kept
FROM sets LEFT JOIN parts USING (digest)
"""
