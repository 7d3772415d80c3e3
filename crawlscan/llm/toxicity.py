"""Toxicity by a classifier chain of linear models over word features.

Categories are predicted in turn; the model of a category sees the words of a text and the
probabilities of all earlier categories.  While training, those are out-of-fold predictions: each
document's earlier probabilities come from models that never saw it, so later models learn from
inputs as noisy as the ones they will meet.

Training runs on a bounded sample of labelled rows (``MAX_TRAIN``), whose distinct feature hashes
alone reach the driver; prediction runs over every whole text, in one pass, with a few thousand weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import NOT_ALNUM, U64, by_bytes, word_hashes

MAX_TRAIN = 5_000
FEATURES = 2000  # of a model, those with the most evidence
MIN_DOCS = 3  # of the sample, that a feature must be in
FOLDS = 5
PREFIXES = (5, 6, 7)  # bytes; compounds of one abusive stem share them
MIN_EVIDENCE = 1.7  # a feature's likelihood ratio must exceed exp(this * log(candidates) / 2)
#: Derived categories before the labelled one: documents with a term tied to the label, and with several.
CATEGORIES = ("abusive_term", "repeated_abuse", "toxic")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes (bare lower-cased words and their prefixes) and the row of each."""
    words, offsets, *starting = word_hashes(pc.utf8_lower(pc.cast(column, pa.string())), NOT_ALNUM, PREFIXES)
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    return np.concatenate([words, *starting]), np.tile(rows, 1 + len(PREFIXES))


@dataclass
class Linear:
    """A logistic model over selected feature hashes and earlier probabilities."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows: np.ndarray, hashes: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of ``n`` rows from their distinct (row, feature hash) pairs."""
        z = np.full(n, self.bias)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            z += np.bincount(rows[hit], self.weights[at[hit]], n)
        if len(self.earlier):
            z += _logit(earlier) @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


@dataclass
class Sample:
    """Labelled rows: distinct (row, feature id) pairs, the sorted feature hashes, label, weight, fold."""

    rows: np.ndarray
    ids: np.ndarray
    vocabulary: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray


def evidence(rows: np.ndarray, ids: np.ndarray, size: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio (G) of each feature's presence against ``y``, and whether it speaks for 1."""
    n, n1 = len(y), y.sum()
    both = np.bincount(ids, minlength=size).astype(float)
    pos = np.bincount(ids, y[rows], size)
    cells = ((pos, both, n1), (both - pos, both, n - n1), (n1 - pos, n - both, n1), (n - n1 - both + pos, n - both, n - n1))
    g = sum(o * np.log(np.maximum(o, 1e-12) * n / np.maximum(r * c, 1e-12)) for o, r, c in cells)
    return np.where(both > 0, 2 * g, 0.0), pos * n > both * n1


def fit_linear(s: Sample, inside: np.ndarray, y: np.ndarray, earlier: np.ndarray, steps: int = 200, rate: float = 0.3, decay: float = 5e-5) -> Linear:
    """Fit by Adam on rows ``inside``, with the ``FEATURES`` best of the features whose evidence cannot be chance."""
    number = np.cumsum(inside) - 1
    pick = inside[s.rows]
    rows, ids, target, w = number[s.rows[pick]], s.ids[pick], y[inside], s.weight[inside] / s.weight[inside].sum()
    g, _ = evidence(rows, ids, len(s.vocabulary), target)
    order = np.argsort(-g, kind="stable")[:FEATURES]
    chosen = np.sort(order[g[order] > MIN_EVIDENCE * np.log(len(s.vocabulary) + 2)])
    place = np.full(len(s.vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[ids] >= 0
    r, f = rows[keep], place[ids[keep]]
    x = _logit(earlier[inside])
    theta = np.zeros(len(chosen) + x.shape[1] + 1)
    share = (w * target).sum()
    theta[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        a, u, b = theta[: len(chosen)], theta[len(chosen) : -1], theta[-1]
        z = b + np.bincount(r, a[f], len(target)) + x @ u
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * w
        grad = np.concatenate([np.bincount(f, d[r], len(chosen)), x.T @ d, [d.sum()]]) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(s.vocabulary[chosen], theta[: len(chosen)], theta[len(chosen) : -1], float(theta[-1]))


@dataclass
class Chain:
    """Models in chain order and the decision threshold of the last."""

    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def predict(self, rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            out = np.column_stack([out, model.predict(rows, hashes, n, out)])
        return out


def derived_targets(s: Sample) -> np.ndarray:
    """0/1 columns of positive rows: has a term tied to the label in the other folds; has several."""
    terms = np.zeros(len(s.y))
    for k in range(FOLDS):
        train = s.fold[s.rows] != k
        number = np.cumsum(s.fold != k) - 1
        g, speaks = evidence(number[s.rows[train]], s.ids[train], len(s.vocabulary), s.y[s.fold != k])
        tied = speaks & (g > MIN_EVIDENCE * np.log(len(s.vocabulary) + 2))
        held = ~train & (s.y[s.rows] == 1)
        terms += np.bincount(s.rows[held], tied[s.ids[held]], len(s.y))
    return np.column_stack([terms >= 1, terms >= 3]).astype(float)


def fit_chain(s: Sample, earlier: dict[str, np.ndarray] | None = None) -> Chain:
    """Train the chain; the threshold is the one with the best weighted F1 out of fold.

    ``earlier`` has the 0/1 labels of the categories before the last; without it they are derived.
    """
    before = np.column_stack(list(earlier.values())) if earlier else derived_targets(s)
    goals, categories = np.column_stack([before, s.y]), (*earlier, CATEGORIES[-1]) if earlier else CATEGORIES
    pair_hashes = s.vocabulary[s.ids]
    chain, held_out, everyone = Chain(categories), np.zeros((len(s.y), 0)), np.ones(len(s.y), bool)
    for k in range(goals.shape[1]):
        column = np.zeros(len(s.y))
        for fold in range(FOLDS):
            inside = s.fold != fold
            if inside.any() and not inside.all():
                model = fit_linear(s, inside, goals[:, k], held_out)
                column[~inside] = model.predict(s.rows, pair_hashes, len(s.y), held_out)[~inside]
        chain.models.append(fit_linear(s, everyone, goals[:, k], held_out))
        held_out = np.column_stack([held_out, column])
    grid = np.round(np.arange(0.1, 0.91, 0.05), 2)
    yes = [held_out[:, -1] >= c for c in grid]
    f1 = np.array([2 * (s.weight * (h & (s.y == 1))).sum() / ((s.weight * h).sum() + (s.weight * s.y).sum()) for h in yes])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    chain.threshold = float(grid[best[len(best) // 2]])
    return chain


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, earlier: tuple[str, ...] = ()) -> Chain | None:
    """The chain from at most ``max_train`` labelled documents, half of either kind at most.

    ``earlier`` names columns of ``labels`` with further categories (1 yes; 0 and null no), predicted before
    ``toxic`` in their order; without them two are derived from the words tied to the label.
    Rows are taken in the order of a hash of doc_id, so the sample is the same in every run, and are
    weighted back to the shares of all labels.  Returns None without labelled rows of both kinds.
    """
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("y"), F.array(*(F.coalesce(F.max(c) > 0, F.lit(False)).cast("int") for c in earlier)).cast("array<int>").alias("more")
    )
    totals = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(totals) < 2:
        return None
    deal = F.xxhash64("label_id", F.lit(11))
    parts = [marks.filter(F.col("y") == k).orderBy(deal, "label_id").limit(max_train // 2) for k in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]).withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(FOLDS)).cast("int")))  # max_train rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            hashes, rows = features(batch.column("text"))
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            first = np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))[: len(rows)]
            hashes, ends = hashes[first], np.cumsum(np.bincount(rows[first], minlength=batch.num_rows))
            blobs = pa.array([part.tobytes() for part in np.split(hashes, ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label_id", "y", "more", "fold")), blobs], names=["id", "y", "more", "fold", "words"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, F.col("doc_id") == F.col("label_id")).select("label_id", "y", "more", "fold", "text")
    got = found.mapInArrow(run, "id long, y int, more array<int>, fold int, words binary").toArrow().sort_by("id")
    y, fold = np.asarray(got["y"]).astype(float), np.asarray(got["fold"])
    if not 0 < y.sum() < len(y):
        return None
    sets = [np.frombuffer(b, U64) for b in got["words"].to_pylist()]
    rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    vocabulary, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = counts >= MIN_DOCS
    keep = often[ids]
    ids = (np.cumsum(often) - 1)[ids[keep]]
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    columns = np.array(got["more"].to_pylist(), float).reshape(len(y), len(earlier))
    return fit_chain(Sample(rows[keep], ids, vocabulary[often], y, weight, fold), dict(zip(earlier, columns.T, strict=True)))


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """Category probabilities of every document, from its whole text.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.  Returns one row
    per input row: doc_id, p_<category> for each and toxic (the last probability reaches the
    threshold).  Null, empty and wordless texts, and all texts if ``chain`` is None, get 0 and false;
    repeated rows each get their row; no rows in, no rows out.  A long text takes memory in proportion to
    its words, as their hashes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few thousand weights
    categories = chain.categories if chain else CATEGORIES
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = np.unique(np.concatenate([m.words for m in model.models])) if model else np.zeros(0, U64)
        known = known if len(known) else np.zeros(1, U64)
        maybe = np.zeros(1 << 16, bool)
        maybe[(known >> U64(48)).astype(np.int64)] = True
        for batch in by_bytes(batches, "text"):
            n = batch.num_rows
            p, worded = np.zeros((n, len(names))), np.zeros(n, bool)
            if model:
                hashes, rows = features(batch.column("text"))
                worded = np.bincount(rows, minlength=n) > 0
                hit = np.flatnonzero(maybe[(hashes >> U64(48)).astype(np.int64)])
                rows, at = rows[hit], np.minimum(np.searchsorted(known, hashes[hit]), len(known) - 1)
                exact = known[at] == hashes[hit]
                pairs = np.unique(rows[exact] * len(known) + at[exact])
                p = model.predict(pairs // len(known), known[pairs % len(known)], n) * worded[:, None]
            toxic = worded & (p[:, -1] >= model.threshold) if model else worded
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(toxic)], names=["doc_id", *names, "toxic"])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
