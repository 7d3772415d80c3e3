"""Language identification by a convolutional network over bytes, in numpy.

Texts become lower-cased UTF-8 bytes in windows of ``WINDOW``; bytes are embedded, filters of several
widths slide over them, each filter keeps its maximum over the window, and a softmax reads the maxima.
A text's probabilities are the byte-weighted mean over all its windows.  The network is trained on a
bounded sample of labelled texts (``DOCS_PER_LANG``) and applied to every whole text in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import by_bytes, text_bytes

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 4  # of a document in the sample, spread evenly over its whole text
EPOCHS, BATCH, RATE = 8, 64, 0.004
STEP = 256  # windows convolved at once


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # (256, EMBED)
    conv: np.ndarray  # (max width * EMBED, filters); rows past a filter's width stay zero
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _mask() -> np.ndarray:
    reach = np.repeat(WIDTHS, FILTERS)
    return (np.arange(max(WIDTHS) * EMBED)[:, None] // EMBED < reach[None, :]).astype(np.float32)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its row, where it starts and how many bytes it holds."""
    sizes = np.diff(offsets)
    per_row = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), per_row)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[:-1][row] + place * WINDOW
    return row, start, np.minimum(WINDOW, offsets[1:][row] - start)


def grid_of(data: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Zero-padded (windows, WINDOW) bytes."""
    at = np.minimum(start[:, None] + np.arange(WINDOW), max(0, len(data) - 1))
    return np.where(np.arange(WINDOW) < held[:, None], data[at], 0) if len(data) else np.zeros((0, WINDOW), np.uint8)


def _patches(net: Network, grid: np.ndarray) -> np.ndarray:
    x = net.embed[grid]
    span = WINDOW - max(WIDTHS) + 1
    return np.concatenate([x[:, k : k + span] for k in range(max(WIDTHS))], axis=2)


def forward(net: Network, grid: np.ndarray) -> np.ndarray:
    """Softmax probabilities of each window."""
    p = _patches(net, grid)
    pooled = (p.reshape(-1, p.shape[2]) @ net.conv).reshape(len(grid), p.shape[1], -1).max(axis=1)
    z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(grid: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 3) -> Network:
    """Train by Adam on windows and the index of their language; equal weight for each language."""
    rng = np.random.default_rng(seed)
    mask, n_filters = _mask(), FILTERS * len(WIDTHS)
    net = Network(
        langs, (rng.normal(size=(256, EMBED)) * 0.5).astype(np.float32), (rng.normal(size=mask.shape) * 0.3).astype(np.float32) * mask,
        np.zeros(n_filters, np.float32), (rng.normal(size=(n_filters, len(langs))) * 0.2).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    names = ("embed", "conv", "bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    share = len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            g, b = grid[pick], len(pick)
            patches = _patches(net, g)
            maps = (patches.reshape(-1, patches.shape[2]) @ net.conv).reshape(b, patches.shape[1], n_filters)
            arg = maps.argmax(axis=1)
            pooled = np.take_along_axis(maps, arg[:, None, :], 1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(b), y[pick]] -= 1
            dz = p * (share[y[pick]] / b)[:, None].astype(np.float32)
            dh = (dz @ net.out.T) * (pooled > 0)
            best = patches[np.arange(b)[:, None], arg]  # (b, filters, width * EMBED)
            dpatch = dh[:, :, None] * net.conv.T[None]
            bytes_at = g[np.arange(b)[:, None, None], arg[:, :, None] + np.arange(max(WIDTHS))]
            dembed = np.zeros_like(net.embed)
            np.add.at(dembed, bytes_at.ravel(), dpatch.reshape(-1, EMBED))
            grads = {"embed": dembed, "conv": np.einsum("bf,bfk->kf", dh, best) * mask, "bias": dh.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum(0)}
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                getattr(net, k)[...] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(pc.cast(column, pa.string())))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Network | None:
    """The network from at most ``docs_per_lang`` documents of each language that are not held out.

    Documents are taken by a hash of their id, the same in every run; windows are spread evenly over
    each whole text and only they reach the driver.  None without labelled texts.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    draw = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))))
    # the bound holds in expectation; the driver cuts the few rows beyond it
    sample = usable.filter(F.col("text").rlike(r"\p{L}")).filter(draw < F.element_at(share, F.col("lang"))).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            data, offsets = _lowered(batch.column("text"))
            row, start, held = windows_of(offsets)
            number = np.bincount(row, minlength=batch.num_rows)
            first = np.cumsum(number) - number
            chosen = [first[r] + np.unique(np.linspace(0, n - 1, min(n, WINDOWS_PER_DOC)).astype(int)) for r, n in enumerate(number) if n]
            chosen = np.concatenate(chosen) if chosen else np.zeros(0, int)
            chosen = chosen[(held[chosen] >= 16) | (number[row[chosen]] == 1)]
            ids, langs = batch.column("doc_id"), batch.column("lang")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[chosen])), langs.take(pa.array(row[chosen])), pa.array([w.tobytes() for w in grid_of(data, start[chosen], held[chosen])], pa.binary())], names=["doc_id", "lang", "bytes"])

    got = sample.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang string, bytes binary").toArrow().to_pandas()
    got = got.sort_values(["lang", "doc_id", "bytes"], kind="stable").groupby("lang").head(docs_per_lang * WINDOWS_PER_DOC)
    if got.empty:
        return None
    langs = sorted(got["lang"].unique())
    grid = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, WINDOW)
    return fit(grid, np.array([langs.index(x) for x in got["lang"]]), langs)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """The language of every document, from its whole text alone.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.  Returns one row
    per input row: doc_id, held_out, lang_pred and score (probability of lang_pred).  Texts that are
    null or hold no letter, and all texts if ``net`` is None, get ``und`` with score 0; repeated rows each
    get their row; no rows in, no rows out.  A long text takes memory for itself and a few numbers for
    each of its windows, which are convolved ``STEP`` at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some ten thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_bytes(batches, "text"):
            n = batch.num_rows
            lettered = np.asarray(pc.fill_null(batch.column("lettered"), False), bool)
            names, scores = np.full(n, "und", object), np.zeros(n)
            if model and lettered.any():
                data, offsets = _lowered(batch.column("text"))
                row, start, held = windows_of(offsets)
                p = [forward(model, grid_of(data, start[k : k + STEP], held[k : k + STEP])) for k in range(0, len(row), STEP)]
                p = np.concatenate(p) if p else np.zeros((0, len(model.langs)))
                whole = np.column_stack([np.bincount(row, p[:, k] * held, n) for k in range(len(model.langs))])
                whole /= np.maximum(np.bincount(row, held, n), 1)[:, None]
                names[lettered] = np.array(model.langs, object)[whole.argmax(1)][lettered]
                scores[lettered] = np.clip(whole.max(1), 0, 1)[lettered]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    return shaped.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
