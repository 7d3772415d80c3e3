"""Near-duplicate texts and vectors against brute force."""

import random
import re

import numpy as np
import pytest

from crawlscan.llm import arrow_text, components, minhash, vector_dedup
from crawlscan.llm.arrow_text import shingle_sets, word_hashes
from crawlscan.llm.common import Workspace

import pyarrow as pa


def components_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def expected(rows, width):
    sets = {}
    for k, t in rows:
        sets.setdefault(k, []).append(shingles(t, width))
    ids = [k for k in sets if k is not None]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    return components_of(ids, links)


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    base = [rng.choice(words) for _ in range(120)]
    passage = [rng.choice(words) for _ in range(60)]
    for k in range(150):  # copies with more and more edits: some link, some do not
        w = list(base)
        for _ in range(k // 8):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 + k, " ".join(w)))
    for k in range(60):  # a shared passage alone is no link
        rows.append((2000 + k, " ".join(passage + [rng.choice(words) for _ in range(120)])))
    rows += [(3000 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(100)]
    rows += [(k, " ".join(base).upper()) for k in range(1, 40)]
    rows += [(50, None), (51, ""), (52, " \n\t"), (53, "one"), (54, "One"), (55, "one two"), (56, "two"), (57, "a b a b a b"), (58, "b a"), (60, "Été"), (61, "été")]
    rows += [(70, " ".join(f"x{k % 5000}" for k in range(20000))), (71, " ".join(f"x{k % 5000}" for k in range(20003)))]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, rep string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, width=width).collect()}
    want = expected(rows, width)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(got[k]["n_shingles"] == len(shingles(t, width)) and got[k]["kept"] == (k == want[k]) for k, t in rows)


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted(map(repr, (tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(map(repr, [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (3, 0, 3, True)]))
    with pytest.raises(ValueError):
        minhash.near_duplicates(spark.createDataFrame(rows, schema), percent=50)


def test_blocks_split_large_groups(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SIG_BLOCK", 16)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 8)
    monkeypatch.setattr(minhash, "CHUNK_ROWS", 5)
    rows = corpus()
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == expected(rows, 2)


def test_word_hashes_match_words():
    texts = pa.array(["Ab cd", None, "  x\ty\x0b", "ab", "é x"])
    h, at = word_hashes(texts)
    assert at.tolist() == [0, 2, 2, 4, 5, 7] and h[0] == h[4] and h[2] == h[6] and len(set(h.tolist())) == 5
    assert [len(s) for s in shingle_sets(texts, 2)] == [1, 0, 1, 1, 1]
    assert [len(s) for s in shingle_sets(texts.slice(2), 2)] == [1, 1, 1]


def test_words_are_the_same_whatever_the_pieces(monkeypatch):
    rng = random.Random(2)
    texts = pa.array([None if k % 7 == 3 else "".join(rng.choice("aB \n1é#") for _ in range(rng.choice([0, 3, 40, 400]))) for k in range(60)] + ["x" * 90 + " " + "y" * 33])
    whole = word_hashes(texts), word_hashes(texts, arrow_text.NOT_ALNUM, (5, 6, 7))
    monkeypatch.setattr(arrow_text, "PIECE_BYTES", 16)
    monkeypatch.setattr(arrow_text, "_powers", [])
    pieces = word_hashes(texts), word_hashes(texts, arrow_text.NOT_ALNUM, (5, 6, 7))
    assert all(np.array_equal(x, y) for one, other in zip(whole, pieces, strict=True) for x, y in zip(one, other, strict=True))


def test_merged_lists_count_all_collisions():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 3, (80, minhash.K)).astype(np.uint32)
    sig[40:] = np.where(rng.random((40, minhash.K)) < 0.6, sig[:40], rng.integers(0, 1000, (40, minhash.K))).astype(np.uint32)
    want = (sig[:, None, :] == sig[None]).sum(2) >= minhash.MATCHES
    assert [found.tolist() for found in minhash.collisions(sig, sig)] == [np.flatnonzero(w).tolist() for w in want]


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 200 + k) for k in range(30)] + [(7, 7)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t"), "t").collect()))
    want = components_of({x for e in links for x in e}, links)
    assert all(got.get(k, k) == v for k, v in want.items())
    assert components.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t"), "t").count() == 0
    assert dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t"), "t", finish=0).collect())) == got


def vectors():
    rng = np.random.default_rng(4)
    out = []
    for c in range(12):
        centre = rng.normal(size=64)
        for j in range(12):
            out.append(centre + rng.normal(size=64) * (0.05 + 0.02 * j))
    out += list(rng.normal(size=(300, 64)))
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(out)]
    rows += [(1000 + k, rows[0][1]) for k in range(20)] + [(1100, [3 * x for x in rows[0][1]])]
    return rows


def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    rows = vectors()
    bad = [(2000, None), (2001, [0.0] * 64), (2002, [None] + [1.0] * 63), (2003, [float("nan")] + [1.0] * 63), (2004, [float("inf")] + [1.0] * 63), (2005, []), (2006, [1.0, 2.0]), (2007, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows + bad], "vec_id long, embedding array<float>, rep int")
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df).collect()}
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [k for k, _ in rows]
    want = components_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert {k: got[k]["n_links"] for k in ids} == dict(zip(ids, near.sum(1).tolist(), strict=True))
    assert {k: got[k]["component_id"] for k in ids} == want and all(got[k]["kept"] == (k == want[k]) for k in ids)
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(2000, 2006))
    assert got[2006]["n_links"] == got[2007]["n_links"] == 1 and got[2007]["component_id"] == 2006
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs at cosine 0.95 exactly meet in some table, whatever the width."""
    rng = np.random.default_rng(8)
    for width, n, functions in ((8, 1000, (3, 6)), (64, 1500, (1, 2, 3, 4)), (768, 1000, (2,))):
        recall_at(rng, width, n, functions)


def recall_at(rng, width, n, functions):
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    for k in functions:
        a, b = vector_dedup.codes(x, k), vector_dedup.codes(y, k)
        met = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
        assert met.mean() >= 0.998, (width, k)
