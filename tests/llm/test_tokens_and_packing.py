"""Token files round-trip exactly; packing equals a plain best fit."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pfs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlscan.llm import packing, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "   x  y z  ", "\n\nx \n y", "a.b,c . ,d", "it's, he'll. x", "é, ö. ×, ÷. à à", "<|endoftext|> a <|endoftext|>,b", "", None, " ", "\n", "x\n", "1,2.3 4, 5.", "漢字 漢字, か.", "\x1c a \x1f b", "　a 　 b", "a\r\nb c", "a\u0085 b", "\U0001f600 \U0001f600, z."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(tokenizer, texts):
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_units_give_the_tokenizer_s_ids(tokenizer):
    encoder = token_files.UnitEncoder(PATH)

    def check(texts):
        ids, lens = encoder.encode(pa.array(texts, pa.string()), 0)
        want = plain(tokenizer, texts)
        assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    check(ODD)
    check([None, ""])
    part = st.sampled_from(list("ab ,.\n'é×  \t1漢 ") + ["  ", "<|endoftext|>", "'s", "word", " word"])
    settings(max_examples=150, deadline=None)(given(st.lists(st.lists(part, max_size=12).map("".join), max_size=5))(check))()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=3000), st.integers(0, 3))
def test_blocks_round_trip(ids, skew):
    ids = np.array(ids, np.int64) // (1 + 100 * skew)
    table = token_files.Table.of(np.bincount(ids, minlength=500))
    assert int(table.freq.sum()) == 1 << token_files.BITS
    payload, lanes = token_files.encode_block(ids, table)
    assert token_files.decode_block(payload, len(ids), lanes, table).tolist() == ids.tolist()


def test_coding_is_near_the_entropy():
    ids = (np.random.default_rng(1).zipf(1.3, 200_000) % 50_000).astype(np.int64)
    p = np.bincount(ids) / len(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids)
    table = token_files.Table.of(np.bincount(ids, minlength=50_257))
    assert len(token_files.encode_block(ids, table)[0]) * 8 < 1.06 * bits


def test_files_read_back_exactly(spark, tokenizer):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta,", "gamma.", "δelta", "x"]) for _ in range(rng.randrange(0, 60)))) for k in range(300)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, "long word " * 30_000), (5, "again"), (5, "again"), (None, "no id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string").repartition(5)
    manifest, table, folder = token_files.encode_corpus(df, PATH)
    assert token_files.load_table(spark, folder).crc == table.crc
    got = token_files.read_files(manifest, table).collect()
    ordered = sorted(got, key=lambda r: r["start"])
    ids = [r["doc_id"] for r in ordered]
    assert len(got) == len(rows) and ids == sorted(ids, key=lambda k: -1 if k is None else k)
    by_crc = {}
    for (k, _), w in zip(rows, plain(tokenizer, [t for _, t in rows]), strict=True):
        by_crc.setdefault((k, len(w), zlib.crc32(np.array(w, "<u4").tobytes())), []).append(w)
    start = 0
    for r in ordered:
        assert (r["doc_id"], r["n_tokens"], r["ids_crc32"]) in by_crc and r["start"] == start
        start += r["n_tokens"]
    path = manifest.first()["path"]
    fs, at = token_files.open_fs(path)
    with fs.open_input_file(at) as f:
        data = bytearray(f.read())
    data[20] ^= 1
    with fs.open_output_stream(at) as f:
        f.write(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.read_groups(path, table))


def test_empty_corpus_writes_no_file(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    manifest, table, folder = token_files.encode_corpus(df, PATH)
    assert manifest.count() == 0 and token_files.read_files(manifest, table).count() == 0
    fs, at = token_files.open_fs(folder)
    assert [f.base_name for f in fs.get_file_info(pfs.FileSelector(at))] == ["table.u4"]


def plain_best_fit(sizes, sources, clusters, ties, capacity, per_source):
    bins, out = [], [None] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], ties[k])):
        fits = [
            (capacity - b["fill"], n)
            for n, b in enumerate(bins)
            if b["fill"] + sizes[k] <= capacity and b["sources"].count(sources[k]) < per_source and (clusters[k] is None or clusters[k] not in b["clusters"])
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"fill": 0, "sources": [], "clusters": []})
        out[k] = (n, bins[n]["fill"])
        bins[n]["fill"] += sizes[k]
        bins[n]["sources"].append(sources[k])
        bins[n]["clusters"].append(clusters[k])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_a_block_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    n, capacity = rng.randrange(1, 250), rng.choice([7, 30, 100])
    sizes = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, max(2, capacity // 5)) for _ in range(n)]
    sources = [rng.choice(["hot", "hot", "a", "b", None]) for _ in range(n)]
    clusters = [rng.choice([1, 1, 2, *range(3, 100)]) for _ in range(n)]
    ties = [rng.random() for _ in range(n)]
    args = (sizes, sources, clusters, ties, capacity, rng.choice([1, 2, 4]))
    assert packing.pack_block(*args) == plain_best_fit(*args)


def test_packing_keeps_every_word_and_rule(spark):
    rows = [(k, "w%d " % (k % 50) * (k % 90), ["hot", "hot", "a", None][k % 4], 1) for k in range(600)] + [(700, "long " * 1234, "a", 1), (700, "long " * 1234, "a", 1), (701, None, "a", 1), (702, " ", None, 1), (None, "no id", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    got = packing.pack(df, capacity=100, per_source=2, block_items=150).collect()
    words = {}
    for r in got:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    want = {}
    for k, t, _, _ in rows:
        want[k] = want.get(k, 0) + len((t or "").split())
    assert words == want
    source, bins = {k: s for k, _, s, _ in rows}, {}
    for r in got:
        assert (r["bin"] is None) == (r["n_words"] == 0)
        if r["n_words"]:
            bins.setdefault((r["block"], r["bin"]), []).append(r)
    text = {k: " ".join((t or "").split()).lower() for k, t, _, _ in rows}
    for b in bins.values():
        b.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in b] == [sum(x["n_words"] for x in b[:k]) for k in range(len(b))] and sum(r["n_words"] for r in b) <= 100
        assert max(sum(source[x["doc_id"]] == source[r["doc_id"]] for x in b) for r in b) <= 2
        assert len({text[r["doc_id"]] for r in b}) == len(b)
    assert packing.pack(df.limit(0)).count() == 0


def test_other_splitting_encodes_whole_texts():
    """A tokenizer that does not split at bytes gets whole texts, and long units are never taken for others."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.UnitEncoder(path)
    texts = ["Plain words, and 12 more.\n\nNext  line", None, "", "x" * 5000, "é. ü, ß\n"]
    ids, n = encoder.encode(pa.array(texts), 0)
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert not encoder.units and n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("size", [1, 7, 64])
def test_pieces_do_not_change_ids(monkeypatch, size):
    monkeypatch.setattr(token_files, "PIECE_BYTES", size)
    monkeypatch.setattr(token_files, "UNITS_BYTES", size)
    rng = random.Random(size)
    texts = ["".join(rng.choice(["a", "B", " ", "\n", ".", ",", "é", " ", " ", "12", "'s", "word", "x" * 300]) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, ""]
    encoder = token_files.UnitEncoder(PATH)
    ids, n = encoder.encode(pa.array(texts), 0)
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_ties_pack_alike_in_any_order(spark):
    rows = [(k % 3, "same words here", ["a", "b", None][k % 3 - k % 2]) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_source = [sorted(map(repr, (r[:5] for r in packing.pack(x.coalesce(1)).select("doc_id", "piece", "n_words", "bin", "offset").collect()))) for x in (df, df.orderBy("source", "doc_id"))]
    assert by_source[0] == by_source[1]


@pytest.mark.parametrize("sizes", ["known", "unknown", "wrong"])
def test_new_units_go_to_the_tokenizer_many_to_a_text(tokenizer, sizes):
    encoder, calls = token_files.UnitEncoder(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    if sizes != "known":
        encoder.sizes = None if sizes == "unknown" else encoder.sizes + 1
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdeé", k=6)) for _ in range(500)) + rng.choice([".", "  ", "\n", ", "]) for _ in range(10)] + ODD
    for _ in range(2):
        ids, n = encoder.encode(pa.array(texts, pa.string()), 0)
        want = plain(tokenizer, texts)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    if sizes == "known":
        assert len(calls) < 200 < 4000 < encoder.cache.units


def test_unit_cache_holds_what_went_in():
    cache, want, rng = token_files.UnitCache("<u2"), {}, np.random.default_rng(3)
    for step in range(40):
        keys = np.unique(rng.integers(0, 1 << 40, 3000).astype(np.uint64) << np.uint64(20 * (step % 2)))  # odd steps meet in few slots
        keys = np.append(keys[~np.isin(keys, list(want))], [] if step else np.zeros(1, np.uint64)).astype(np.uint64)
        keys = np.unique(keys[:20] if step % 2 else keys)
        sizes = rng.integers(0, 5, len(keys))
        assert (cache.place[cache.slots(keys)] < 0).all()
        ids = rng.integers(0, 1 << 16, sizes.sum()).astype("<u2")
        cache.add(keys, ids, sizes)
        want |= dict(zip(keys.tolist(), map(tuple, np.split(ids, np.cumsum(sizes)[:-1])), strict=True))
    slot = cache.slots(np.array(list(want), np.uint64))
    got = [tuple(cache.ids[a : a + n]) for a, n in zip(cache.place[slot].tolist(), cache.size[slot].tolist(), strict=True)]
    assert got == list(want.values()) and cache.units == len(want) and 2 * cache.units <= len(cache.key)


def test_a_full_cache_starts_anew(monkeypatch, tokenizer):
    monkeypatch.setattr(token_files, "CACHE_UNITS", 50)
    encoder = token_files.UnitEncoder(PATH)
    for k in range(6):
        texts = [f"w{j} x{j}y\n{j}" for j in range(30 * k, 30 * k + 40)]
        ids, n = encoder.encode(pa.array(texts), 0)
        want = plain(tokenizer, texts)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, []) and encoder.cache.units < 250
