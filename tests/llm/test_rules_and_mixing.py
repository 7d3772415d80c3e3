"""Quality rules and source mixing: against SQL, brute force and edge cases."""

import glob
import math
import os
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlscan.llm import mixing, quality_rules
from crawlscan.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = db.execute(Q.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h " * 3, "x " * 40, "p q r s t u v w x y z " * 2 + "end", "line\nline\n\nline\n", "  é\U0001f600 # *** |<>&$%",
    " ".join(f"w{k}" for k in range(5000)), " ".join(f"w{k % 700}" for k in range(5000)), "a b c d e f g h i a b c d e f g h",
]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(TEXTS)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(df, labels).collect()}
    for k, t in enumerate(TEXTS):
        want = counts(t)
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert got[k]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and got[k]["kept"] == (not got[k]["base_failed"])


def test_binomial_cdf_is_exact(spark):
    cases = [(0, 10), (3, 10), (10, 10), (5, 1000), (40, 3000), (200, 20000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.0125).alias("p")).collect():
        want = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.0125) + (r["n"] - i) * math.log(1 - 0.0125)) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_cutoffs_need_enough_labels_and_limit_false_rejections(spark):
    good = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", "s") for k in range(1500)]
    bad = [(2000 + k, " ".join(f"w{k}x{j}***" for j in range(30)), "en", "s") for k in range(20)] + [(3000 + k, " ".join(f"w{k}x{j}***" for j in range(30)), "fr", "s") for k in range(20)]
    few = [(4000 + k, " ".join(f"w{k}x{j}" for j in range(30)), "fr", "s") for k in range(20)]
    df = spark.createDataFrame(good + bad + few, DOCS)
    labels = spark.createDataFrame([(r[0], 1) for r in good + few] + [(5000, None)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, labels).collect()}
    assert all(kept[r[0]] for r in good) and not any(kept[2000 + k] for k in range(20))
    assert all(kept[3000 + k] for k in range(20))  # 20 labels certify nothing in this stratum


def test_cutoffs_equal_brute_force(spark):
    """Levels by exact sums, with strata that certify all, some and no levels, and the same rows from the SQL."""
    rng, rows, marks = random.Random(9), [], []
    for lang, n, spoiled in (("en", 400, 3), ("fr", 190, 0), ("de", 300, 40), (None, 260, 1), ("es", 100, 0)):
        for k in range(n):
            junk = rng.choice([" #", " *" * 9, " %" * 25, " UPPER CASED WORDS" * 9, "\nline\nline", " |" * 70]) if k < spoiled else ""
            rows.append((len(rows), " ".join(f"w{len(rows)}x{j}" for j in range(30)) + junk, lang, "s"))
            marks.append((rows[-1][0], 1, 0))
        rows += [(len(rows) + k, " ".join(f"v{k}x{j}" for j in range(30)) + " $" * (4 * k), lang, "s") for k in range(20)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    scores = {r["doc_id"]: r for r in quality_rules._scored(docs).collect()}
    levels = {}
    for lang in {r[2] for r in rows}:
        good = [scores[k] for k, _, _ in marks if rows[k][2] == lang and not scores[k]["base_failed"]]
        for level in range(quality_rules.LEVELS):
            k = sum(any(g[r] > cuts[level] for r, cuts in quality_rules.RULES.items()) for g in good)
            if sum(math.comb(len(good), i) * 0.02**i * 0.98 ** (len(good) - i) for i in range(k + 1)) > 0.1 / 5:
                break
            levels[lang] = level + 1
    assert len(set(levels.values())) >= 2 and max(levels.values()) == quality_rules.LEVELS and len(levels) < 5
    for k, _, lang, _ in rows:
        failed = [r for r, cuts in quality_rules.RULES.items() if lang in levels and scores[k][r] > cuts[levels[lang] - 1]]
        assert got[k]["level"] == levels.get(lang) and got[k]["failed_rules"] == failed and got[k]["kept"] == (not failed and not scores[k]["base_failed"])
    db = duckdb.connect()
    db.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source"), map(list, zip(*rows, strict=True)), strict=True))))
    db.register("labels", pa.table(dict(zip(("doc_id", "quality", "toxic"), map(list, zip(*marks, strict=True)), strict=True))))
    assert dict(db.execute(f"SELECT doc_id, kept FROM ({quality_rules.oracle()})").fetchall()) == {k: r["kept"] for k, r in got.items()}


def test_rejected_rows_go_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 7), (2, " ".join(map(str, range(50))), None, None, 8), (None, " ".join(map(str, range(50))), "en", "s", 9)], DOCS + ", n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.kept_documents(df, labels)
    assert got.columns == df.columns and sorted(r["n_words"] for r in got.collect()) == [8, 9]
    dotted = df.withColumn("a.b`c", F.lit(1))
    assert quality_rules.kept_documents(dotted, labels).columns == dotted.columns and mixing.mixed_documents(dotted).columns == dotted.columns
    assert quality_rules.kept_documents(df.limit(0), labels).count() == 0 and quality_rules.judge(df.limit(0), labels).count() == 0


def brute_targets(sizes, weights, share, cap):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed, open_ = share * sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > cap * sizes[s]}
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_mix_meets_its_targets(spark):
    rows = [(k, "w " * (k % 37), "en", [None, "b", "a", "hot", "hot"][k % 5]) for k in range(400)] + [(500, "big " * 3000, "en", "c"), (501, None, "en", "c"), (502, "", "en", "empty"), (None, "x y", "en", "a"), (7, "w " * 7, "en", "a"), (7, "w " * 7, "en", "a")]
    df = spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("clash")).withColumn("size", F.lit(-1))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(3)).collect()))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes), (3, 1, 2), 1.5, 2.0)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_documents_repeat_whole_rows(spark):
    df = spark.createDataFrame([(k, "w " * (1 + k % 9), "en", "ab"[k % 2], k, "x", 1, 2) for k in range(60)], DOCS + ", mixed int, target string, rank int, epochs int")
    plan = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix(df).collect()}
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and Counter(r["doc_id"] for r in got.collect()) == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_better_documents_come_earlier(spark):
    df = spark.createDataFrame([(k, ("w " if k % 2 else "w# ") * 10, "en", "s") for k in range(2000)] + [(5000 + k, "w " * 10, "en", "t") for k in range(6000)], DOCS)
    got = mixing.mix(df, weights=(1, 6), share=1.0).filter("source = 's'").collect()
    clean, dirty = (sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (1, 0))
    assert clean > 1.5 * dirty
