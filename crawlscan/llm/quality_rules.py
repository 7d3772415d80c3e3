"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Fixed base rules reject short and self-repeating documents.  Four further rules (symbols, capitals,
repeated lines, repeated words) each reject documents whose score passes a cutoff, and the cutoffs
come from labelled holdouts.  They tighten together in a fixed sequence of levels.  For every stratum
(language) and level an exact binomial test asks whether all rules of the level together falsely
reject good documents at a rate of ``risk`` or more: the p-value is P(X <= k) for X ~ Binomial(n, risk),
k of n labelled good documents being rejected by any of them.  Levels are tested in their order until
one fails, which needs no correction within a stratum (fixed-sequence testing), and each stratum has
``delta`` over the number of strata to spend (Bonferroni).  With probability 1 - delta, then, no stratum
loses more than ``risk`` of its good documents to these rules.  Strata with fewer than
log(delta / strata) / log(1 - risk) labelled good documents that pass the base rules, 183 if there are
four, get no cutoffs.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, drop_chars, small, whole_row

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: rule -> its cutoff at each level, loosest first; a document goes when its score is above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.2, 1.6, 0.8, 0.6, 0.4, 0.2, 0.1),
    "capital_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_lines_per_100_words": (8.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.5),
    "repeat_word_share": (0.275, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05),
}
LEVELS = len(RULES["symbols_per_word"])
RISK, DELTA = 0.02, 0.1


def features(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Counts of each document, from its whole text (null text: none), and the input ``row`` if asked.

    Words are split once; 8-word windows become 64-bit hashes and only texts in which a hash occurs
    twice sort them with their positions, so a text costs n log n at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col("lang").alias("stratum"), text.alias("t"), *(whole_row(docs).alias("row") for _ in range(keep_rows)))
    base = base.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    base = base.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))).withColumn("n_words", F.size("words").cast("long"))
    windows = F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    base = base.withColumn("windows", windows).withColumn("distinct_windows", F.size(F.array_distinct("windows")))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("placed", F.when(F.col("distinct_windows") < F.size("windows"), placed))
    h = lambda i: F.get("placed", i)["h"]
    again = F.filter("placed", lambda x, i: x["h"].eqNullSafe(h(i - 1)) | x["h"].eqNullSafe(h(i + 1)))
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("starts", zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    joined = F.array_join("words", "")
    return base.withColumn("starts", starts).select(
        "doc_id", "stratum", "n_words", F.length(joined).cast("long").alias("word_chars"),
        (F.length("t") - F.length(drop_chars(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("placed").isNull(), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"), *(F.col("row") for _ in range(keep_rows)),
    )


def _scores() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "capital_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines_per_100_words": 100 * F.col("n_dup_lines") / n,
        "repeat_word_share": F.col("n_repeat_words") / n,
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly, by the ratio of successive terms in log space."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(term, a["total"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["total"] - top))).alias("total"))

    more = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(more, start, step, lambda a: a["total"]))


def cutoffs(scored: DataFrame, risk: float, delta: float, ws: Workspace) -> DataFrame:
    """The last certified level of each stratum, from labelled rows: stratum, level (from 1).

    Rejections are counted per stratum over the whole holdout in one aggregate; the tests run on the
    few counts.  Rejections grow with the level, and p-values with them, so the levels that pass before
    the first failure are all that pass.  Where k >= n p no test can pass, so none is computed.
    """
    rejected = [functools.reduce(operator.or_, (F.col(rule) > cuts[j] for rule, cuts in RULES.items())) for j in range(LEVELS)]
    counts = scored.filter("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(r).alias(f"k{j}") for j, r in enumerate(rejected)))
    counts = ws.save(counts, "counts")
    strata = counts.count()  # one number
    levels = counts.select("stratum", "n", F.posexplode(F.array(*(F.col(f"k{j}") for j in range(LEVELS)))).alias("level", "k"))
    passed = levels.filter(F.col("k") < F.col("n") * risk).filter(binomial_cdf(F.col("k"), F.col("n"), risk) <= F.lit(delta / max(1, strata)))
    return passed.groupBy("stratum").agg((F.max("level") + 1).alias("level"))


def _scored(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    rows = features(docs, keep_rows).withColumns(_scores())
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _judged(rows: DataFrame, labels: DataFrame, risk: float, delta: float, ws: Workspace) -> DataFrame:
    """Stored ``rows`` with level, failed_rules and kept."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg((F.max("quality") == 1).alias("good"))
    scored = rows.filter("NOT base_failed").select("doc_id", "stratum", *RULES).join(marks, F.col("doc_id") == F.col("label_id"))
    cuts = small(ws.save(cutoffs(scored, risk, delta, ws).withColumnRenamed("stratum", "cut_stratum"), "cutoffs"))
    judged = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    cut = lambda rule: F.element_at(F.array(*map(F.lit, RULES[rule])), F.col("level"))
    failed = F.array_compact(F.array(*(F.when(F.col("level").isNotNull() & (F.col(r) > cut(r)), F.lit(r)) for r in RULES)))
    return judged.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts and verdict of every document.

    ``docs`` needs doc_id, text and lang (the stratum); ``labels`` needs doc_id and quality (1 good,
    0 bad, null unlabelled); other columns are ignored.  Returns one row per input row: doc_id,
    stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, level (of the
    stratum's cutoffs, null for none), failed_rules and kept.  Null texts count as empty and fail the
    base rule; a null lang is a stratum of its own; repeated labels of a document count once (good if any
    says so), repeated documents each; without labels only the base rules apply; no rows in, no rows
    out.  A very long text takes memory in proportion to its words, as an array of them.
    """
    ws = Workspace(docs.sparkSession, "quality")
    rows = ws.save(_scored(docs), "features")
    return _judged(rows, labels, risk, delta, ws).select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "level", "failed_rules", "kept"
    )


def kept_documents(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``judge`` keeps; nulls, ties and repeats as there.

    Rows are stored with their features, which cost far more than a copy of the text: they are computed
    once, and no text is shuffled.
    """
    ws = Workspace(docs.sparkSession, "quality")
    return _judged(ws.save(_scored(docs, keep_rows=True), "features"), labels, risk, delta, ws).filter("kept").select("row.*")


def oracle() -> str:
    """The same verdicts in DuckDB SQL."""
    loosest = ", ".join(f"({j + 1}, {', '.join(f'{cuts[j]}::DOUBLE' for cuts in RULES.values())})" for j in range(LEVELS))
    above = " OR ".join(f"f.{r} > v.{r}" for r in RULES)
    fails = " OR ".join(f"coalesce(f.{r} > v.{r}, false)" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS win FROM w, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS g(i)),
starts AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, sum(least({WINDOW}, gap))::BIGINT AS n FROM (SELECT rid, i - lag(i, 1, -100) OVER (PARTITION BY rid ORDER BY i) AS gap FROM starts) GROUP BY rid),
f0 AS (SELECT w.rid, doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_symbols::DOUBLE / greatest(n_words, 1) AS symbols_per_word,
  n_capitals::DOUBLE / greatest(word_chars, 1) AS capital_share, (100 * n_dup_lines)::DOUBLE / greatest(n_words, 1) AS dup_lines_per_100_words,
  n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_word_share FROM f0),
good AS (SELECT f.* FROM f JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1) l ON f.doc_id = l.doc_id WHERE NOT base_failed),
v AS (SELECT * FROM (VALUES {loosest}) v(level, {", ".join(RULES)})),
counts AS (SELECT f.lang, v.level, count(*) AS n, count(*) FILTER (WHERE {above}) AS k FROM good f, v GROUP BY ALL),
p AS (SELECT *, CASE WHEN k < n * {RISK}::DOUBLE THEN list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(greatest(i, 0) + 1) - lgamma(greatest(n - i, 0) + 1) + i * ln({RISK}::DOUBLE) + (n - i) * ln(1 - {RISK}::DOUBLE)))) ELSE 1 END AS p,
  (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) AS strata FROM counts),
c AS (SELECT lang, max(level) AS level FROM p WHERE p <= {DELTA}::DOUBLE / strata GROUP BY lang)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT ({fails})) AS kept
FROM f LEFT JOIN c ON f.lang IS NOT DISTINCT FROM c.lang LEFT JOIN v ON c.level = v.level
"""
