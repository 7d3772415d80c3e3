"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document gets the exponential-race rank ``1 - u ** (1 / w)`` for a seeded uniform ``u`` of its
id and a quality weight ``w``; ascending ranks within a source are a weighted sample without
replacement of any length.  A source first takes as many complete epochs as fit its target; what is
left of the target is cut from the ranked documents by a prefix sum.

The prefix sum never sorts a source in one task.  Ranks are 52-bit integers: sizes are summed by
(source, leading bits), the digit that holds the cut is found in those few sums, and the next round
looks only at rows under that digit.  Three rounds leave the cut row itself, so each row compares
its rank with one stored cut per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, drop_chars, small, whole_row, word_count

SYMBOLS = "#*$%&|<>"
SEED = "mix-1"
RANK_BITS = 52
DIGITS = (40, 28)  # shifts of the two coarse rounds


def text_quality(text: Column) -> Column:
    """Default quality weight in (0, 1]: falls with the share of markup symbols; empty texts get 1."""
    n = F.length(text)
    return F.coalesce(1.0 / (1.0 + F.lit(20.0) * (n - F.length(drop_chars(text, SYMBOLS))) / F.when(n > 0, n)), F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target of each source, from (source, source_size).

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all sizes;
    a target stops at ``cap`` times the source's size and the excess goes to the others by weight.
    One row per source meets in a window: sources, not documents, bound that task.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(place)).withColumn("weight", w).withColumn("full_at", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("full_at", "place").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("full_at"))
    first_open = F.min(F.when(~F.col("capped"), F.struct("full_at", "place", "level"))).over(whole)["level"]
    return leveled.withColumn("open_level", first_open).select(
        "source", "source_size",
        F.when(F.col("capped"), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("open_level") * F.col("weight")).alias("target"),
    )


def _cut(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first group of ``by`` per source whose running size passes ``words_left``."""
    sums = rows.groupBy("source", "words_left", *by).agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("group_rows"))
    running = Window.partitionBy("source").orderBy(*by)
    sums = sums.withColumn("upto", F.sum("group_size").over(running))
    return sums.filter((F.col("upto") > F.col("words_left")) & (F.col("upto") - F.col("group_size") <= F.col("words_left"))).select(
        "source", *by, (F.col("words_left") - (F.col("upto") - F.col("group_size"))).alias("words_left"), "group_rows"
    )


def _keys(seed: str, quality: Column | None) -> list[Column]:
    """size, source, rank and tie of a row."""
    text = F.col("text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    uniform = (F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**RANK_BITS))
    race = 1.0 - F.pow(uniform, 1.0 / (text_quality(text) if quality is None else quality))
    rank = F.least(F.floor(race * F.lit(float(2**RANK_BITS))), F.lit(2**RANK_BITS - 1)).cast("long")
    return [word_count(text).alias("size"), F.col("source"), rank.alias("rank"), name.alias("tie")]


def cuts(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float, ws: Workspace) -> DataFrame:
    """Per source: source_size, target, epochs, and where the fractional selection ends.

    ``rows`` holds (source, size, rank, tie); the result is broadcast if its counted rows are few.
    """
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = ws.save(plan.withColumn("words_left", F.greatest(F.round("target").cast("long") - F.col("epochs") * F.col("source_size"), F.lit(0))), "plan")

    def under(cut: DataFrame, on: Column) -> DataFrame:
        c = small(cut.withColumnRenamed("source", "cut_source"))
        return rows.join(c, F.col("source").eqNullSafe(F.col("cut_source")) & on).drop("cut_source")

    cut = plan.filter("words_left > 0").select("source", "words_left")
    on = F.lit(True)
    for k, shift in enumerate(DIGITS):
        digit = F.shiftright("rank", shift)
        cut = ws.save(_cut(under(cut, on).withColumn("digit", digit), ["digit"]).drop("group_rows"), f"cut{k}")
        on = digit == F.col("digit")
    cut = ws.save(_cut(under(cut, on).drop("digit"), ["rank", "tie"]), "cut")
    cut = plan.select(F.col("source").alias("cut_source"), "source_size", "target", "epochs").join(
        cut.select("source", F.col("rank").alias("cut_rank"), F.col("tie").alias("cut_tie"), "words_left", "group_rows"), F.col("cut_source").eqNullSafe(F.col("source")), "left"
    )
    return small(ws.save(cut.drop("source"), "apply"))


def _extra() -> Column:
    """Words that the fractional selection takes of a row."""
    at, cut_at = F.struct("rank", "tie"), F.struct("cut_rank", "cut_tie")
    at_cut = F.floor(F.col("words_left") / F.col("group_rows"))
    return F.when(F.col("cut_rank").isNull(), 0).when(at < cut_at, F.col("size")).when(at == cut_at, at_cut).otherwise(0).cast("long")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED, quality: Column | None = None) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` needs doc_id, text and source; other columns are ignored, whatever their names.
    Returns one row per input row: doc_id, size, source, source_size, target (of the source), taken
    and epochs (complete passes over the source).  ``taken`` is ``epochs * size`` plus the whole
    document, a part of it at the cut, or nothing.  Null text has size 0; a null source is a source
    of its own, placed last; a null doc_id ranks like any other id; rows with equal id and rank that
    meet at the cut share what is left evenly, so reruns agree.  No rows in, no rows out.
    """
    ws = Workspace(docs.sparkSession, "mix")
    rows = ws.save(docs.select("doc_id", *_keys(seed, quality)), "rows")
    mixed = rows.join(cuts(rows, weights, share, cap, ws), F.col("source").eqNullSafe(F.col("cut_source")))
    return mixed.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + _extra()).alias("taken"), "epochs")


def mixed_documents(docs: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED, quality: Column | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, as often as the mix takes them.

    A row comes once for each epoch and once more if the fractional selection takes any of its words:
    the document at the cut stays whole.  Rows that the mix does not take are left out.
    """
    ws = Workspace(docs.sparkSession, "mix")
    cut = cuts(ws.save(docs.select("doc_id", *_keys(seed, quality)), "rows"), weights, share, cap, ws)
    mixed = docs.select(whole_row(docs).alias("row"), *_keys(seed, quality)).join(cut, F.col("source").eqNullSafe(F.col("cut_source")))
    copies = F.col("epochs") * (F.col("size") > 0).cast("long") + (_extra() > 0).cast("long")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(True), copies.cast("int")))).select("row.*")


ORACLE = r"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) / CASE WHEN length(text) > 0 THEN length(text) END), 1.0::DOUBLE) AS w,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) AS u FROM documents),
ranked AS (SELECT *, least(floor((1.0::DOUBLE - pow(u, 1.0::DOUBLE / w)) * 4503599627370496.0::DOUBLE), 4503599627370495)::BIGINT AS rnk, coalesce(doc_id::VARCHAR, '') AS tie FROM base),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM placed),
full_at AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM weighed),
leveled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM full_at),
targeted AS (SELECT source, source_size, CASE WHEN level >= full_at THEN 2.0::DOUBLE * source_size ELSE
    (SELECT l.level FROM leveled l WHERE l.level < l.full_at ORDER BY l.full_at, l.place LIMIT 1) * weight END AS target FROM leveled),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM targeted),
run AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.epochs, greatest(round(p.target)::BIGINT - p.epochs * p.source_size, 0) AS words_left,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.rnk, r.tie) AS upto, sum(r.size) OVER (PARTITION BY r.source, r.rnk, r.tie) AS grp, count(*) OVER (PARTITION BY r.source, r.rnk, r.tie) AS n
    FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN words_left = 0 THEN 0 WHEN upto <= words_left THEN size
    WHEN upto - grp <= words_left THEN (words_left - (upto - grp)) // n ELSE 0 END)::BIGINT AS taken FROM run
"""
