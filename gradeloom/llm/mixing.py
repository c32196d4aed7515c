"""Mixing sources to target weights by capped water-filling.

Every source should get its weight's share of the words, but no source may be
repeated more than ``max_epochs`` times. Sources that would exceed that are
clamped and their excess goes to the others by weight, until none is above. The
fixed point has a closed form: with sources by cap per weight, there is a first
k such that the words left after filling the k smallest caps, spread over the
remaining weight, stay below the next cap.

A source's target becomes whole repetitions of each of its documents and a
fractional one: its documents in a seeded random order, taken from the front
while the middle of a document lies within the fraction. That is a sample
without replacement whose size misses the target by at most half a document.
The running sums run inside hash ranges of a source (``bins``), whose sums come
first, so that no source, however large, is ordered in one task.

All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

BINS = 4096
DRAW = 2**32


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A seeded number from 0 to 2^32 - 1: by the doc_id, or by the text where that is null."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary")), 1, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) for sources (source, source_size); weights repeat over sources by code point, null last.

    Rows of ``sources`` are sources, not documents: its windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    given = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    everywhere = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    filled = given.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    # the first level that its own source and so all later ones can take
    settled = filled.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return settled.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 42, bins: int = BINS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs`` (doc_id, text, source).

    size counts words (null text: 0); a null source is a source of its own, last
    in order; a null doc_id is drawn by its text. taken is size times the
    document's repetitions. A source without words has target 0 and takes
    nothing; an empty table gives no rows; rows with equal doc_id, source and
    size are alike, so either may take the last repetition. Other columns are
    ignored. Runs agree: the draw depends on seed and doc_id alone.
    """
    sized = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw")), "mix-sizes")
    return _repeats(sized, weights, max_epochs, bins).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def _repeats(sized: DataFrame, weights, max_epochs: int, bins: int) -> DataFrame:
    slot = F.floor(F.col("draw") * bins / DRAW).cast("int")
    sized = sized.withColumn("slot", slot)
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    targets = water_fill(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, max_epochs)
    in_source = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(in_source), F.lit(0)))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    known = targets.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = placed.join(known, placed["source"].eqNullSafe(known["source"])).select(placed["source"], "slot", "before", "source_size", "target", "whole", "part")
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["source"]) & (sized["slot"] == plan["slot"])).drop(plan["source"]).drop(plan["slot"])
    in_slot = Window.partitionBy("source", "slot").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(in_slot), F.lit(0)) + F.col("size") / 2
    return joined.withColumn("repeats", F.col("whole") + F.when(middle <= F.col("part"), 1).otherwise(0))


def _order(kind) -> Column:
    """What rows of a source are drawn by, as one value: null ids last."""
    return F.struct("draw", F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), "size")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 42, bins: int = BINS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the plan repeats it, with the columns of ``docs``.

    No text is shuffled: the plan is made from sizes alone, and of each source it
    gives the whole repetitions and the last row in the drawn order that takes one
    more, so every row is settled where it is read. Only rows that are alike in
    id, size and draw, of which the plan takes some and leaves some, are numbered
    in a window of their own.
    """
    row, names, kind = "__row", docs.columns, docs.schema["doc_id"].dataType
    plain = docs.select(F.struct(*[docs[c] for c in names]).alias(row))
    sized = plain.select(row, F.col(f"{row}.doc_id").alias("doc_id"), F.col(f"{row}.source").alias("source"), words_in(F.col(f"{row}.text")).alias("size"), draw(F.col(f"{row}.doc_id"), F.col(f"{row}.text"), seed).alias("draw"))
    plan = cut(_repeats(cut(sized.drop(row), "mix-sizes"), weights, max_epochs, bins).select("source", "whole", "doc_id", "size", "draw", (F.col("repeats") > F.col("whole")).alias("more")), "mix-plan")
    place = _order(kind)
    last = plan.groupBy("source").agg(F.first("whole").alias("whole"), F.max(F.when(F.col("more"), place)).alias("last"))
    ends = plan.join(last.select(F.col("source").alias("of"), "last"), plan["source"].eqNullSafe(F.col("of"))).where(place == F.col("last"))
    ties = ends.groupBy("of").agg(F.count("*").alias("alike"), F.count_if("more").alias("taken"))
    edges = cut(last.join(ties, last["source"].eqNullSafe(ties["of"]), "left").select(F.col("source").alias("of"), "whole", "last", "alike", "taken"), "mix-edges")
    placed = sized.join(edges, sized["source"].eqNullSafe(edges["of"])).withColumn("__place", place)
    tied = (F.col("__place") == F.col("last")) & (F.col("alike") > F.col("taken"))
    settled = placed.where(~F.coalesce(tied, F.lit(False))).select(row, (F.col("whole") + F.coalesce(F.col("__place") <= F.col("last"), F.lit(False)).cast("int")).alias("repeats"))
    if not edges.where("alike > taken").isEmpty():
        number = F.row_number().over(Window.partitionBy("of").orderBy("draw"))
        rest = placed.where(tied).withColumn("number", number).select(row, (F.col("whole") + (F.col("number") <= F.col("taken")).cast("int")).alias("repeats"))
        settled = settled.unionByName(rest)
    repeated = settled.where("repeats > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"))
    return repeated.select(*[F.col(f"{row}.`{c}`").alias(c) for c in names])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS size,
         CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, row_number() OVER r AS k,
        ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, k) FROM l WHERE level * weight <= cap)) AS target FROM l),
r AS (SELECT doc_id, size, draw, source_size, target, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
