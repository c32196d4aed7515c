"""Inferring the layout of gradebook sheets from their cells, for many sheets at once.

cells: (sheet_id, row_idx, col_idx, kind, str, num); kind is string, number or
empty, str holds a number's text too. Where names, numbers and marks stand is
``layout.infer_structure``'s work; here are the rules beside it, groupings of the
first rows by sheet or equality joins to neighbouring cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import any_of, trim
from .statistics import TYPES


def _text(cells: DataFrame) -> DataFrame:
    """String cells with text."""
    return cells.where((F.col("kind") == "string") & (F.col("str") != ""))


def official_layout(cells: DataFrame) -> DataFrame:
    """(sheet_id, official): at least two hits of the six indicator words in the first 20 rows."""
    hits = sum(F.col("str").contains(w).cast("int") for w in V.OFFICIAL_WORDS)
    shown = (F.col("row_idx") < 20) & (F.col("kind") == "string")
    return cells.groupBy("sheet_id").agg((F.coalesce(F.sum(F.when(shown, hits)), F.lit(0)) >= 2).alias("official"))


def sheet_metadata(cells: DataFrame) -> DataFrame:
    """(sheet_id, level, section): values beside or below the first label that has one.

    The few places asked for are held in memory, a share of them in each of the
    session's shuffle partitions, and the cells stream by them unsorted.
    """
    shown = cells.where("row_idx < 20")
    kinds = F.array_compact(F.array(*[F.when(any_of(F.col("str"), words), F.lit(kind)) for kind, words in V.META_LABELS.items()]))
    labels = _text(shown).select("sheet_id", F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), F.explode(kinds).alias("kind"))
    offsets = [(0, 1), (0, 2), (0, 3), (0, -1), (1, 0), (1, 1), (2, 0), (2, 1)]
    places = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(d).alias("d"), F.lit(r).alias("r")) for k, (d, r) in enumerate(offsets)])
    asked = labels.withColumn("p", F.explode(places)).select("sheet_id", "kind", "row", "col", "p.rank", (F.col("row") + F.col("p.d")).alias("row_idx"), (F.col("col") + F.col("p.r")).alias("col_idx"))
    values = shown.select("sheet_id", "row_idx", "col_idx", trim(F.coalesce("str", F.lit(""))).alias("value")).where("value <> ''")
    n, place = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["sheet_id", "row_idx", "col_idx"]
    near = asked.repartition(n, *place).hint("shuffle_hash").join(values.repartition(n, *place), place).where((F.col("rank") > 3) | ~F.col("value").isin(":", "-", "؛"))
    first = near.groupBy("sheet_id").agg(*[F.min_by("value", F.when(F.col("kind") == k, F.struct("row", "col", "rank"))).alias(k) for k in V.META_LABELS])
    return cells.select("sheet_id").distinct().join(first, "sheet_id", "left")


def available_types(cells: DataFrame, structure: DataFrame) -> DataFrame:
    """(sheet_id, has_fard1..): labels in the first six rows; where there is none, the structure's columns."""
    shown = (F.col("row_idx") < 6) & (F.col("kind") == "string")
    labels = cells.groupBy("sheet_id").agg(*[F.coalesce(F.max(shown & any_of(F.col("str"), V.TEST_LABELS[t])), F.lit(False)).alias(f"l_{t}") for t in TYPES])
    some = reduce(lambda a, t: a | F.col(f"l_{t}"), TYPES, F.lit(False))
    return labels.join(structure.select("sheet_id", "mark_cols"), "sheet_id", "left").select("sheet_id", *[F.when(some, F.col(f"l_{t}")).otherwise(F.coalesce(F.element_at("mark_cols", F.lit(t)) >= 0, F.lit(False))).alias(f"has_{t}") for t in TYPES])


def project_template(cells: DataFrame, templates: DataFrame, template: str) -> DataFrame:
    """(sheet_id, row_idx, number, name, fard1..): columns of a known layout from its first data row on; ``templates`` has a handful of rows."""
    one = templates.where(F.col("id") == template)
    at = cells.join(F.broadcast(one), F.col("row_idx") >= F.col("row_start"))
    value = lambda c: F.max(F.when(F.col("col_idx") == c, F.col("str")))
    return at.groupBy("sheet_id", "row_idx").agg(value(F.col("number_col")).alias("number"), value(F.col("name_col")).alias("name"), *[value(F.element_at("mark_cols", F.lit(t))).alias(t) for t in TYPES])
