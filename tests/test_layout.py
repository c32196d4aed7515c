"""Sheet layouts, one row a sheet, against the version with a grouping for each rule."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import plain_layout as P
from gradeloom.functions import vocabulary as V
from gradeloom.operators import layout as L
from oracle import plain

CELLS = "sheet_id long, row_idx int, col_idx int, kind string, str string, num double"


def sheets(seed: int, n: int):
    """Cells of sheets whose rows mix titles, labels, names, dates, numbers that count up, holes and nothing."""
    rng = random.Random(seed)
    titles = [*V.NAME_TITLES, *V.ID_TITLES, *[x for t in V.MARK_TYPES for x in V.MARK_TITLES[t]], *[x for t in V.MARK_TYPES for x in V.TEST_LABELS[t]], *V.EXTRA_TITLES, *V.OFFICIAL_WORDS, V.SCORE_LABEL, "x 2", ""]
    names = ["محمد العلوي", "فاطمة", "Ali Ben Salah", "x", "12", "01/02/2010", "-", " ", "A"]
    out = []
    for sheet in range(n):
        width, height, top, first = rng.randint(1, 7), rng.choice([0, 1, 3, 6, 12, 25]), rng.randint(0, 4), rng.choice([0, 0, 0, 2])
        kinds = [rng.choice(["count", "mark", "name", "some", "far"]) for _ in range(width)]
        for r in range(first, first + top + height):
            for c in range(width):
                if rng.random() < 0.1:
                    continue
                if r < first + top:
                    v = rng.choice(titles) if rng.random() < 0.7 else rng.choice([0, 3, ""])
                else:
                    v = {"count": r - top, "mark": rng.randint(0, 80) / 4, "name": rng.choice(names[:3]), "some": rng.choice([*names, "7,5", "3abc", "", 5]), "far": rng.randint(15, 25)}[kinds[c]]
                kind = "empty" if v == "" else "string" if isinstance(v, str) else "number"
                out.append((sheet, r, c, kind, None if kind == "string" and rng.random() < 0.02 else str(v), float(v) if kind == "number" else None))
    return out


def listed(df):
    def tidy(v):
        if isinstance(v, dict):
            return tuple(sorted((k, plain(x)) for k, x in v.items()))
        return tuple(map(tidy, v)) if isinstance(v, (list, tuple)) else plain(v)

    return sorted((tuple(tidy(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("semantics", ["reference", "corrected"])
def test_structures_equal_the_plain_ones(spark, semantics):
    cells = spark.createDataFrame(sheets(7, 150), CELLS).cache()
    got = L.infer_structure(cells, semantics)
    want = P.infer_structure(cells, semantics).select(*got.columns)
    a, b = listed(got), listed(want)
    assert len(a) > 100 and len({r[3] for r in a}) == 3
    assert a == b
    cells.unpersist()


def test_parts_equal_the_plain_ones(spark):
    cells = spark.createDataFrame(sheets(8, 100), CELLS).cache()
    pairs = P.pair_name_scores(cells).withColumn("of", F.lit("pair"))
    scores = P.column_name_scores(cells).withColumn("of", F.lit("single")).unionByName(pairs)
    assert listed(L.name_scores(cells).select(*scores.columns)) == listed(scores)
    assert listed(L.score_columns(cells)) == listed(P.score_columns(cells))
    assert listed(L.official_names(cells)) == listed(P.official_name_column(cells, P.header_cells(cells)))
    cells.unpersist()


def test_two_exchanges_and_no_join(spark):
    cells = spark.createDataFrame(sheets(9, 5), CELLS)
    plan = L.infer_structure(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning(sheet_id#") == 2


def test_nothing_and_long_sheets(spark):
    assert L.infer_structure(spark.createDataFrame([], CELLS)).collect() == []
    tall = spark.range(1, 30_001).select(F.lit(1).cast("long").alias("sheet_id"), F.col("id").cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("number").alias("kind"), F.col("id").cast("string").alias("str"), F.col("id").cast("double").alias("num"))
    row = L.infer_structure(tall).collect()[0]
    assert (row["n_rows"], row["n_cols"], row["layout"], row["headers"]) == (30_001, 1, None, None)
    assert listed(L.infer_structure(tall)) == listed(P.infer_structure(tall).select(*row.asDict()))
