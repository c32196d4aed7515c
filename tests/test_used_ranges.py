"""Used ranges of sheets: places, filters that leave files and rows unread, bad files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.sources import readers as I
from gradeloom.sources import used_ranges as G


def put(folder, sheet, row, col, values, name=None):
    (folder / f"{name or G.quote(sheet, safe='')}{G.ENDING}").write_text(json.dumps({"sheet_id": sheet, "row": row, "col": col, "values": values}), encoding="utf-8")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_cells_stand_at_their_places(spark, tmp_path):
    put(tmp_path, "7", 3, 2, [["اسم", 1.0], [None, 2.5], ["", True], ["a"]])
    put(tmp_path, "1/ب ", 0, 0, [])
    (tmp_path / "notes.txt").write_text("not a range")
    got = rows(G.read_used_ranges(spark, f"file://{tmp_path}"))
    assert got == [("7", 3, 2, "string", "اسم", None), ("7", 3, 3, "number", "1", 1.0), ("7", 4, 2, "empty", "", None), ("7", 4, 3, "number", "2.5", 2.5), ("7", 5, 2, "empty", "", None), ("7", 5, 3, "number", "1", 1.0), ("7", 6, 2, "string", "a", None)]


def test_empty_folder(spark, tmp_path):
    df = G.read_used_ranges(spark, f"file://{tmp_path}")
    assert df.collect() == [] and df.schema.simpleString() == spark.createDataFrame([], I.CELLS).schema.simpleString()


def test_filters_leave_files_and_rows_unread(spark, tmp_path):
    for k in range(20):
        put(tmp_path, str(k), k, 0, [[k]] * 10)
    put(tmp_path, "99", 0, 0, [[1]], name="98")  # read only if its file is
    df = G.read_used_ranges(spark, f"file://{tmp_path}")
    some = df.where("sheet_id in ('3', '5', 'none') and row_idx >= 6 and row_idx < 9 and col_idx = 0")
    assert rows(some.select("sheet_id", "row_idx")) == [("3", 6), ("3", 7), ("3", 8), ("5", 6), ("5", 7), ("5", 8)]
    assert rows(df.where("sheet_id = '3' and sheet_id = '4'")) == []
    assert rows(df.where("sheet_id = '4' and row_idx = 7").select("str")) == [("4",)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = next(line for line in plan.splitlines() if "Filter" in line)
    assert "col_idx" in kept and "row_idx" not in kept.replace("isnotnull(row_idx", "") and "IN (" not in kept
    with pytest.raises(Exception, match="holds sheet"):
        df.where("row_idx >= 0").collect()


def test_round_trip(spark, tmp_path):
    cells = [("s/1", 4, 3, "string", "x", None), ("s/1", 6, 5, "number", "2", 2.0), ("s/1", 0, 0, "empty", "", None), ("s/1", 6, 5, "number", "2", 2.0), ("e", 1, 1, "empty", "", None), (None, 1, 1, "string", "y", None)]
    folder = f"file://{tmp_path}/deep/er"
    for _ in range(2):  # written again, the same files stand
        G.write_used_ranges(spark.createDataFrame(cells, I.CELLS), folder)
    back = G.read_used_ranges(spark, folder)
    assert rows(back.where(F.col("kind") != "empty")) == [cells[0], cells[1]]
    assert back.count() == 9 and {r["sheet_id"] for r in back.collect()} == {"s/1"}
