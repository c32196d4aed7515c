"""Sheets kept as their used ranges, read as cells: a Spark data source.

A file holds one sheet's used range as JSON: {"sheet_id", "row", "col", "values"},
where row and col place the range's first cell and values are its rows. Its name
is the sheet's id, quoted, so that a filter on sheet_id leaves files unread; a
filter on row_idx leaves rows out before they become cells. Ranges begin where
their sheet's first filled cell is, so cells stand at their true places.

    register(spark)
    spark.read.format("used_ranges").load(folder).where("sheet_id = '7'")

A text is a string cell, a number or truth value a number cell, null or an empty
text an empty cell. A row may be shorter than others. A file of no rows gives no
cells; one that isn't such JSON, or bears another sheet's id, stops the read.
A task takes files of some 64 MB in all; a sheet is held by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .readers import CELLS

ENDING = ".range.json"
TASK_BYTES = 64 << 20
BATCH = 50_000
ARROW = pa.schema([("sheet_id", pa.string()), ("row_idx", pa.int32()), ("col_idx", pa.int32()), ("kind", pa.string()), ("str", pa.string()), ("num", pa.float64())])


def _cell(value) -> tuple[str, str, float | None]:
    if value is None or value == "":
        return "empty", "", None
    if isinstance(value, str):
        return "string", value, None
    number = float(value)
    return "number", str(int(number)) if number.is_integer() else repr(number), number


@dataclass
class Files(InputPartition):
    paths: list[str]


class RangeReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.sheets: set[str] | None = None
        self.first, self.last = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take equality and membership of sheet_id and bounds of row_idx; Spark keeps the others."""
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if name == ("sheet_id",) and isinstance(f, EqualTo | EqualNullSafe | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.sheets = wanted if self.sheets is None else self.sheets & wanted
            elif name == ("row_idx",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.value is not None:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    last = f.value - isinstance(f, LessThan)
                    self.last = last if self.last is None else min(self.last, last)
            else:
                yield f

    def _taken(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return name.endswith(ENDING) and (self.sheets is None or unquote(name[: -len(ENDING)]) in self.sheets)

    def partitions(self) -> list[Files]:
        store, base = fs.FileSystem.from_uri(self.folder)
        if self.sheets is not None and len(self.sheets) <= 1000:  # few sheets: their files are asked for by name
            named = [f"{base.rstrip('/')}/{quote(s, safe='')}{ENDING}" for s in sorted(s for s in self.sheets if s is not None)]
            found = [i for i in store.get_file_info(named) if i.type == fs.FileType.File] if named else []
        else:
            found = [i for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File and self._taken(i.path)]
        parts, size = [], TASK_BYTES
        for info in sorted(found, key=lambda i: i.path):
            if size + info.size > TASK_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(info.path)
            size += info.size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.folder)[0]
        rows: list[tuple] = []
        for path in partition.paths:
            with store.open_input_stream(path) as file:
                sheet = json.loads(file.read())
            named = unquote(path.rsplit("/", 1)[-1][: -len(ENDING)])
            if sheet["sheet_id"] != named:
                raise ValueError(f"{path} holds sheet {sheet['sheet_id']!r}")
            top, left, values = sheet["row"], sheet["col"], sheet["values"]
            end = len(values) if self.last is None else max(0, min(len(values), self.last - top + 1))
            for r in range(max(0, self.first - top), end):
                for c, value in enumerate(values[r]):
                    rows.append((sheet["sheet_id"], top + r, left + c, *_cell(value)))
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), ARROW.types)], schema=ARROW)


class UsedRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "used_ranges"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(UsedRanges)


def read_used_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all used ranges in a folder, named by its URI."""
    register(spark)
    return spark.read.format("used_ranges").load(folder)


def write_used_ranges(cells: DataFrame, folder: str) -> None:
    """A file for each sheet of ``cells``: the smallest range with all its cells that aren't empty.

    A sheet without such a cell gets none. Of two cells at one place the greatest
    (kind, text) stays. A file that is there is replaced as a whole, so a task that
    is run again leaves the same files. A sheet's rows meet in one task, as one file is one sheet.
    """
    filled = cells.where("kind <> 'empty'").select(F.col("sheet_id").cast("string").alias("sheet_id"), "row_idx", "col_idx", F.struct("kind", "str", "num").alias("cell"))
    one = filled.groupBy("sheet_id", "row_idx", "col_idx").agg(F.max("cell").alias("cell"))
    sheets = one.groupBy("sheet_id").agg(F.min("row_idx").alias("row"), F.min("col_idx").alias("col"), F.max("col_idx").alias("end"), F.max("row_idx").alias("last"), F.collect_list(F.struct("row_idx", "col_idx", "cell")).alias("cells"))

    def save(part) -> Iterator[tuple[str]]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for sheet in part:
            values = [[None] * (sheet["end"] - sheet["col"] + 1) for _ in range(sheet["last"] - sheet["row"] + 1)]
            for x in sheet["cells"]:
                values[x["row_idx"] - sheet["row"]][x["col_idx"] - sheet["col"]] = x["cell"]["num"] if x["cell"]["kind"] == "number" else x["cell"]["str"]
            path = f"{base.rstrip('/')}/{quote(sheet['sheet_id'], safe='')}{ENDING}"
            with store.open_output_stream(path) as file:
                file.write(json.dumps({"sheet_id": sheet["sheet_id"], "row": sheet["row"], "col": sheet["col"], "values": values}, ensure_ascii=False).encode("utf-8", "surrogatepass"))

    sheets.where("sheet_id is not null").foreachPartition(save)
