"""The layout of gradebook sheets, one row a sheet: cells meet once by column, columns once by sheet.

``described_columns`` reduces a column's cells where they are read: cells below
the first twenty rows leave no more than a sum and a count. ``described`` lists a
sheet's columns in order, and every rule is an expression over that list, so that
inferring a structure shuffles the first rows once and a row a column once more.
A sheet's row holds the titles that may head its columns and a few figures of each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import GAPS, has, let, numeric_prefix, trim
from .statistics import TYPES

DATE = "\\d{2}[-/]\\d{2}[-/]\\d{4}"
LETTERS = f"[{V.ARABIC}]|[a-zA-Z]"
TOP, SAMPLE = 20, 10
#: Where a label's scores may stand: rows down, columns right, in order.
NEAR = ((1, 0), (1, 1), (1, 2), (0, 1), (0, 2), (0, 3))


def _holds(text: Column, words) -> Column:
    """Whether ``text`` contains one of ``words``: one pattern, as an OR of many tests in a lambda takes seconds to plan."""
    return has(text, "|".join(map(re.escape, words)))


def _one(test: Column) -> Column:
    return test.cast("int")


def _place(row: Column, col: Column) -> Column:
    return row.cast("long") * (1 << 31) + col


def _least(items: Column, test, of) -> Column:
    return F.array_min(F.transform(F.filter(items, test), of))


def _greatest(items: Column, test, of) -> Column:
    return F.array_max(F.transform(F.filter(items, test), of))


def described_columns(cells: DataFrame) -> DataFrame:
    """A row for each (sheet_id, col_idx) that holds cells or stands left of one that does.

    own: it holds cells; n_rows: its last row's number and one; hits: words of the
    official layout in its first twenty rows, header_row: their first with a
    header word, titles: their (row, shown text); labels, scores: rows of test
    labels (with their mark types) and of score labels; single, pair: likeness of
    its texts, and of its and its right neighbour's texts together, to names;
    rows: likeness by the first five rows; sampled, points, numbers, inside,
    steps: of its first ten data rows cells, points for text, numbers, those from 0 to 20
    and numbers one above the last before; mean: of all its numbers below the first row.
    Null texts are no texts. Of two cells at one place both count.
    """
    text = F.coalesce((F.col("kind") == "string") & (F.col("str") != ""), F.lit(False))
    row, string = F.col("row_idx"), F.col("kind") == "string"
    sample = row.between(1, SAMPLE)
    at = lambda c, own: F.struct(c.alias("col_idx"), F.lit(own).alias("own"))
    places = F.when(text & sample, F.array(at(F.col("col_idx"), True), at(F.col("col_idx") - 1, False))).otherwise(F.array(at(F.col("col_idx"), True)))
    spread = cells.select("sheet_id", "row_idx", "kind", "str", "num", F.explode(places).alias("p")).select("*", "p.*").drop("p")
    own, t = F.col("own"), trim(F.col("str"))
    shown = F.when((F.col("kind") == "empty") | ((F.col("kind") == "number") & (F.col("num") == 0)), "").otherwise(F.coalesce("str", F.lit("")))
    hits = sum(_one(F.col("str").contains(w)) for w in V.OFFICIAL_WORDS)
    types = F.array_compact(F.array(*[F.when(_holds(F.col("str"), V.TEST_LABELS[k]), F.lit(k)) for k in TYPES]))
    value = F.when(F.col("kind") == "number", F.col("num")).when(string, numeric_prefix(F.col("str")))
    letters, alone, undated = has(t, LETTERS), ~has(t, "^\\d+$"), ~has(t, DATE)
    words = F.size(F.split(t, GAPS))
    single = 1.5 * _one(letters & (F.length(t) >= 2)) + 1.0 * _one(words >= 2) + 0.5 * _one(alone) + 0.3 * _one(undated)
    five = 2 * _one(has(F.col("str"), LETTERS)) + _one(words.between(2, 5)) + _one(~has(F.col("str"), "^\\d+$") & ~has(F.col("str"), DATE))
    rich = _one(text) + 2 * _one(text & has(F.col("str"), f"[{V.ARABIC}]")) + _one(text & (F.length("str") > 3))
    named, first = own & text & sample, own & (row < TOP)
    by_row = lambda mine: F.array(*[F.max(F.when((own if mine else ~own) & text & (row == r), t)) for r in range(1, SAMPLE + 1)])
    grouped = spread.groupBy("sheet_id", "col_idx").agg(
        F.max("own").alias("own"), (F.max(F.when(own, row)) + 1).alias("n_rows"),
        F.coalesce(F.sum(F.when(first & string, hits)), F.lit(0)).alias("hits"),
        F.min(F.when(first & string & _holds(F.col("str"), V.HEADER_WORDS), row)).alias("header_row"),
        F.collect_list(F.when(first, F.struct(row.alias("row"), shown.alias("shown")))).alias("titles"),
        F.collect_list(F.when(own & text & (row < 5) & _holds(F.col("str"), [w for k in TYPES for w in V.TEST_LABELS[k]]), F.struct(row.alias("row"), types.alias("types")))).alias("labels"),
        F.collect_list(F.when(own & text & (row < 6) & F.col("str").contains(V.SCORE_LABEL), row)).alias("scores"),
        F.sum(F.when(named, single)).alias("s"), F.count_if(named).alias("n"),
        by_row(True).alias("left"), by_row(False).alias("right"),
        F.avg(F.when(named & (row <= 5), five)).alias("rows"),
        F.count_if(own & sample).alias("sampled"), F.sum(F.when(own & sample, rich)).alias("points"),
        F.count_if(own & sample & value.between(0, 20)).alias("inside"),
        F.sort_array(F.collect_list(F.when(own & sample & value.isNotNull(), F.struct(row.alias("row"), value.alias("value"))))).alias("values"),
        F.coalesce(F.avg(F.when(own & (row >= 1), value)), F.lit(0.0)).alias("mean"),
    )
    both = F.filter(F.zip_with("left", "right", lambda a, b: F.concat_ws(" ", a, b)), lambda x: x != "")
    of_pair = lambda x: 1.5 * _one(has(x, LETTERS) & (F.length(x) >= 3)) + 1.0 * _one(F.size(F.split(x, GAPS)) >= 2) + 0.5 * _one(~has(x, "^\\d+$"))
    pair = let(both, lambda x: F.when(F.size(x) > 0, F.least(F.lit(1.0), F.aggregate(x, F.lit(0.0), lambda a, y: a + of_pair(y)) / (F.size(x) * 3.0))))
    before = lambda i: F.coalesce(F.get("values", i - 1)["value"], F.lit(0.0))
    steps = F.size(F.filter("values", lambda x, i: (x["row"] > 1) & (x["value"] == before(i) + 1)))
    return grouped.select(
        "sheet_id", "col_idx", "own", "n_rows", "hits", "header_row", "titles", "labels", "scores", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("s") / (F.col("n") * 3.3))).alias("single"), pair.alias("pair"), "rows",
        "sampled", "points", F.size("values").alias("numbers"), "inside", steps.alias("steps"), "mean",
    )


def described(cells: DataFrame) -> DataFrame:
    """One row a sheet: sheet_id, n_rows, n_cols, official, header_row, cols (its described columns in order), h, labels.

    h lists its titles as (col_idx, header, low). labels lists its test labels as
    (row, col, score, types); score is the column of the score label nearest in
    the order of ``NEAR``, else the label's own if a row follows, else -1.
    """
    columns = described_columns(cells)
    rest = [c for c in columns.columns if c != "sheet_id"]
    sheets = columns.groupBy("sheet_id").agg(
        F.max("n_rows").alias("n_rows"), (F.max(F.when(F.col("own"), F.col("col_idx"))) + 1).alias("n_cols"), (F.sum("hits") >= 2).alias("official"),
        F.coalesce(F.min("header_row"), F.lit(0)).alias("header_row"), F.sort_array(F.collect_list(F.struct(*rest))).alias("cols"),
    )
    heads = F.flatten(F.transform("cols", lambda c: F.transform(F.filter(c["titles"], lambda x: x["row"] == F.col("header_row")), lambda x: F.struct(c["col_idx"].alias("col_idx"), x["shown"].alias("header"), F.lower(x["shown"]).alias("low")))))
    labels = F.flatten(F.transform("cols", lambda c: F.transform(c["labels"], lambda x: F.struct(x["row"].alias("row"), c["col_idx"].alias("col"), x["types"].alias("types")))))
    places = F.flatten(F.transform("cols", lambda c: F.transform(c["scores"], lambda r: _place(r, c["col_idx"]))))
    listed = sheets.withColumns({"h": F.sort_array(heads), "found": labels, "places": places})
    near = lambda x: [F.when(F.array_contains("places", _place(x["row"] + down, x["col"] + right)), x["col"] + right) for down, right in NEAR]
    score = lambda x: F.coalesce(*near(x), F.when(x["row"] + 1 < F.col("n_rows"), x["col"]), F.lit(-1))
    return listed.withColumn("labels", F.transform("found", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), score(x).alias("score"), x["types"].alias("types")))).drop("found", "places")


# --- By title. ``h`` is the list of titles.


def _title_column(h: Column, *tests) -> Column:
    """The first column that the first test fits, else the next test; -1 if none. Empty titles fit none."""
    first = lambda test: _least(h, lambda x: (x["header"] != "") & test(x), lambda x: x["col_idx"])
    return F.coalesce(*map(first, tests), F.lit(-1))


def name_by_title(h: Column, semantics: str = "reference") -> Column:
    """Whole titles before contained ones. Corrected: an id title is no name title."""
    titles = [t.lower() for t in V.NAME_TITLES]
    kept = F.filter(h, lambda x: ~x["header"].isin(*V.ID_TITLES)) if semantics == "corrected" else h
    return _title_column(kept, lambda x: x["low"].isin(*titles), lambda x: _holds(x["low"], titles))


def id_by_title(h: Column, semantics: str = "reference") -> Column:
    """Whole titles before contained ones. Corrected: only whole titles count."""
    exact, part = (lambda x: x["header"].isin(*V.ID_TITLES)), (lambda x: _holds(x["header"], V.ID_TITLES))
    return _title_column(h, exact) if semantics == "corrected" else _title_column(h, exact, part)


def mark_by_title(h: Column, t: str) -> Column:
    """Whole titles, then contained ones, then digits near a test word (not for activities)."""
    tests = [lambda x: x["header"].isin(*V.MARK_TITLES[t]), lambda x: _holds(x["header"], V.MARK_TITLES[t])]
    return _title_column(h, *tests, *([lambda x: has(x["header"], V.FUZZY_TITLES[t])] if t in V.FUZZY_TITLES else []))


def title_confidence(h: Column, t: str) -> Column:
    """0.9 for a strong title, 0.7 for a weak one; the last title of either kind wins; 0 if none."""
    strong = lambda x: _holds(x["low"], V.STRONG_TITLES[t])
    weak = lambda x: _holds(x["low"], V.WEAK_ACTIVITIES) if t == "activities" else x["low"].contains(V.WEAK_TITLES[t][0]) & x["low"].contains(V.WEAK_TITLES[t][1])
    of = lambda x: F.when(strong(x), 0.9).when(weak(x), 0.7)
    last = F.array_max(F.filter(F.transform(h, lambda x: F.struct(x["col_idx"].alias("c"), of(x).alias("conf"))), lambda x: x["conf"].isNotNull()))
    return F.coalesce(last["conf"], F.lit(0.0))


def extra_columns(h: Column, taken: Column) -> Column:
    """Assessment titles outside the mark columns ``taken``, as (index, header)."""
    some = F.filter(h, lambda x: _holds(x["low"], V.EXTRA_TITLES) & ~F.array_contains(taken, x["col_idx"]))
    return F.transform(some, lambda x: F.struct(x["col_idx"].alias("index"), x["header"].alias("header")))


# --- Official sheets. ``cols`` is the list of columns.


def official_mark(labels: Column, titled: Column, t: str) -> Column:
    """The last label's score column, else the one ``titled`` so."""
    last = F.array_max(F.filter(labels, lambda x: F.array_contains(x["types"], t) & (x["score"] >= 0)))
    return F.coalesce(last["score"], titled)


def official_name(cols: Column, h: Column, titled: Column, ids: Column) -> Column:
    """The column ``titled`` so; else beside the id column; else the most name-like column or pair; else the first with name-like rows; -1 if none."""
    width = F.array_max(F.transform(h, lambda x: x["col_idx"])) + 1
    scored = lambda name, way: F.transform(cols, lambda c: F.struct(c[name].alias("score"), (way * c["col_idx"]).alias("o")))
    by_id = F.array_max(F.filter(scored("single", 1), lambda x: (ids >= 0) & (F.abs(x["o"] - ids) == 1) & (x["score"] >= 0.6)))["o"]
    both = F.concat(F.filter(scored("single", -1), lambda x: x["score"].isNotNull()), _pairs(cols, 0), _pairs(cols, 1))
    best = let(width, lambda w: F.array_max(F.filter(both, lambda x: -x["o"] < w)))
    rows = _least(cols, lambda c: c["rows"] > 2.5, lambda c: c["col_idx"])
    likely = let(best, lambda b: F.when(b["score"] >= 0.6, -b["o"]))
    return F.when(titled >= 0, titled).otherwise(F.coalesce(by_id, likely, rows, F.lit(-1)))


def _pairs(cols: Column, right: int) -> Column:
    """Pair scores under their left (0) or right (1) column, as (score, -column)."""
    end = F.array_max(F.transform(F.filter(cols, lambda c: c["own"]), lambda c: c["col_idx"]))
    some = F.filter(cols, lambda c: (c["col_idx"] >= 0) & (c["col_idx"] < end) & c["pair"].isNotNull())
    return F.transform(some, lambda c: F.struct(c["pair"].alias("score"), (-(c["col_idx"] + right)).alias("o")))


# --- By content. ``n`` is the number of data rows looked at.


def _best(cols: Column, score, above: float) -> Column:
    """The first column of the highest score, if that is above a bound, else -1."""
    some = F.filter(cols, lambda c: c["sampled"] > 0)
    best = F.array_max(F.transform(some, lambda c: F.struct(score(c).alias("score"), (-c["col_idx"]).alias("o"))))
    return F.when(best["score"] > above, -best["o"]).otherwise(-1)


def name_by_content(cols: Column, n: Column) -> Column:
    """The column with most text, Arabic counting twice more, above half of the possible."""
    return _best(cols, lambda c: F.try_divide(c["points"], n * 4), 0.5)


def id_by_content(cols: Column, n: Column, name: Column) -> Column:
    """The column whose numbers count up, the name column left out."""
    return _best(cols, lambda c: F.when(c["col_idx"] == name, 0.0).otherwise(F.try_divide(c["numbers"] + 2 * c["steps"], n * 3)), 0.4)


def numeric_columns(cols: Column, n: Column, name: Column, number: Column) -> Column:
    """(col_idx, mean) of the columns mostly of numbers from 0 to 20, in order."""
    some = F.filter(cols, lambda c: (c["sampled"] > 0) & (c["numbers"] > 0.7 * n) & (c["inside"] > 0.5 * n) & (c["col_idx"] != name) & (c["col_idx"] != number))
    return F.transform(some, lambda c: F.struct(c["col_idx"].alias("col_idx"), c["mean"].alias("mean")))


def position_confidence(marks: Column, t: str) -> Column:
    """By how many numeric columns there are; a far higher first average makes activities sure and its slot doubtful."""
    k, (least, sure) = TYPES.index(t), {"fard1": (1, 0.8), "fard2": (2, 0.7), "fard3": (3, 0.6), "fard4": (4, 0.55), "activities": (5, 0.5)}[t]
    top = F.array_max(F.transform(marks, lambda x, i: F.struct(x["mean"].alias("mean"), (-i).alias("o"))))
    low = F.array_min(F.transform(marks, lambda x: x["mean"]))
    far = (F.size(marks) >= 2) & (top["mean"] - low > 3) & (top["mean"] > 10)
    own = F.when(F.size(marks) >= least, sure).otherwise(0.0)
    return F.when(far, 0.9).otherwise(own) if t == "activities" else F.when(far & (-top["o"] == k), 0.3).otherwise(own) if k < 3 else own


def mark_by_content(marks: Column, conf: Column, t: str, semantics: str = "reference") -> Column:
    """Types with confidence above a half take a numeric column. Reference: fard k the column after the k-th, activities none. Corrected: the k-th, activities the fifth."""
    k = TYPES.index(t)
    place = k if semantics == "corrected" else k + 1 if t != "activities" else None
    return F.lit(-1) if place is None else F.when(conf > 0.5, F.coalesce(F.get(marks, F.lit(place))["col_idx"], F.lit(-1))).otherwise(-1)


# --- Whole sheets.


def infer_structure(cells: DataFrame, semantics: str = "reference") -> DataFrame:
    """One row per sheet: n_rows, n_cols, layout (official, generic or null), name_col, id_col, mark_cols, confidence, headers, extra_cols, valid.

    An official sheet goes by labels and titles; another by titles if one names the
    name column, else by content. A sheet without cells in its header row has no
    titles: headers and extra_cols are null and title rules find nothing.
    """
    cols, h, n, none = F.col("cols"), F.col("h"), F.col("n"), F.lit(-1)
    of = lambda name, t: F.col(f"{name}_{t}")
    sheets = described(cells).withColumns({"n": F.least(F.col("n_rows") - 1, F.lit(SAMPLE)), "headed": F.size("h") > 0})
    titled = {f"title_{t}": mark_by_title(h, t) for t in TYPES} | {f"sure_{t}": title_confidence(h, t) for t in TYPES}
    sheets = sheets.withColumns({"t_name": name_by_title(h, semantics), "t_id": id_by_title(h, semantics), "c_name": name_by_content(cols, n), **titled})
    sheets = sheets.withColumn("way", F.when(F.col("official"), "o").when(F.col("t_name") >= 0, "t").when(F.col("c_name") >= 0, "c"))
    sheets = sheets.withColumn("c_id", F.when(F.col("way") == "c", id_by_content(cols, n, F.col("c_name"))))
    sheets = sheets.withColumn("marks", F.when(F.col("way") == "c", numeric_columns(cols, n, F.col("c_name"), F.col("c_id"))))
    pick = lambda o, t, c: F.when((F.col("way") == "o") & F.col("headed"), o).when(F.col("way") == "t", t).when(F.col("way") == "c", c)
    sheets = sheets.withColumns({f"conf_{t}": F.coalesce(pick(of("sure", t), of("sure", t), position_confidence(F.col("marks"), t)), F.lit(0.0)) for t in TYPES})
    mark = lambda t: F.coalesce(pick(official_mark(F.col("labels"), of("title", t), t), of("title", t), mark_by_content(F.col("marks"), of("conf", t), t, semantics)), none)
    sheets = sheets.select(
        "sheet_id", "n_rows", "n_cols", F.when(F.col("way") == "o", "official").when(F.col("way").isNotNull(), "generic").alias("layout"),
        F.coalesce(pick(official_name(cols, h, F.col("t_name"), F.col("t_id")), F.col("t_name"), F.col("c_name")), none).alias("name_col"),
        F.coalesce(pick(F.col("t_id"), F.col("t_id"), F.col("c_id")), none).alias("id_col"),
        F.create_map(*[x for t in TYPES for x in (F.lit(t), mark(t))]).alias("mark_cols"),
        F.create_map(*[x for t in TYPES for x in (F.lit(t), of("conf", t))]).alias("confidence"),
        F.when(F.col("headed"), F.transform("h", lambda x: x["header"])).alias("headers"), F.when(F.col("headed"), h).alias("h"),
    )
    valid = (F.col("n_rows") >= 5) & F.col("layout").isNotNull()
    return sheets.withColumn("extra_cols", let(F.map_values("mark_cols"), lambda taken: extra_columns(h, taken))).drop("h").withColumn("valid", valid)


def official_names(cells: DataFrame, semantics: str = "reference") -> DataFrame:
    """(sheet_id, name_col) of sheets with titles, read as official ones."""
    h = F.col("h")
    sheets = described(cells).where(F.size("h") > 0).withColumns({"titled": name_by_title(h, semantics), "ids": id_by_title(h, semantics)})
    return sheets.select("sheet_id", official_name(F.col("cols"), h, F.col("titled"), F.col("ids")).alias("name_col"))


def name_scores(cells: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, of, score): how much a column's first rows (of: single), or its and its right neighbour's (pair), look like names, 0 to 1."""
    kept = described(cells).select("sheet_id", "n_cols", F.explode("cols").alias("c")).select("sheet_id", F.col("n_cols"), "c.col_idx", F.explode(F.array(F.struct(F.lit("single").alias("of"), F.col("c.single").alias("score")), F.struct(F.lit("pair").alias("of"), F.col("c.pair").alias("score")))).alias("s"))
    inside = (F.col("s.of") == "single") | (F.col("col_idx") >= 0) & (F.col("col_idx") + 1 < F.col("n_cols"))
    return kept.where(F.col("s.score").isNotNull() & inside).select("sheet_id", "col_idx", "s.of", "s.score")


def score_columns(cells: DataFrame) -> DataFrame:
    """(sheet_id, mark_type, row_idx, label_col, score_col): for each test label in the first five rows, the column of its scores."""
    found = described(cells).select("sheet_id", F.explode("labels").alias("l"))
    return found.select("sheet_id", F.explode("l.types").alias("mark_type"), F.col("l.row").alias("row_idx"), F.col("l.col").alias("label_col"), F.col("l.score").alias("score_col"))
