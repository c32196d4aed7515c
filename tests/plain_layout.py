"""Sheet layouts by one grouping or join for each rule: slow, and what ``layout`` is held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import vocabulary as V
from gradeloom.functions.scalars import GAPS, any_of, has, numeric_prefix, trim
from gradeloom.operators.statistics import TYPES

DATE = "\\d{2}[-/]\\d{2}[-/]\\d{4}"


def _text(cells: DataFrame) -> DataFrame:
    """String cells with text."""
    return cells.where((F.col("kind") == "string") & (F.col("str") != ""))


def sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet_id").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"))


def official_layout(cells: DataFrame) -> DataFrame:
    """(sheet_id, official): at least two hits of the six indicator words in the first 20 rows."""
    hits = sum(F.col("str").contains(w).cast("int") for w in V.OFFICIAL_WORDS)
    shown = (F.col("row_idx") < 20) & (F.col("kind") == "string")
    return cells.groupBy("sheet_id").agg((F.coalesce(F.sum(F.when(shown, hits)), F.lit(0)) >= 2).alias("official"))


def header_cells(cells: DataFrame) -> DataFrame:
    """(sheet_id, header_row, col_idx, header): the first of 20 rows with a header word, else the first row."""
    hit = (F.col("row_idx") < 20) & (F.col("kind") == "string") & any_of(F.col("str"), V.HEADER_WORDS)
    row = cells.groupBy("sheet_id").agg(F.coalesce(F.min(F.when(hit, F.col("row_idx"))), F.lit(0)).alias("header_row"))
    shown = F.when((F.col("kind") == "empty") | ((F.col("kind") == "number") & (F.col("num") == 0)), "").otherwise(F.coalesce("str", F.lit("")))
    return cells.join(row, "sheet_id").where("row_idx = header_row").select("sheet_id", "header_row", "col_idx", shown.alias("header"))


def _by_title(headers: DataFrame, titles, name: str, lower: bool) -> DataFrame:
    text = F.lower("header") if lower else F.col("header")
    known = [t.lower() if lower else t for t in titles]
    filled = F.col("header") != ""
    exact, partial = filled & text.isin(*known), filled & any_of(text, known)
    at = lambda test: F.min(F.when(test, F.col("col_idx")))
    return headers.groupBy("sheet_id").agg(F.coalesce(at(exact), at(partial), F.lit(-1)).alias(name))


def name_by_title(headers: DataFrame, semantics: str = "reference") -> DataFrame:
    """(sheet_id, name_col). Corrected: an id title is no name title."""
    if semantics == "corrected":
        headers = headers.where(~F.col("header").isin(*V.ID_TITLES))
    return _by_title(headers, V.NAME_TITLES, "name_col", lower=True)


def id_by_title(headers: DataFrame, semantics: str = "reference") -> DataFrame:
    """(sheet_id, id_col). Corrected: only whole titles count."""
    if semantics == "corrected":
        return headers.groupBy("sheet_id").agg(F.coalesce(F.min(F.when(F.col("header").isin(*V.ID_TITLES), F.col("col_idx"))), F.lit(-1)).alias("id_col"))
    return _by_title(headers, V.ID_TITLES, "id_col", lower=False)


def marks_by_title(headers: DataFrame) -> DataFrame:
    """(sheet_id, fard1..activities): whole titles, then contained ones, then digits near a test word (not for activities); -1 if none."""
    filled, text = F.col("header") != "", F.col("header")

    def column(t: str) -> Column:
        tiers = [text.isin(*V.MARK_TITLES[t]), any_of(text, V.MARK_TITLES[t])] + ([has(text, V.FUZZY_TITLES[t])] if t in V.FUZZY_TITLES else [])
        return F.coalesce(*[F.min(F.when(filled & test, F.col("col_idx"))) for test in tiers], F.lit(-1)).alias(t)

    return headers.groupBy("sheet_id").agg(*map(column, TYPES))


def score_columns(cells: DataFrame) -> DataFrame:
    """(sheet_id, mark_type, row_idx, label_col, score_col): for each test label in the first five rows, the column of its scores.

    The score label is looked for one row down, same column and the next two,
    then on the same row in the next three; else it is the label's own column if
    a row follows.
    """
    types = F.array_compact(F.array(*[F.when(any_of(F.col("str"), V.TEST_LABELS[t]), F.lit(t)) for t in TYPES]))
    labels = _text(cells).where("row_idx < 5").select("sheet_id", "row_idx", F.col("col_idx").alias("label_col"), F.explode(types).alias("mark_type"))
    places = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(down).alias("down"), F.lit(right).alias("right")) for k, (down, right) in enumerate([(1, 0), (1, 1), (1, 2), (0, 1), (0, 2), (0, 3)])])
    asked = labels.withColumn("p", F.explode(places)).select("*", (F.col("row_idx") + F.col("p.down")).alias("r"), (F.col("label_col") + F.col("p.right")).alias("c"))
    scores = _text(cells).where((F.col("row_idx") < 6) & F.col("str").contains(V.SCORE_LABEL)).select("sheet_id", F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), F.lit(True).alias("hit"))
    found = asked.join(scores, ["sheet_id", "r", "c"], "left").groupBy("sheet_id", "mark_type", "row_idx", "label_col").agg(F.min_by("c", F.when(F.col("hit"), F.col("p.rank"))).alias("near"))
    sized = found.join(sizes(cells), "sheet_id")
    own = F.when(F.col("row_idx") + 1 < F.col("n_rows"), F.col("label_col")).otherwise(-1)
    return sized.select("sheet_id", "mark_type", "row_idx", "label_col", F.coalesce("near", own).alias("score_col"))


def official_mark_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet_id, fard1..activities): the last label's score column, else by title."""
    hits = score_columns(cells).where("score_col >= 0")
    last = hits.groupBy("sheet_id").agg(*[F.max_by("score_col", F.when(F.col("mark_type") == t, F.struct("row_idx", "label_col"))).alias(f"s_{t}") for t in TYPES])
    return marks_by_title(headers).join(last, "sheet_id", "left").select("sheet_id", *[F.coalesce(f"s_{t}", t).alias(t) for t in TYPES])


def title_confidence(headers: DataFrame) -> DataFrame:
    """(sheet_id, conf_fard1..): 0.9 for a strong title, 0.7 for a weak one; the last matching header wins; 0 if none."""
    text = F.lower("header")

    def of(t: str) -> Column:
        strong = any_of(text, V.STRONG_TITLES[t])
        weak = any_of(text, V.WEAK_ACTIVITIES) if t == "activities" else text.contains(V.WEAK_TITLES[t][0]) & text.contains(V.WEAK_TITLES[t][1])
        return F.when(strong, 0.9).when(weak, 0.7)

    return headers.groupBy("sheet_id").agg(*[F.coalesce(F.max_by(of(t), F.when(of(t).isNotNull(), F.col("col_idx"))), F.lit(0.0)).alias(f"conf_{t}") for t in TYPES])


def extra_columns(headers: DataFrame, mark_cols: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, header): assessment titles outside the mark columns."""
    known = mark_cols.unpivot("sheet_id", list(TYPES), "mark_type", "col_idx").where("col_idx >= 0").select("sheet_id", "col_idx")
    return headers.where(any_of(F.lower("header"), V.EXTRA_TITLES)).join(known, ["sheet_id", "col_idx"], "left_anti").select("sheet_id", "col_idx", "header")


def column_name_scores(cells: DataFrame, rows: int = 10) -> DataFrame:
    """(sheet_id, col_idx, score): how much a column's first rows look like names, 0 to 1."""
    t = trim(F.col("str"))
    letters = (has(t, f"[{V.ARABIC}]|[a-zA-Z]")) & (F.length(t) >= 2)
    points = 1.5 * letters.cast("int") + 1.0 * (F.size(F.split(t, GAPS)) >= 2).cast("int") + 0.5 * (~has(t, "^\\d+$")).cast("int") + 0.3 * (~has(t, DATE)).cast("int")
    return _text(cells).where(F.col("row_idx").between(1, rows)).groupBy("sheet_id", "col_idx").agg(F.least(F.lit(1.0), F.sum(points) / (F.count("*") * 3.3)).alias("score"))


def pair_name_scores(cells: DataFrame, rows: int = 10) -> DataFrame:
    """(sheet_id, col_idx, score) of a column joined with its right neighbour; col_idx is the left one."""
    some = _text(cells).where(F.col("row_idx").between(1, rows)).select("sheet_id", "row_idx", F.explode(F.array(F.col("col_idx"), F.col("col_idx") - 1)).alias("left"), "col_idx", trim(F.col("str")).alias("t"))
    pairs = some.groupBy("sheet_id", "row_idx", "left").agg(F.max(F.when(F.col("col_idx") == F.col("left"), F.col("t"))).alias("a"), F.max(F.when(F.col("col_idx") > F.col("left"), F.col("t"))).alias("b"))
    t = F.concat_ws(" ", "a", "b")
    points = 1.5 * (has(t, f"[{V.ARABIC}]|[a-zA-Z]") & (F.length(t) >= 3)).cast("int") + 1.0 * (F.size(F.split(t, GAPS)) >= 2).cast("int") + 0.5 * (~has(t, "^\\d+$")).cast("int")
    scored = pairs.join(sizes(cells), "sheet_id").where((F.col("left") >= 0) & (F.col("left") + 1 < F.col("n_cols")) & (t != ""))
    return scored.groupBy("sheet_id", F.col("left").alias("col_idx")).agg(F.least(F.lit(1.0), F.sum(points) / (F.count("*") * 3.0)).alias("score"))


def official_name_column(cells: DataFrame, headers: DataFrame, semantics: str = "reference") -> DataFrame:
    """(sheet_id, name_col): by title; else beside the id column; else the most name-like column or pair; else the first with name-like rows."""
    titled, ids = name_by_title(headers, semantics), id_by_title(headers, semantics)
    single, pair = column_name_scores(cells), pair_name_scores(cells)
    width = headers.groupBy("sheet_id").agg((F.max("col_idx") + 1).alias("w"))
    beside = single.join(ids.where("id_col >= 0"), "sheet_id").where("abs(col_idx - id_col) = 1 and score >= 0.6").groupBy("sheet_id").agg(F.max_by("col_idx", F.struct("score", "col_idx")).alias("beside"))
    both = single.unionByName(pair).unionByName(pair.withColumn("col_idx", F.col("col_idx") + 1))
    best = both.join(width, "sheet_id").where("col_idx < w").groupBy("sheet_id", "col_idx").agg(F.max("score").alias("score"))
    best = best.groupBy("sheet_id").agg(F.max_by("col_idx", F.struct("score", (-F.col("col_idx")).alias("o"))).alias("best"), F.max("score").alias("top"))
    t = F.col("str")
    words = F.size(F.split(trim(t), GAPS))
    points = 2 * has(t, f"[{V.ARABIC}]|[a-zA-Z]").cast("int") + words.between(2, 5).cast("int") + (~has(t, "^\\d+$") & ~has(t, DATE)).cast("int")
    rows = _text(cells).where("row_idx between 1 and 5").groupBy("sheet_id", "col_idx").agg(F.avg(points).alias("score")).where("score > 2.5").groupBy("sheet_id").agg(F.min("col_idx").alias("rows"))
    joined = titled.join(beside, "sheet_id", "left").join(best, "sheet_id", "left").join(rows, "sheet_id", "left")
    return joined.select("sheet_id", F.when(F.col("name_col") >= 0, F.col("name_col")).otherwise(F.coalesce("beside", F.when(F.col("top") >= 0.6, F.col("best")), "rows", F.lit(-1))).alias("name_col"))


def _sampled(cells: DataFrame, rows: int = 10) -> DataFrame:
    """Cells of the first data rows with value, the lenient number, and n, the rows looked at."""
    value = F.when(F.col("kind") == "number", F.col("num")).when(F.col("kind") == "string", numeric_prefix(F.col("str")))
    n = F.least(F.col("n_rows") - 1, F.lit(rows))
    return cells.join(sizes(cells), "sheet_id").where(F.col("row_idx").between(1, rows)).select("sheet_id", "row_idx", "col_idx", "kind", "str", value.alias("value"), n.alias("n"))


def name_by_content(cells: DataFrame) -> DataFrame:
    """(sheet_id, name_col): the column with most text, Arabic counting twice more, above half of the possible; -1 if none."""
    text = (F.col("kind") == "string") & (F.col("str") != "")
    points = text.cast("int") + 2 * (text & has(F.col("str"), f"[{V.ARABIC}]")).cast("int") + (text & (F.length("str") > 3)).cast("int")
    scores = _sampled(cells).groupBy("sheet_id", "col_idx").agg((F.sum(points) / (F.max("n") * 4)).alias("score"))
    return _best(scores, 0.5, "name_col")


def _best(scores: DataFrame, above: float, name: str) -> DataFrame:
    best = scores.groupBy("sheet_id").agg(F.max_by("col_idx", F.struct("score", (-F.col("col_idx")).alias("o"))).alias("c"), F.max("score").alias("s"))
    return best.select("sheet_id", F.when(F.col("s") > above, F.col("c")).otherwise(-1).alias(name))


def id_by_content(cells: DataFrame, names: DataFrame) -> DataFrame:
    """(sheet_id, id_col): the column whose numbers count up, the name column left out; -1 if none."""
    before = Window.partitionBy("sheet_id", "col_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    some = _sampled(cells).withColumn("last", F.coalesce(F.last("value", ignorenulls=True).over(before), F.lit(0.0)))
    steps = (F.col("row_idx") > 1) & (F.col("value") == F.col("last") + 1)
    points = F.col("value").isNotNull().cast("int") + 2 * F.coalesce(steps, F.lit(False)).cast("int")
    scores = some.groupBy("sheet_id", "col_idx").agg((F.sum(points) / (F.max("n") * 3)).alias("score"))
    scores = scores.join(names, "sheet_id").withColumn("score", F.when(F.col("col_idx") == F.col("name_col"), 0.0).otherwise(F.col("score")))
    return _best(scores, 0.4, "id_col")


def numeric_columns(cells: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """(sheet_id, col_idx, place, avg_mark): columns mostly of numbers from 0 to 20, numbered from 0."""
    inside = F.col("value").between(0, 20)
    counts = _sampled(cells).groupBy("sheet_id", "col_idx").agg(F.count("value").alias("numbers"), F.count_if(inside).alias("inside"), F.max("n").alias("n")).where("numbers > 0.7 * n and inside > 0.5 * n")
    kept = counts.join(names, "sheet_id").join(ids, "sheet_id").where("col_idx <> name_col and col_idx <> id_col").select("sheet_id", "col_idx")
    value = F.when(F.col("kind") == "number", F.col("num")).when(F.col("kind") == "string", numeric_prefix(F.col("str")))
    means = cells.where("row_idx >= 1").join(kept, ["sheet_id", "col_idx"]).groupBy("sheet_id", "col_idx").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_mark"))
    return means.select("sheet_id", "col_idx", (F.row_number().over(Window.partitionBy("sheet_id").orderBy("col_idx")) - 1).alias("place"), "avg_mark")


def position_confidence(columns: DataFrame) -> DataFrame:
    """(sheet_id, n, conf_fard1..): by how many numeric columns there are; a far higher first average makes activities sure and its slot doubtful."""
    stats = columns.groupBy("sheet_id").agg(F.count("*").alias("n"), F.max("avg_mark").alias("top"), F.min("avg_mark").alias("low"), F.max_by("place", F.struct("avg_mark", (-F.col("place")).alias("o"))).alias("at"))
    far = (F.col("n") >= 2) & (F.col("top") - F.col("low") > 3) & (F.col("top") > 10)
    given = {"fard1": (1, 0.8), "fard2": (2, 0.7), "fard3": (3, 0.6), "fard4": (4, 0.55), "activities": (5, 0.5)}
    out = []
    for k, (t, (least, c)) in enumerate(given.items()):
        own = F.when(F.col("n") >= least, c).otherwise(0.0)
        out.append((F.when(far, 0.9).otherwise(own) if t == "activities" else F.when(far & (F.col("at") == k), 0.3).otherwise(own) if k < 3 else own).alias(f"conf_{t}"))
    return stats.select("sheet_id", "n", *out)


def marks_by_content(columns: DataFrame, semantics: str = "reference") -> DataFrame:
    """(sheet_id, fard1.., conf_..): types with confidence above a half take a numeric column.

    Reference: fard k takes the column after the k-th, and activities none.
    Corrected: the k-th, and activities the fifth.
    """
    listed = columns.groupBy("sheet_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "col_idx"))), lambda x: x["col_idx"]).alias("cols"))
    conf = position_confidence(columns).join(listed, "sheet_id")

    def column(k: int, t: str) -> Column:
        place = k if semantics == "corrected" else (k + 1 if t != "activities" else None)
        return (F.lit(-1) if place is None else F.when(F.col(f"conf_{t}") > 0.5, F.coalesce(F.get("cols", F.lit(place)), F.lit(-1))).otherwise(-1)).alias(t)

    return conf.select("sheet_id", *[column(k, t) for k, t in enumerate(TYPES)], *[f"conf_{t}" for t in TYPES])


def infer_structure(cells: DataFrame, semantics: str = "reference") -> DataFrame:
    """One row per sheet: layout (official, generic or null), name_col, id_col, mark_cols, confidence, headers, extra_cols, n_rows, valid."""
    headers = header_cells(cells)
    base = sizes(cells).join(official_layout(cells), "sheet_id")
    title_name = name_by_title(headers, semantics)
    content_name = name_by_content(cells)
    content_id = id_by_content(cells, content_name)
    columns = numeric_columns(cells, content_name, content_id)
    pre = lambda df, p: df.select("sheet_id", *[F.col(c).alias(p + c) for c in df.columns if c != "sheet_id"])
    parts = [pre(official_name_column(cells, headers, semantics), "o_"), pre(title_name, "t_"), pre(content_name, "c_"), pre(id_by_title(headers, semantics), "t_"), pre(content_id, "c_"), pre(official_mark_columns(cells, headers), "o_"), pre(marks_by_title(headers), "t_"), pre(marks_by_content(columns, semantics), "c_"), pre(title_confidence(headers), "t_")]
    wide = reduce(lambda a, b: a.join(b, "sheet_id", "left"), parts, base)
    way = F.when(F.col("official"), "o").when(F.col("t_name_col") >= 0, "t").when(F.coalesce("c_name_col", F.lit(-1)) >= 0, "c")
    pick = lambda o, t, c: F.when(F.col("way") == "o", o).when(F.col("way") == "t", t).when(F.col("way") == "c", c)
    wide = wide.withColumn("way", way)
    minus = F.lit(-1)
    marks = F.create_map(*[x for t in TYPES for x in (F.lit(t), F.coalesce(pick(F.col(f"o_{t}"), F.col(f"t_{t}"), F.col(f"c_{t}")), minus))])
    conf = F.create_map(*[x for t in TYPES for x in (F.lit(t), F.coalesce(pick(F.col(f"t_conf_{t}"), F.col(f"t_conf_{t}"), F.col(f"c_conf_{t}")), F.lit(0.0)))])
    listed = headers.groupBy("sheet_id").agg(F.sort_array(F.collect_list(F.struct("col_idx", "header"))).alias("h"))
    out = wide.join(listed, "sheet_id", "left").select(
        "sheet_id", "n_rows", "n_cols", F.when(F.col("way") == "o", "official").when(F.col("way").isNotNull(), "generic").alias("layout"),
        F.coalesce(pick(F.col("o_name_col"), F.col("t_name_col"), F.col("c_name_col")), minus).alias("name_col"),
        F.coalesce(pick(F.col("t_id_col"), F.col("t_id_col"), F.col("c_id_col")), minus).alias("id_col"),
        marks.alias("mark_cols"), conf.alias("confidence"), F.transform("h", lambda x: x["header"]).alias("headers"),
        F.filter("h", lambda x: any_of(F.lower(x["header"]), V.EXTRA_TITLES)).alias("extra"),
    )
    taken = F.map_values("mark_cols")
    return out.withColumn("extra_cols", F.transform(F.filter("extra", lambda x: ~F.array_contains(taken, x["col_idx"])), lambda x: F.struct(x["col_idx"].alias("index"), x["header"].alias("header")))).drop("extra").withColumn("valid", (F.col("n_rows") >= 5) & F.col("layout").isNotNull())
