"""Gradebook tables derived from the driver's tables by Spark, so that every query grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import MARK_TYPES

GIVEN = ("محمد", "فاطمة", "أحمد", "خديجة", "يوسف", "عائشة", "كريم", "زينب", "إدريس", "سلمى")
FAMILY = ("العلوي", "بن علي", "الإدريسي", "الفاسي", "البوزيدي", "التازي", "الناصري", "المرابط")
PER_SHEET = 40
PER_REPLY = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many partitions as the session shuffles to: what follows costs much for few bytes, so adaptive execution isn't to join them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each supplier, a student for each of its orders, marks by line number from quantities."""
    mark = F.when(F.col("l_returnflag") != "R", F.round(F.col("l_quantity") * 0.4, 2))
    marks = [F.max(F.when(F.col("l_linenumber") == k + 1, F.col("mark"))).alias(t) for k, t in enumerate(MARK_TYPES)]
    # dealt by class, so that what joins or groups by class shuffles nothing again
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("class_id"), F.col("l_orderkey").alias("number"), "l_linenumber", mark.alias("mark")).repartition("class_id")
    wide = lines.groupBy("class_id", "number").agg(*marks)
    return wide.select("class_id", "number", F.when(F.col("number") % 17 != 0, F.concat(F.lit("student "), F.col("number"))).alias("name"), *MARK_TYPES)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("class_id")).distinct()
    return ids.select("class_id", *[F.lit(True).alias(f"has_fard{k}") for k in (1, 2, 3)], (F.col("class_id") % 3 != 0).alias("has_fard4"), (F.col("class_id") % 5 != 0).alias("has_activities"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from line items that were returned: some valid, some empty, some out of range or no number."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linenumber <= 5")
    raw = F.when(F.col("l_partkey") % 4 == 0, "").when(F.col("l_partkey") % 4 == 1, F.col("l_quantity").cast("int").cast("string")).when(F.col("l_partkey") % 4 == 2, F.lit("x")).otherwise(F.concat(F.floor(F.col("l_quantity") / 4).cast("string"), F.lit(",5")))
    return li.select(F.col("l_suppkey").alias("class_id"), F.col("l_orderkey").alias("number"), F.get(F.array(*map(F.lit, MARK_TYPES)), F.col("l_linenumber") - 1).alias("mark_type"), raw.alias("raw"), (F.col("l_partkey") * 100 + F.col("l_quantity")).cast("long").alias("edit_seq"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet_id, row_idx, name): parts as pupils, 40 to a sheet; names are ASCII."""
    name = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / PER_SHEET).alias("sheet_id"), (F.col("p_partkey") % PER_SHEET + 1).cast("int").alias("row_idx"), name.alias("name"))


def pupils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students for the roster: a sixth each same, swapped, cut short, unknown, same, and misspelt; marks from the part's size."""
    own = roster(spark, sf_dir)
    w = F.split("name", " ")
    turn = F.col("row_idx") % 6
    name = (
        F.when(turn == 1, F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(0)), F.array_join(F.slice(w, 3, 9), " ")))
        .when(turn == 2, F.expr("substring(name, 1, length(name) - 1)"))
        .when(turn == 3, F.concat(F.lit("nobody "), F.col("row_idx")))
        .when(turn == 5, F.concat(F.lit("z"), F.expr("substring(name, 2)")))
        .otherwise(F.col("name"))
    )
    mark = lambda k: F.when((F.col("row_idx") + k) % 5 != 0, ((F.col("row_idx") * 7 + F.col("sheet_id") * 3 + k * 5) % 81) / 4)
    return own.select("sheet_id", F.col("row_idx").cast("long").alias("number"), name.alias("name"), *[mark(k).alias(t) for k, t in enumerate(MARK_TYPES)])


def sheet_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = roster(spark, sf_dir).select("sheet_id").distinct()
    return ids.select("sheet_id", F.lit(True).alias("has_fard1"), F.lit(True).alias("has_fard2"), (F.col("sheet_id") % 2 == 0).alias("has_fard3"), F.lit(False).alias("has_fard4"), (F.col("sheet_id") % 3 != 0).alias("has_activities"))


def sheet_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known layouts for the roster's sheets: name in column 1, marks in columns 2 to 4, no column for fard3 in every fourth sheet."""
    ids = roster(spark, sf_dir).select("sheet_id").distinct()
    cols = F.create_map(F.lit("fard1"), F.lit(2), F.lit("fard2"), F.lit(3), F.lit("fard3"), F.when(F.col("sheet_id") % 4 == 0, -1).otherwise(4), F.lit("fard4"), F.lit(-1), F.lit("activities"), F.lit(5))
    return ids.select("sheet_id", F.lit(1).alias("name_col"), cols.alias("mark_cols"), F.array(*map(F.lit, ("no", "name", "t1", "t2", "t3", ""))).alias("headers"))


def _cell(row, col, text=None, number=None):
    if number is not None:
        return F.struct(row.cast("int").alias("row_idx"), F.lit(col).alias("col_idx"), F.lit("number").alias("kind"), number.cast("string").alias("str"), number.cast("double").alias("num"))
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(row.cast("int").alias("row_idx"), F.lit(col).alias("col_idx"), F.when(text == "", "empty").otherwise("string").alias("kind"), text.alias("str"), F.lit(None).cast("double").alias("num"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets in four layouts by turns: official with labels over score columns, French and Arabic titles, no titles, and (each fourth class parted in pairs) too few rows."""
    key, short = F.col("sheet_id") * PER_SHEET + F.col("row_idx") - 1, F.col("way") == 3
    parted = F.when(short, F.lit(1_000_000_000) + F.floor(key / 2)).otherwise(F.col("sheet_id"))
    people = spread(roster(spark, sf_dir), "sheet_id").withColumn("way", F.col("sheet_id") % 4).select(parted.alias("sheet_id"), F.when(short, key % 2 + 1).otherwise(F.col("row_idx")).cast("int").alias("row_idx"), "name", "way")
    row, n = F.col("row_idx"), F.col("row_idx")
    arabic = F.concat_ws(" ", F.get(F.array(*map(F.lit, GIVEN)), (row + F.col("sheet_id")).cast("int") % len(GIVEN)), F.get(F.array(*map(F.lit, FAMILY)), (row * 3).cast("int") % len(FAMILY)))
    mark = lambda k: (row * 7 + F.col("sheet_id") * 3 + k * 5) % 81 / 4
    official = F.array(_cell(row + 2, 0, number=n), _cell(row + 2, 1, arabic), _cell(row + 2, 2, number=mark(0)), _cell(row + 2, 3, "ok"), _cell(row + 2, 4, number=mark(1)), _cell(row + 2, 5, ""))
    titled = F.array(_cell(row, 0, number=n), _cell(row, 1, F.col("name")), _cell(row, 2, number=mark(0)), _cell(row, 3, number=mark(1)), _cell(row, 4, number=mark(2)))
    bare = F.array(_cell(row - 1, 0, number=n), _cell(row - 1, 1, arabic), *[_cell(row - 1, 2 + k, number=mark(k)) for k in range(5)])
    body = people.select("sheet_id", F.explode(F.when(F.col("way") == 0, official).when(F.col("way") == 2, bare).otherwise(titled)).alias("c"))
    top = F.lit(0)
    heads = people.select("sheet_id", "way").distinct()
    first = F.array(_cell(top, 0, "القسم"), _cell(top, 1, ":"), _cell(top, 2, F.concat(F.lit("class "), F.col("sheet_id"))), _cell(top, 3, "المستوى"), _cell(top, 4, "3"), _cell(top, 5, ""))
    second = F.array(*[_cell(top + 1, k, t) for k, t in enumerate(("رقم التلميذ", "إسم التلميذ", "الفرض الأول", "", "الفرض الثاني", ""))])
    third = F.array(*[_cell(top + 2, k, t) for k, t in enumerate(("", "", "النقطة", "ملاحظة", "النقطة", "ملاحظة"))])
    plain = F.array(*[_cell(top, k, t) for k, t in enumerate(("رقم", "Nom et prénom", "فرض 1", "اختبار 2", "تقويم"))])
    shown = F.when(F.col("way") == 0, F.concat(first, second, third)).when(F.col("way").isin(1, 3), plain)
    titles = heads.where("way <> 2").select("sheet_id", F.explode(shown).alias("c"))
    return body.unionByName(titles).select("sheet_id", "c.*")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, payload): recognised marksheets of 30 orders each; with bars, without, or without a header; JSON sound, empty, broken or none."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / PER_REPLY).alias("doc_id"), (F.col("o_orderkey") % PER_REPLY + 1).alias("i"), F.col("o_totalprice").alias("p"), F.col("o_custkey").alias("c"))
    name = F.concat_ws(" ", F.get(F.array(*map(F.lit, GIVEN)), (F.col("c") % len(GIVEN)).cast("int")), F.get(F.array(*map(F.lit, FAMILY)), (F.col("i") % len(FAMILY)).cast("int")))
    mark = lambda k: F.replace(F.format_string("%.2f", (F.floor(F.col("p") / (k + 1)) % 81 / 4).cast("double")), F.lit("."), F.lit(","))
    way = F.col("doc_id") % 5
    shown = (mark(0), F.when(F.col("i") % 7 != 0, mark(1)), mark(2))
    line = F.when(way == 3, name).otherwise(F.when(way == 2, F.concat_ws("  ", name, *shown)).otherwise(F.concat_ws(" | ", F.col("i").cast("string"), name, *shown)))
    item = F.struct(name.alias("name"), F.struct(mark(0).alias("fard1"), F.when(F.col("i") % 3 != 0, mark(1)).alias("fard2"), F.lit(None).cast("string").alias("fard3"), F.lit(None).cast("string").alias("fard4"), mark(2).alias("activities")).alias("marks"))
    rows = o.select("doc_id", "i", line.alias("line"), mark(0).alias("m"), item.alias("item"))
    by = spread(rows, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "line", "m", "item"))).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: x["line"]), "\n")
    marks = F.array_join(F.transform("r", lambda x: x["m"]), "\n")
    header = F.lit("رقم | الاسم | الفرض 1 | الفرض 2 | الأنشطة\n")
    text = F.when(F.col("doc_id") % 5 == 3, F.concat(lines, F.lit("\n"), marks)).otherwise(F.concat(header, lines, F.lit("\nالمجموع 30")))
    number = lambda x, t: F.replace(x["item"]["marks"][t], F.lit(","), F.lit(".")).cast("double").alias(t)
    items = F.transform("r", lambda x: F.struct(x["item"]["name"].alias("name"), F.struct(*[number(x, t) for t in MARK_TYPES]).alias("marks")))
    sound = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.struct(F.lit(True).alias("hasFard1"), F.lit(True).alias("hasFard2"), F.lit(False).alias("hasFard3"), F.lit(False).alias("hasFard4"), F.lit(True).alias("hasActivities")).alias("markTypes"), items.alias("students"))), F.lit("\n```"))
    payload = F.when(F.col("doc_id") % 6 == 0, '{"students": []}').when(F.col("doc_id") % 6 == 1, '{"students": [').when(F.col("doc_id") % 6 == 2, F.lit(None)).otherwise(sound)
    return by.select("doc_id", text.alias("text"), payload.alias("payload"))


def titled_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): marksheets of 30 orders each, every mark under its title."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / PER_REPLY).alias("doc_id"), (F.col("o_orderkey") % PER_REPLY + 1).alias("i"), F.col("o_totalprice").alias("p"), F.col("o_custkey").alias("c"))
    name = F.concat_ws(" ", F.get(F.array(*map(F.lit, GIVEN)), (F.col("c") % len(GIVEN)).cast("int")), F.get(F.array(*map(F.lit, FAMILY)), (F.col("i") % len(FAMILY)).cast("int")))
    mark = lambda k: F.replace(F.format_string("%.2f", (F.floor(F.col("p") / (k + 1)) % 81 / 4).cast("double")), F.lit("."), F.lit(","))
    rows = spread(o.select("doc_id", "i", F.concat_ws(" | ", name, mark(0), mark(1), mark(2)).alias("line")), "doc_id")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("الاسم | الفرض1 | الفرض2 | الأنشطة\n"), lines).alias("text"))


def as_usage(events: DataFrame) -> DataFrame:
    """Rows of the events table, batch or stream, as usage events."""
    kinds = {"view": "image_uploaded", "click": "ocr_started", "purchase": "marks_insertion_completed", "signup": "ocr_completed", "error": "ocr_failed"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
    return events.select(F.col("user_id").cast("string").alias("key"), F.lit(None).cast("string").alias("device_id"), kind.alias("event_type"), F.col("props").alias("metadata"), F.col("ts").cast("timestamp").alias("ts"))


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_usage(table(spark, sf_dir, "events"))


def usage_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id")).distinct().select(F.col("user_id").cast("string").alias("key"), (F.col("user_id") % 40).cast("int").alias("upload_limit"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, event_id, ts): an upload for each view; every seventh is sent again ten minutes later."""
    seen = table(spark, sf_dir, "events").where("event_type = 'view'")
    times = F.array_compact(F.array(F.col("ts"), F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("INTERVAL 10 MINUTES"))))
    return seen.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("event_id"), F.explode(times).alias("ts")).withColumn("ts", F.col("ts").cast("timestamp"))


def versioned_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, version, ts, text, payload): replies in up to three versions, each but the last with the marks of another document; every fifth comes twice."""
    now = replies(spark, sf_dir)
    other = now.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old_text"), F.col("payload").alias("old_payload"))
    both = now.join(other, "doc_id", "left")
    versions = both.select("*", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))).alias("version")).select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1))).alias("time"))
    last = F.col("version") == F.col("doc_id") % 3 + 1
    ts = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 50) * 60 + F.col("version") * 7)
    return versions.select("doc_id", F.col("version").cast("long").alias("version"), ts.alias("ts"), F.when(last, F.col("text")).otherwise(F.col("old_text")).alias("text"), F.when(last, F.col("payload")).otherwise(F.col("old_payload")).alias("payload"), "time")


def unreadable_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): marksheets of 30 orders each, of whose lines most have no name: a title stands there, or signs, or a fraction."""
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / PER_REPLY).alias("doc_id"), (F.col("o_orderkey") % PER_REPLY + 1).alias("i"), F.col("o_totalprice").alias("p"), (F.col("o_custkey") % 5).alias("form"))
    mark = lambda k: F.replace(F.format_string("%.2f", (F.floor(F.col("p") / (k + 1)) % 81 / 4).cast("double")), F.lit("."), F.lit(","))
    name = F.get(F.array(*map(F.lit, ("اسم التلميذ", "--", "-", "12/5", GIVEN[0]))), F.col("form").cast("int"))
    line = F.concat_ws(" | ", F.col("i").cast("string"), name, mark(0), mark(1), mark(2))
    by = spread(o.select("doc_id", "i", line.alias("line")), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("r"))
    return by.select("doc_id", F.concat(F.lit("رقم | الاسم | الفرض 1 | الفرض 2 | الأنشطة\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"))


def untitled_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of official sheets, ten parts each, whose names stand under no name title: beside the number, in the most name-like column, or in one that only begins with names."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("sheet_id"), (F.col("p_partkey") % 10 + 1).cast("int").alias("row_idx"), F.col("p_name").alias("name"))
    form = F.col("sheet_id") % 3
    first = F.split_part("name", F.lit(" "), F.lit(1))
    row = F.col("row_idx").cast("string")
    by_form = [
        (row, first, None, None, F.col("name")),
        (F.lit("01/02/2010"), F.when(F.col("row_idx") % 4 == 0, row).otherwise(first), F.col("name"), None, row),
        (None, None, F.when(F.col("row_idx") <= 5, F.col("name")).otherwise(F.concat(row, row)), None, None),
    ]
    titles = [("الرقم", "", "الفرض 1", "الفرض 2", ""), ("تاريخ الازدياد", "", "", "الفرض 1", "الفرض 2"), ("تاريخ الازدياد", "", "", "الفرض 1", "الفرض 2")]
    null = F.lit(None).cast("string")
    pick = lambda rows, c: F.when(form == 0, rows[0][c]).when(form == 1, rows[1][c]).otherwise(rows[2][c])
    text = lambda c: pick([[null if x is None else x for x in r] for r in by_form], c)
    cells = p.select("sheet_id", "row_idx", F.posexplode(F.array(*[text(c) for c in range(5)])).alias("col_idx", "str")).where("str is not null")
    heads = p.select("sheet_id").distinct().select("sheet_id", F.lit(0).alias("row_idx"), F.posexplode(F.array(*[pick([list(map(F.lit, r)) for r in titles], c) for c in range(5)])).alias("col_idx", "str"))
    both = heads.unionByName(cells)
    number = (F.col("row_idx") > 0) & (F.col("col_idx") == 0) & (form == 0)
    return both.select("sheet_id", "row_idx", "col_idx", F.when(F.col("str") == "", "empty").when(number, "number").otherwise("string").alias("kind"), "str", F.when(number, F.col("str").cast("double")).alias("num"))
