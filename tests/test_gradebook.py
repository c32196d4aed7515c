"""Scalars and operators on small hand-made inputs; registered queries against SQL."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import oracle
from gradeloom.functions import scalars as S
from gradeloom.functions.vocabulary import MARK_TYPES as TYPES
from gradeloom.operators import layout as L
from gradeloom.operators import matching as M
from gradeloom.operators import recognition as R
from gradeloom.operators import sheets as H
from gradeloom.operators import statistics as T
from gradeloom.operators import usage as U
from gradeloom.plans import queries as Q
from gradeloom.sources import readers as I

STUDENTS = "class_id long, number long, name string, fard1 double, fard2 double, fard3 double, fard4 double, activities double"
DETECTED = "class_id long, has_fard1 boolean, has_fard2 boolean, has_fard3 boolean, has_fard4 boolean, has_activities boolean"
CELLS = "sheet_id long, row_idx int, col_idx int, kind string, str string, num double"
REPLIES = "doc_id long, text string, payload string"


def check(spark, rows, schema, column):
    """Rows of (inputs..., want) where ``column`` gives something else."""
    df = spark.createDataFrame(rows, schema).withColumn("got", column)
    return [tuple(r) for r in df.where("not got <=> want").collect()]


def test_parse_mark(spark):
    table = [("15,50", 15.5), ("15.5", 15.5), ("14/20", 14.0), ("7/10", 14.0), ("15", 4.0), ("12", 10.0), ("18", 2.5), ("10", 10.0), ("20", 20.0), ("07", 0.0), ("9", 9.0), ("25", 8.0), ("07100", 7.0), ("3100", 3.0)]
    table += [("10100", 10.0), ("12500", 12.0), ("10000", None), ("108,00", 10.0), ("1O,5O", 10.5), ("-5", 5.0), ("0", 0.0), ("7 out of 10", None), ("غائب", None), ("احمد 12,50", 12.5), ("16/15", None), ("1.5.2", 1.5), ("١٥", None), ("", None), (None, None)]
    assert check(spark, table, "raw string, want double", S.parse_mark(F.col("raw"))) == []
    mended = [("15", 15.0), ("7 out of 10", 14.0), ("14/20", 14.0), ("-5", None), ("احمد 12,50", None), ("12,5", 12.5)]
    assert check(spark, mended, "raw string, want double", S.parse_mark(F.col("raw"), "corrected")) == []


def test_normalize_name(spark):
    table = [("أحمد بن عليّ", "احمد بن علي"), ("فاطمة الزهراء", "فاطمه الزهراء"), ("محـــمد", "محمد"), ("علی کریم", "علي كريم"), ("ﻻﻟﻪ", "لاله"), ("José Élan", "jos lan"), ("AÏT-Omar", "a t omar"), ("أ، ب", "ا، ب"), (None, ""), ("", "")]
    assert check(spark, table, "raw string, want string", S.normalize_name(F.col("raw"))) == []
    again = [(w, w) for _, w in table]
    assert check(spark, again, "raw string, want string", S.normalize_name(F.col("raw"))) == []


def test_compare_names(spark):
    table = [("karim alaoui", "karim alaouy", True), ("karim alaoui", "karim idrissi", False), ("karim alaoui", "alaoui karim", True), ("sara el idrissi", "sara el idrisi", True), ("nadia fassi", "nadya fasi", False), ("ali", "aly", False), ("ahmed amine", "ahmed", True), ("", "", True)]
    assert check(spark, table, "a string, b string, want boolean", S.compare_names(F.col("a"), F.col("b"))) == []


def test_row_tests(spark):
    assert check(spark, [("المجموع 12", True), ("total: 3", True), ("محمد العلوي 12", False)], "s string, want boolean", S.is_summary_row(F.col("s"))) == []
    assert check(spark, [("رقم | الاسم | الفرض 1", True), ("رقم الاسم", False), ("1 محمد 12", False)], "s string, want boolean", S.is_header_line(F.col("s"))) == []
    assert check(spark, [("الفرض1", "fard1"), ("fard2", "fard2"), ("الأنشطة", "activities"), ("x", None)], "s string, want string", S.title_to_mark_type(F.col("s"))) == []
    assert check(spark, [("12,5", True), ("21", False), ("", True), ("x", False), (None, True)], "s string, want boolean", S.validate_mark_edit(F.col("s"))["valid"]) == []
    assert check(spark, [("الفرض الأول", "fard1"), ("أنشطة", "activities"), ("?", None)], "s string, want string", S.label_to_mark_type(F.col("s"))) == []


def test_statistics_edges(spark):
    rows = [(1, 1, "a", 10.0, 20.0, None, None, None), (1, 2, "b", 10.0, 0.0, None, None, None), (1, 3, None, None, 25.0, None, None, 3.0), (2, 1, "x", None, None, None, None, None)]
    students, detected = spark.createDataFrame(rows, STUDENTS), spark.createDataFrame([(1, True, True, True, False, False), (2, True, False, False, False, False)], DETECTED)
    got = {(r["class_id"], r["mark_type"]): r for r in T.mark_statistics(students, detected).collect()}
    assert len(got) == 10
    one = got[1, "fard1"]
    assert (one["n_marks"], one["sd_mark"], one["n_missing"], one["bin_10_15"], one["median_mark"]) == (2, 0.0, 1, 2, 10.0)
    assert (got[1, "fard2"]["bin_15_20"], got[1, "fard2"]["max_mark"]) == (1, 25.0)
    assert (got[2, "fard1"]["min_mark"], got[2, "fard1"]["max_mark"], got[2, "fard1"]["n_missing"]) == (20.0, 0.0, 1)
    assert {r["side"] for r in T.outliers(students, detected).where("class_id = 1 and mark_type = 'fard1'").collect()} == {"high", "low"}
    assert [r["missing_rate"] for r in T.overall(students, detected).collect()] == [round(3 / 8, 6)]
    assert [r["missing_rate"] for r in T.overall(students, detected, "corrected").collect()] == [round(4 / 9, 6)]
    assert "low_pass" in {r["rule"] for r in T.recommendations(students, detected).where("class_id = 2").collect()}
    assert "low_pass" not in {r["rule"] for r in T.recommendations(students, detected, "corrected").where("class_id = 2").collect()}
    assert T.mark_statistics(students.limit(0), detected.limit(0)).count() == 0


def test_matching_cascade(spark):
    roster = spark.createDataFrame([(1, 0, "header"), (1, 1, "karim alaoui"), (1, 2, "sara el idrissi"), (1, 3, "omar fassi"), (1, 4, "karim alaoui")], "sheet_id long, row_idx int, name_key string").withColumn("row_key", F.concat(F.col("name_key"), F.lit(" zz yy")))
    people = ["karim alaoui", "idrissi el sara", "omar fasi", "zz", "nobody here", "header"]
    students = spark.createDataFrame([(1, k, p, p) for k, p in enumerate(people)], "sheet_id long, number long, name string, name_key string")
    got = {r["number"]: (r["row_idx"], r["tier"]) for r in M.match_rows(students, roster).collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (3, 3), 3: (1, 4), 4: (None, None), 5: (None, None)}


def test_last_write_wins(spark):
    cells = spark.createDataFrame([(1, 1, 0, "string", "a", None), (1, 1, 1, "number", "3", 3.0)], CELLS)
    writes = spark.createDataFrame([(1, 1, 1, 5, "5.00"), (1, 1, 1, 7, "7.00"), (1, 2, 1, 1, "1.00")], "sheet_id long, row_idx int, col_idx int, number long, str string")
    got = {(r["row_idx"], r["col_idx"]): (r["kind"], r["str"], r["num"]) for r in M.apply_writes(cells, writes).collect()}
    assert got == {(1, 0): ("string", "a", None), (1, 1): ("string", "7.00", None), (2, 1): ("string", "1.00", None)}


def grid(sheet, rows):
    out = []
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            kind = "empty" if v == "" else "string" if isinstance(v, str) else "number"
            out.append((sheet, r, c, kind, str(v), float(v) if kind == "number" else None))
    return out


def test_sheet_layouts(spark):
    official = [["القسم", ":", "1A", "", "", ""], ["رقم التلميذ", "إسم التلميذ", "الفرض الأول", "", "الفرض الثاني", ""], ["", "", "النقطة", "x", "النقطة", "x"]] + [[k, "محمد علي", 12.5, "", 9, ""] for k in range(1, 6)]
    content = [[k, "محمد العلوي", 11.5, 9, 17, 18.25, 3] for k in range(1, 9)]
    small = [["اسم", "x"], ["a b", 1], ["c d", 2], ["e f", 3]]
    cells = spark.createDataFrame(grid(1, official) + grid(2, content) + grid(3, small), CELLS)
    got = {r["sheet_id"]: r for r in L.infer_structure(cells).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["layout"], one["name_col"], one["id_col"], one["valid"]) == ("official", 1, 0, True)
    assert (one["mark_cols"]["fard1"], one["mark_cols"]["fard2"], one["mark_cols"]["fard3"]) == (2, 4, -1)
    assert (two["layout"], two["name_col"], two["id_col"]) == ("generic", 1, 0)
    assert (two["mark_cols"]["fard1"], two["mark_cols"]["activities"]) == (3, -1)  # one column late, as known
    assert not three["valid"]
    mended = {r["sheet_id"]: r for r in L.infer_structure(cells, "corrected").collect()}
    assert mended[2]["mark_cols"]["fard1"] == 2
    meta = {r["sheet_id"]: r["section"] for r in H.sheet_metadata(cells).collect()}
    assert meta == {1: "1A", 2: None, 3: None}
    assert [r["sheet_id"] for r in H.available_types(cells, L.infer_structure(cells)).where("has_fard2").collect()] == [1, 2]


def students_of(df):
    return [(r["number"], r["name"], r["fard1"], r["fard2"], r["activities"]) for r in df.orderBy("doc_id", "number").collect()]


def test_text_replies(spark):
    bars = "رقم|الاسم|الفرض1|الفرض2\n1|محمد علي|12,50|٨\n2|سارة|7/10|\nالمجموع 2\n3|عمر:|9|3"
    plain = "محمد علي\nسارة فاسي\n12,50\n9"
    docs = spark.createDataFrame([(1, bars), (2, plain), (3, None), (4, "")], "doc_id long, text string")
    got = students_of(R.students_from_text(docs).where("doc_id = 1"))
    assert got == [(1, "محمد علي", 12.5, 8.0, None), (2, "سارة", 14.0, None, None), (3, "عمر", 9.0, 3.0, None)]
    free = R.students_from_text(docs.withColumn("text", F.when(F.col("doc_id") == 2, F.concat(F.col("text"), F.lit("\nفرض 1"))).otherwise(F.col("text"))).where("doc_id = 2"))
    assert students_of(free)[:2] == [(1, "محمد علي", 12.5, None, None), (2, "سارة فاسي", 9.0, None, None)]
    assert R.students_from_text(docs.where("doc_id > 2")).count() == 0


def test_header_acceptance_is_greedy(spark):
    h, x = "رقم | الاسم | الفرض 1", "1 | محمد | 12"
    lines = [h, x, h, h, x, h, x, x, x, h]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert docs.select(R.accepted_headers(R.reply_lines(F.col("text"))).alias("a")).first()["a"] == [0, 3, 9]


def test_plain_names_take_the_short_way(spark):
    """A name of plain letters gives what all steps give, and NFKC in Python gets none."""
    plain = ["", " ", "  محمد   العلوي ", "Karim  ALAOUI", "فاطمة ىؤئإآ 12", "abc"]
    odd = ["محـمد", "عليّ", "a\tb", "a-b", "É", "ﻻ", "x\u00a0y", "٣", "😀", "علی", "a\u200bb", "\x00"]
    df = spark.createDataFrame([(w, w in odd) for w in plain + odd], "s string, odd boolean")
    assert df.where(F.col("s").rlike(f"[{S.NOT_PLAIN}]") != F.col("odd")).count() == 0
    long = S.after_nfkc(S.before_nfkc(F.col("s")))
    assert df.where(~F.col("odd") & (S.plain_form(F.col("s")) != long)).count() == 0
    assert df.where(S.normalize_name(F.col("s"), compose=False) != long).count() == 0


def test_lines_are_read_alike_by_cheaper_steps(spark):
    """Digits, gaps, cells, marks and header lines where the short ways of reading them end."""
    cells = [("7 : a", ["7", ": a"]), ("3 | محمد: | 12,5 | نص؛", ["3", "محمد", "12,5", "نص"]), ("1\u00a0محمد\u2003العلوي\t12", ["1", "محمد العلوي 12"]), ("12:", ["12"]), ("1234 x", ["1234", "x"]), ("9 ", ["9"])]
    assert check(spark, cells, "s string, want array<string>", R.row_cells(F.col("s"))) == []
    marks = [("20,01", None), ("20.00", 20.0), ("99,99", None), ("0,5", 0.5), ("51", None), ("25", 8.0), ("00", 0.0), ("7", 7.0), ("19,99", 19.99)]
    assert check(spark, marks, "s string, want double", S.parse_mark(F.col("s"))) == []
    heads = [("student a b mark", True), ("mark b student", True), ("student a b", False), ("x y fard", True), ("fard x", False), ("الفرض a b", True), (None, False)]
    assert check(spark, heads, "s string, want boolean", S.is_header_line(F.col("s"))) == []
    lowered = [("TOTAL É", "total é"), ("محمد 1", "محمد 1"), ("𐐀", "𐐨")]
    assert check(spark, lowered, "s string, want string", S.lowered(F.col("s"))) == []
    rows = R.section_rows(spark.createDataFrame([(1, "رقم | الاسم | الفرض 1\n1 | محمد | 12\nرقم | الاسم | الفرض 2\n2 | سارة | 9\n\nx y z")], "doc_id long, text string"))
    assert sorted((r["line_no"], r["line"]) for r in rows.collect()) == [(1, "1 | محمد | 12"), (3, "2 | سارة | 9")]


def test_sources_and_merge(spark):
    marks = dict.fromkeys(TYPES)
    sound = "```json\n" + json.dumps({"markTypes": {"hasFard1": True}, "students": [{"name": "أحمد", "marks": marks | {"fard1": 12.0}}, {"name": "سارة", "marks": marks}]}) + "\n```"
    text = "رقم|الاسم|الفرض1|الفرض2\n1|احمد|5|6\n2|سارة|7|8\n3|عمر|9|3"
    docs = spark.createDataFrame([(1, text, sound), (2, text, '{"students": ['), (3, text, '{"students": []}'), (4, "", "none")], REPLIES)
    parsed = R.parse_json_replies(docs)
    key = lambda s: s.withColumn("name_key", S.normalize_name(F.col("name")))
    students, errors = R.choose_sources(key(R.students_from_json(parsed)), key(R.students_from_text(docs)), parsed)
    got = {r["doc_id"]: students_of(students.where(F.col("doc_id") == r["doc_id"])) for r in students.select("doc_id").distinct().collect()}
    assert got[1] == [(1, "أحمد", 12.0, 6.0, None), (2, "سارة", 7.0, 8.0, None), (3, "عمر", 9.0, 3.0, None)]
    assert len(got[2]) == 3 and 3 not in got
    assert {(r["doc_id"], r["error"]) for r in errors.collect()} == {(3, "json_without_students"), (4, "no_students")}


def test_dedupe_keeps_the_first(spark):
    rows = [(1, 1, "A", 5.0, None), (1, 2, "a", 6.0, 7.0), (1, 3, "", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, number int, name string, fard1 double, fard2 double")
    for t in TYPES[2:]:
        df = df.withColumn(t, F.lit(None).cast("double"))
    for f in ("u_name", *R.FLAGS):
        df = df.withColumn(f, F.lit(False))
    got = R.dedupe_students(df.withColumn("name_key", F.lower("name"))).collect()
    assert [(r["number"], r["name"], r["fard1"], r["fard2"]) for r in got] == [(1, "A", 5.0, 7.0)]


def test_corrections(spark):
    long = spark.createDataFrame([(1, 1, "fard1", 5.0, True), (1, 2, "fard1", 6.0, True), (1, 3, "fard1", 7.0, True)], "class_id long, number long, mark_type string, mark double, uncertain boolean")
    edits = spark.createDataFrame([(1, 1, "fard1", "12", 1), (1, 1, "fard1", "13", 2), (1, 2, "fard1", "99", 1), (1, 3, "fard1", "", 1)], "class_id long, number long, mark_type string, raw string, edit_seq long")
    got = {r["number"]: (r["mark"], r["uncertain"]) for r in M.apply_corrections(long, edits).collect()}
    assert got == {1: (13.0, False), 2: (6.0, True), 3: (None, False)}


def test_quota_states(spark):
    events = spark.createDataFrame([("a", None, "image_uploaded", None, None)] * 3, "key string, device_id string, event_type string, metadata string, ts timestamp")
    limits = spark.createDataFrame([("a", 3), ("b", 4), ("c", 10)], "key string, upload_limit int")
    assert {r["key"]: r["state"] for r in U.quota_report(events, limits).collect()} == {"a": "blocked", "b": "warning", "c": "allowed"}


def test_streams(spark, tmp_path):
    from gradeloom.streaming import incremental as N

    source = tmp_path / "replies"
    source.mkdir()
    text = "رقم|الاسم|الفرض1|الفرض2\n1|احمد|5|6\n2|سارة|7|8"
    (source / "a.json").write_text(json.dumps({"doc_id": "x", "text": text, "payload": None}) + "\n")
    query = N.process_replies(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/students")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/accuracy")).first()["accuracy"] == 100
    events = tmp_path / "events"
    events.mkdir()
    (events / "e.json").write_text("".join(json.dumps({"key": "a", "event_type": "image_uploaded", "ts": "2024-01-01T00:00:00Z"}) + "\n" for _ in range(4)))
    limits = spark.createDataFrame([("a", 4)], "key string, upload_limit int")
    query = N.follow_quotas(spark, str(events), str(tmp_path / "log"), limits, str(tmp_path / "quota"), str(tmp_path / "state2"))
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "quota")).first()["state"] == "blocked"


def test_quotas_count_on_over_restarts(spark, tmp_path):
    from gradeloom.streaming import incremental as N

    folder = tmp_path / "events"
    folder.mkdir()
    limits = spark.createDataFrame([("a", 4), ("b", 10), ("c", 1)], "key string, upload_limit int")
    events = []

    def arrive(name, rows):
        events.extend(rows)
        (folder / name).write_text("".join(json.dumps({"key": k, "event_type": e, "ts": "2024-01-01T00:00:00Z"}) + "\n" for k, e in rows))
        assert N.follow_quotas(spark, str(folder), str(tmp_path / "log"), limits, str(tmp_path / "quota"), str(tmp_path / "state")).awaitTermination(120)
        report = N.latest_quotas(spark, str(tmp_path / "log"), limits)
        plain = U.quota_report(spark.createDataFrame(events, "key string, event_type string"), limits)
        assert sorted(report.collect()) == sorted(plain.collect())
        return {r["key"]: (r["uploads"], r["state"]) for r in report.collect()}

    assert arrive("1.json", [("a", "image_uploaded"), ("a", "image_uploaded"), ("b", "ocr_started"), ("z", "image_uploaded")]) == {"a": (2, "warning"), "b": (0, "allowed"), "c": (0, "warning")}
    assert arrive("2.json", [("a", "image_uploaded"), ("a", "image_uploaded"), ("c", "image_uploaded")]) == {"a": (4, "blocked"), "b": (0, "allowed"), "c": (1, "blocked")}
    # a later batch writes the keys that it changed, no others
    rows = spark.read.parquet(str(tmp_path / "quota"))
    last = rows.agg({"batch": "max"}).first()[0]
    assert {r["key"] for r in rows.where(rows["batch"] == last).collect()} == {"a", "c"}


def test_counts_grow_over_restarts(spark, tmp_path):
    from gradeloom.streaming import incremental as N

    folder = tmp_path / "events"
    folder.mkdir()
    kinds = "key string, device_id string, event_type string, metadata string, ts timestamp"

    def arrive(rows):
        spark.createDataFrame([(k, None, e, None, dt.datetime.fromisoformat(t)) for k, e, t in rows], kinds).write.mode("append").parquet(str(folder))
        events = I.stream_table(spark.createDataFrame([], kinds), str(folder))
        assert N.follow_counts(events, str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination(120)
        return {(r["window_start"].strftime("%d %H"), r["key"], r["event_type"]): r["n"] for r in N.latest_counts(spark, str(tmp_path / "counts")).collect()}

    first = arrive([("a", "ocr_started", "2024-01-05T10:10:00"), ("a", "ocr_started", "2024-01-05T10:50:00"), ("a", "unknown", "2024-01-05T10:50:00")])
    assert first == {("05 10", "a", "ocr_started"): 2}
    # the same hour again counts on, another key has its own count, an event of days before is too late
    second = arrive([("a", "ocr_started", "2024-01-05T10:59:59"), ("b", "ocr_failed", "2024-01-05T11:00:00"), ("a", "ocr_started", "2024-01-01T00:00:00")])
    assert second == {("05 10", "a", "ocr_started"): 3, ("05 11", "b", "ocr_failed"): 1}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, sf, name):
    assert oracle.difference(Q.QUERIES[name](spark, sf), Q.ORACLES[name], sf) == ""


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_two_places_by_the_exact_value(spark):
    """10.575 is a little less in binary; 10.125 is a true half."""
    from gradeloom.functions.scalars import format_mark

    rows = spark.createDataFrame([(10.575,), (10.125,), (7.0,), (None,)], "x double").select(format_mark(F.col("x")))
    assert [r[0] for r in rows.collect()] == ["10.57", "10.12", "7.00", None]


def test_letters_rule_out_no_close_name(spark):
    base = ["karim alaoui", "sara el idrissi", "aaaa bbbb", "nadia fassi zahra", "ali"]
    edited = [n[:k] + x + n[k + d :] for n in base for k in range(len(n)) for d in (0, 1, 2) for x in ("", "q", "ab")] + [" ".join(reversed(n.split())) for n in base] + ["bbbb aaaa"]
    pairs = spark.createDataFrame([(a, b) for a in base for b in sorted(set(edited))], "a string, b string")
    bits = [x.alias(f"{c}_{k}") for c in ("a", "b") for x, k in zip(M.letter_bits(F.col(c)), M.LETTERS)]
    config = S.NameMatch()
    judged = pairs.select("a", "b", *bits).select(M.may_be_close(config).alias("maybe"), S.compare_names(F.col("a"), F.col("b"), config).alias("close")).groupBy("maybe", "close").count().collect()
    counts = {(r["maybe"], r["close"]): r["count"] for r in judged}
    assert (False, True) not in counts and counts[(True, True)] > 100
    assert counts[(False, False)] > 4 * counts.get((True, False), 0)


def test_marks_and_names_read_by_short_ways_are_the_same(spark):
    for raw, mark in (("15,5", 15.5), ("20.01", None), ("7", 7.0), ("محمد", None), ("oo", 0.0), ("15,50\n", 15.5), ("00,5", 0.5)):
        assert spark.createDataFrame([(raw,)], "raw string").select(S.parse_mark(F.col("raw")).alias("m")).first()["m"] == mark
    for raw, low in (("TOTAL", "total"), ("ÉLÈVE", "élève"), ("المجموع", "المجموع"), ("\u212a", "k"), (None, None)):
        assert spark.createDataFrame([(raw,)], "raw string").select(S.lowered(F.col("raw")).alias("m")).first()["m"] == low


def test_a_batch_of_replies_is_read_once(spark, tmp_path):
    from gradeloom.streaming import incremental as N

    held = []
    docs = spark.createDataFrame([("1", "رقم|الاسم|الفرض1\n1|احمد|5", None)], REPLIES.replace("long", "string"))
    N.read_documents(docs, lambda df: held.append(df) or df)
    assert len(held) == 3
    with N.holding() as hold:
        kept = hold(docs)
        assert kept.storageLevel.useDisk
    assert not kept.storageLevel.useDisk


def test_sheet_metadata_streams_cells_by_the_places_asked_for(spark):
    rows = [(1, 0, 0, "string", "القسم", None), (1, 0, 1, "string", ":", None), (1, 0, 2, "string", "class 1", None), (2, 3, 1, "string", "مستوى", None), (2, 4, 1, "number", "6", 6.0), (3, 0, 0, "string", "x", None)]
    cells = spark.createDataFrame(rows, "sheet_id long, row_idx int, col_idx int, kind string, str string, num double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = H.sheet_metadata(cells)
        assert sorted(map(tuple, found.select("sheet_id", "level", "section").collect())) == [(1, None, "class 1"), (2, "6", None), (3, None, None)]
        assert "ShuffledHashJoin [sheet_id" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
