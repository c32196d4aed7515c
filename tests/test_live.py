"""Tables kept current by arriving uploads, replies and edits."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from gradeloom.operators import matching as M
from gradeloom.operators import running as K
from gradeloom.operators import statistics as T
from gradeloom.operators import usage as U
from gradeloom.streaming import incremental as N
from gradeloom.streaming.changes import BUCKETS, ChangeLog

START = dt.datetime(2024, 1, 1)


def test_gate_decides_in_event_order_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    limits = spark.createDataFrame([("a", 3), ("b", 9)], "key string, upload_limit int")
    every = []

    def arrive(name, rows):
        every.extend(rows)
        lines = [json.dumps({"key": k, "event_id": e, "ts": (START + dt.timedelta(minutes=m)).isoformat()}) for k, e, m in rows]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        stream = spark.readStream.schema("key string, event_id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        assert N.follow_uploads(stream, limits, str(tmp_path / "out"), str(tmp_path / "state"), late_seconds=1200).awaitTermination(180)
        return {tuple(r) for r in spark.read.schema(N.DECISION).parquet(str(tmp_path / "out")).select("key", "event_id", "decision", "remaining", "suspends").collect()}

    assert arrive("1", [("a", "e1", 0), ("a", "e3", 5), ("b", "f1", 1), (None, "x", 1), ("a", None, 1)]) == set()
    # e2 comes after e3 but was before it, e3 comes again, c has no limit; f2 lets all before it be decided
    second = arrive("2", [("a", "e2", 3), ("a", "e3", 6), ("a", "e4", 8), ("c", "g", 2), ("b", "f2", 40)])
    assert second == {("a", "e1", "warned", 2, False), ("a", "e2", "warned", 1, False), ("a", "e3", "warned", 0, True), ("a", "e4", "blocked", 0, False), ("b", "f1", "allowed", 8, False), ("c", "g", "blocked", 0, False)}
    # too late; f2 once more within the time that it is remembered
    third = arrive("3", [("a", "late", 4), ("b", "f2", 50), ("b", "f3", 90)])
    assert third == second | {("b", "f2", "allowed", 7, False)}
    counted = [e for e in every if e[1] not in ("late", "f3")]
    batch = U.upload_decisions(spark.createDataFrame([(k, e, START + dt.timedelta(minutes=m)) for k, e, m in counted], "key string, event_id string, ts timestamp"), limits)
    assert {tuple(r) for r in batch.select("key", "event_id", "decision", "remaining", "suspends").collect()} == third


def test_gate_decides_keys_that_share_a_bucket(spark, tmp_path):
    """Many keys are few states: each has its own count, limit and order, over restarts."""
    limits = spark.range(60).selectExpr("concat('k', id) as key", "cast(id % 7 as int) as upload_limit")
    every = [(f"k{n % 60}", f"e{n}", START + dt.timedelta(minutes=n // 150 * 150 + n * 37 % 150)) for n in range(450)]
    for part in range(3):
        rows = every[150 * part : 150 * part + 150]
        rows = rows + rows[::7]  # some come twice
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / str(part)).write_text("\n".join(json.dumps({"key": k, "event_id": e, "ts": t.isoformat()}) for k, e, t in rows) + "\n")
        stream = spark.readStream.schema("key string, event_id string, ts timestamp").json(str(tmp_path / "in"))
        assert N.follow_uploads(stream, limits, str(tmp_path / "out"), str(tmp_path / "state"), late_seconds=12_030, buckets=3).awaitTermination(180)
    due = START + dt.timedelta(minutes=449, seconds=-12_030)
    got = spark.read.schema(N.DECISION).parquet(str(tmp_path / "out")).drop("batch").collect()
    late = U.upload_decisions(spark.createDataFrame(every, "key string, event_id string, ts timestamp"), limits)
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in late.collect() if r["ts"] <= due) and len({r["key"] for r in got}) == 60


def test_change_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "k string, n long, v int", ["k", "n"], by=["k"], order=["v"])
    rows = lambda *r: spark.createDataFrame(list(r), log.schema)
    now = lambda: sorted(map(tuple, log.latest().collect()))
    assert now() == []
    log.write(rows(("a", 1, 1), ("b", 1, 1)), 0)
    log.write(rows(("a", 1, 5), ("c", 2, 2)), 1)
    log.write(rows(("a", 1, 3)), 2)  # an older version that comes later
    assert now() == [("a", 1, 5), ("b", 1, 1), ("c", 2, 2)]
    assert sorted(map(tuple, log.before(1).collect())) == [("a", 1, 1), ("b", 1, 1)]
    log.compact(1)
    log.write(rows(("a", 1, 9)), 1)  # a batch that the base holds comes again
    assert now() == [("a", 1, 5), ("b", 1, 1), ("c", 2, 2)]
    log.compact(2)
    assert sorted(p.name for p in (tmp_path / "log" / "base").iterdir() if p.name.startswith("upto")) == ["upto=2"] and now() == [("a", 1, 5), ("b", 1, 1), ("c", 2, 2)]
    (tmp_path / "log" / "log" / "batch=3").mkdir()  # begun and never finished
    assert now() == [("a", 1, 5), ("b", 1, 1), ("c", 2, 2)]
    bucket = [r[0] for r in rows(("c", 2, 2)).select(log.bucket()).collect()]
    assert 0 <= bucket[0] < BUCKETS and ("c", 2, 2) in map(tuple, log.latest(bucket).collect())


def test_replies_sent_again_and_anew(spark, tmp_path):
    source = tmp_path / "replies"
    source.mkdir()
    text = lambda *marks: "رقم|الاسم|الفرض1|الفرض2\n" + "\n".join(f"{k}|{n}|{m}|{m}" for k, (n, m) in enumerate(zip(("أحمد", "سارة", "عمر"), marks), 1))

    def arrive(name, *sent):
        (source / name).write_text("".join(json.dumps({"doc_id": d, "version": v, "ts": f"2024-01-01T00:{m:02d}:00Z", "text": t, "payload": None}) + "\n" for d, v, m, t in sent))
        assert N.follow_replies(spark, str(source), str(tmp_path / "table"), str(tmp_path / "state"), compact_every=2).awaitTermination(240)
        return sorted((r["doc_id"], r["number"], r["fard1"]) for r in N.current_students(spark, str(tmp_path / "table")).collect())

    first = arrive("1.json", ("x", 1, 0, text(5, 6)), ("y", 2, 1, text(7)), ("x", 1, 0, text(5, 6)))
    assert first == [("x", 1, 5.0), ("x", 2, 6.0), ("y", 1, 7.0)]
    # x anew with other students, y again, y's older version late
    second = arrive("2.json", ("x", 2, 2, text(1, 2, 3)), ("y", 2, 1, text(7)), ("y", 1, 0, text(9, 9)), ("z", 1, 3, ""))
    assert second == [("x", 1, 1.0), ("x", 2, 2.0), ("x", 3, 3.0), ("y", 1, 7.0)]
    known = {r["doc_id"]: (r["version"], r["n_students"]) for r in N.current_documents(spark, str(tmp_path / "table")).collect()}
    assert known == {"x": (2, 3), "y": (2, 1), "z": (1, 0)}


def test_replies_that_change_nothing_are_not_read(spark, tmp_path, monkeypatch):
    """An older version that comes later and a batch that only moves the watermark cost no reading; a version sent again sets the same rows anew."""
    source = tmp_path / "replies"
    source.mkdir()
    read = []
    known_documents = N.known_documents
    monkeypatch.setattr(N, "known_documents", lambda docs, hold: read.append(sorted(map(tuple, docs.select("doc_id", "version").collect()))) or known_documents(docs, hold))

    def arrive(name, *sent):
        (source / name).write_text("".join(json.dumps({"doc_id": d, "version": v, "ts": f"2024-01-{day:02d}T00:00:00Z", "text": f"رقم|الاسم|الفرض1\n1|أحمد|{v},00", "payload": None}) + "\n" for d, v, day in sent))
        assert N.follow_replies(spark, str(source), str(tmp_path / "table"), str(tmp_path / "state"), compact_every=3).awaitTermination(240)
        return sorted((r["doc_id"], r["version"], r["fard1"]) for r in N.current_students(spark, str(tmp_path / "table")).collect())

    assert arrive("1.json", ("x", 3, 1), ("x", 2, 1), ("y", 1, 1)) == [("x", 3, 3.0), ("y", 1, 1.0)]
    assert arrive("2.json", ("x", 1, 1), ("y", 2, 1), ("z", 5, 9)) == [("x", 3, 3.0), ("y", 2, 2.0), ("z", 5, 5.0)]
    all_of_them = [("w", 1, 1.0), ("x", 3, 3.0), ("y", 2, 2.0), ("z", 5, 5.0)]
    assert arrive("3.json", ("z", 4, 9), ("z", 5, 9), ("w", 1, 30)) == all_of_them
    assert arrive("4.json", ("z", 4, 30), ("z", 5, 30)) == all_of_them  # the stream has forgotten z by then
    assert read == [[("x", 3), ("y", 1)], [("y", 2), ("z", 5)], [("w", 1)], [("z", 5)]]


def test_known_documents_equal_the_sources_chosen_by_joins(spark):
    from pyspark.sql import functions as F

    from gradeloom.functions.scalars import normalize_name
    from gradeloom.operators import recognition as R

    rng = random.Random(5)
    names = ["أحمد", "احمد", "سارة", "Omar B", "omar  b", "José", "--", "عمر"]
    texts = [None, "", "x", "أحمد\n12\nسارة", *["رقم|الاسم|الفرض1|الأنشطة\n" + "\n".join(f"{k}|{rng.choice(names)}|{rng.randint(0, 25)},50|7" for k in range(rng.randint(0, 4))) for _ in range(6)]]
    given = lambda: {"markTypes": {"hasFard2": rng.random() < 0.5}, "students": [{"name": rng.choice([*names, ""]), "marks": {"fard1": rng.choice([None, 3.5]), "fard2": 9.0}} for _ in range(rng.randint(0, 3))]}
    payloads = [None, "none", '{"students": [', '{"students": []}', *["```json\n" + json.dumps(given()) + "\n```" for _ in range(6)]]
    docs = spark.createDataFrame([(k, 1, t, p) for k, (t, p) in enumerate((t, p) for t in texts for p in payloads)], "doc_id long, version long, text string, payload string").cache()
    got = N.known_documents(R.with_json(docs))
    parsed = R.parse_json_replies(docs)
    key = lambda s: s.withColumn("name_key", normalize_name(F.col("name")))
    students, errors = R.choose_sources(key(R.students_from_json(parsed)), key(R.students_from_text(docs)), parsed)
    detected = R.merge_types(R.detect_mark_types(docs), R.json_mark_types(parsed))
    plain = lambda df: sorted(map(repr, df.collect()))
    assert got.count() == 100 and plain(got.select("doc_id", F.inline("students"))) == plain(students)
    assert plain(got.where("error is not null").select("doc_id", "error")) == plain(errors)
    assert plain(got.where("accuracy is not null").select("doc_id", "accuracy")) == plain(T.extraction_accuracy(students, detected, "doc_id").select("doc_id", "accuracy"))


def test_a_base_is_read_without_a_shuffle(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "k string, v int", ["k"], order=["v"])
    for number, rows in enumerate(([("a", 3), ("b", 1)], [("a", 2), ("b", 5)])):
        log.write(spark.createDataFrame(rows, log.schema), number)
    log.compact(1)
    now = log.latest()
    assert sorted(map(tuple, now.collect())) == [("a", 3), ("b", 5)]
    assert "Exchange" not in now._jdf.queryExecution().executedPlan().toString()


def classes(spark, rng, n=90):
    marks = lambda: [rng.choice([None, round(rng.uniform(0, 20), 2), 10.0, 20.0, 0.0]) for _ in T.TYPES]
    students = spark.createDataFrame([(k % 4, k, f"s{k}", *marks()) for k in range(n)], "class_id long, number long, name string, " + ", ".join(f"{t} double" for t in T.TYPES))
    detected = spark.createDataFrame([(c, True, True, c % 2 == 0, False, c != 3) for c in range(4)], "class_id long, " + ", ".join(f"has_{t} boolean" for t in T.TYPES))
    return students, detected


@pytest.mark.parametrize("seed", [1])
def test_live_statistics_equal_a_recount(spark, tmp_path, seed):
    rng = random.Random(seed)
    students, detected = classes(spark, rng)
    edits = [(k % 4 if k % 9 else 77, k, rng.choice(T.TYPES), rng.choice(["", "x", "25", "12,5", "0", "20", str(rng.randint(0, 20))]), s) for s, k in enumerate(rng.choices(range(1, 60), k=120))]
    edits = [e for e in edits if e[0] != 1]  # class 1 is never edited
    live = N.LiveStatistics(spark, str(tmp_path), compact_every=2)
    live.begin(students, detected)
    order = rng.sample(edits, len(edits))
    for number, some in enumerate((order[:50], order[50:90], order[40:60], order[90:]), 1):
        live.edit(spark.createDataFrame(some, N.EDIT), number)
    long = T.long_marks(students, detected).selectExpr("class_id", "number", "mark_type", "mark", "false as uncertain")
    after = M.apply_corrections(long, spark.createDataFrame(edits, N.EDIT)).groupBy("class_id", "number").pivot("mark_type", list(T.TYPES)).max("mark").selectExpr("*", "cast(number as string) as name")
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    want = T.mark_statistics(after, detected)
    assert plain(live.statistics.latest().select(want.columns)) == plain(want)
    want = T.overall(after, detected)
    assert plain(live.overall.latest().select(want.columns)) == plain(want)
    # a batch writes the classes that it changes, no others
    live.edit(spark.createDataFrame([(2, 2, "fard1", "11", 1000), (3, 3, "fard2", "x", 1001)], N.EDIT), 5)
    assert {r["class_id"] for r in live.statistics.changed(5).collect()} == {2}


def test_counters_of_nothing(spark):
    empty = spark.createDataFrame([], N.COUNTERS)
    assert K.statistics_of(empty).count() == 0 and K.overall_of(empty).count() == 0
    gone = spark.createDataFrame([(1, "fard1", None, 3), (1, "fard1", 500, 0)], N.COUNTERS)
    row = K.statistics_of(gone).where("mark_type = 'fard1'").first()
    assert (row["n_marks"], row["n_missing"], row["min_mark"], row["max_mark"], row["median_mark"]) == (0, 3, 20.0, 0.0, 0.0)
    assert K.overall_of(gone).count() == 0


def test_name_pairs_lose_no_close_name(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gradeloom.functions.scalars import compare_names, tokens

    rng = random.Random(7)
    firsts = ["mohamed"] * 12 + ["karim", "sara", "ali", "el", "fatima zahra", "aly", "a"]
    lasts = ["alaoui", "alaouy", "idrissi", "idrisi", "fassi", "fasi", "el amrani", "amrani", "ben ali", "benali", "al", "ali", "", "b"]

    def name():
        text = f"{rng.choice(firsts)} {rng.choice(lasts)}".strip()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "a", "x", " ", text[at : at + 1] * 2]) + text[at + rng.randint(0, 1) :]
        return " ".join(rng.sample(text.split(), len(text.split())) if rng.random() < 0.2 else text.split())

    rows = lambda n: spark.createDataFrame([(k % 2, name()) for k in range(n)] + [(0, ""), (1, "x")], "sheet_id long, name string").distinct()
    counted = F.size(tokens(F.col("name"))).alias("n")
    left, right = rows(260).select("sheet_id", counted, F.col("name").alias("a")).cache(), rows(260).select("sheet_id", counted, F.col("name").alias("b")).cache()
    everything = left.join(right, ["sheet_id", "n"])
    want = {tuple(r) for r in everything.where(compare_names(F.col("a"), F.col("b"))).collect()}
    found = {tuple(r) for r in M.name_pairs(left, right).collect()}
    assert len(want) > 200
    assert not want - found
    assert len(found) < everything.count()
    roster = right.selectExpr("sheet_id", "b as name_key", "cast(abs(hash(b)) % 1000 as int) as row_idx")
    names = left.selectExpr("sheet_id", "a as name_key")
    plain = {tuple(r) for r in M.close_rows(names, roster).collect()}
    monkeypatch.setattr(M, "ALL_PAIRS", 40)
    assert {tuple(r) for r in M.close_rows(names, roster).collect()} == plain


def test_a_common_first_name_is_no_key(spark):
    roster = spark.createDataFrame([(1, k, f"mohamed fam{k} x", f"{k} mohamed fam{k} x") for k in range(1, 300)] + [(1, 300, "sara", "sara q"), (2, 1, "mohamed", "mohamed")], "sheet_id long, row_idx int, name_key string, row_key string")
    students = spark.createDataFrame([(1, 1, "mohamed fam7", "mohamed fam7"), (1, 2, "mohamed", "mohamed"), (1, 3, "mohamed nobody", "mohamed nobody"), (1, 4, "q", "q"), (1, 5, "", ""), (2, 6, "fam7", "fam7")], "sheet_id long, number int, name string, name_key string")
    assert {(r["number"], r["row_idx"]) for r in M.phrase_in_row(students, roster).collect()} == {(1, 7), (4, 300)} | {(2, k) for k in range(1, 300)}
    assert {(r["number"], r["row_idx"], r["tier"]) for r in M.match_rows(students, roster).collect()} == {(1, 7, 4), (2, 1, 4), (3, None, None), (4, 300, 4), (5, None, None), (6, None, None)}


def test_write_back_sets_its_cells_alone(spark, tmp_path):
    from gradeloom.sources.sheet_store import SheetStore

    store = SheetStore(spark, str(tmp_path))
    store.begin(spark.createDataFrame([(f"s{k}", r, c, "number" if c else "string", str(r), float(r) if c else None) for k in range(5) for r in range(3) for c in range(2)], "sheet_id string, row_idx int, col_idx int, kind string, str string, num double"))
    writes = spark.createDataFrame([("s1", 1, 1, 7, "9.50"), ("s1", 1, 1, 8, "11.00"), ("s3", 2, 5, 1, "12.00"), ("s3", 0, 1, 2, "")], "sheet_id string, row_idx int, col_idx int, number long, str string")
    before = {tuple(r) for r in store.cells().collect()}
    for _ in range(2):
        store.insert(writes, 1)
        after = {tuple(r) for r in store.cells().collect()}
        assert after - before == {("s1", 1, 1, "string", "11.00", None), ("s3", 2, 5, "string", "12.00", None), ("s3", 0, 1, "empty", "", None)}
        assert len(after) == len(before) + 1
    assert store.log.changed(1).count() == 3
    (tmp_path / "log" / "batch=2").mkdir()  # a write-back that never finished
    store.compact(1)
    assert {tuple(r) for r in store.cells().collect()} == after
    some = store.cells(spark.createDataFrame([("s3",), ("none",)], "sheet_id string"))
    assert {tuple(r) for r in some.collect()} == {x for x in after if x[0] == "s3"}


def test_files_of_replies_and_images(spark, tmp_path):
    from gradeloom.sources import readers as I

    (tmp_path / "replies").mkdir()
    (tmp_path / "replies" / "sheet-7.txt").write_text("رقم|الاسم\n1|أحمد")
    (tmp_path / "replies" / "empty.txt").write_text("")
    assert {(r["doc_id"], r["text"]) for r in I.read_replies(spark, str(tmp_path / "replies")).collect()} >= {("sheet-7", "رقم|الاسم\n1|أحمد")}
    (tmp_path / "images").mkdir()
    for name, size in (("a.png", 10), ("b.jpg", 6 << 20), ("c.txt", 5)):
        (tmp_path / "images" / name).write_bytes(b"x" * size)
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in I.image_gate(I.list_images(spark, str(tmp_path / "images"))).collect()}
    assert found == {"a.png": None, "b.jpg": "too_large_to_upload", "c.txt": "not_an_image"}


def test_queries_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as E; q = E.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), len(E.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    count, text, sql = run.stdout.split()[-3:]
    assert int(count) >= 63 and text == "False" and int(sql) >= 63, run.stderr[-800:]
