"""Matching students to sheet rows, and writing marks back.

roster: (sheet_id, row_idx, name_key[, row_key]); students carry sheet_id.
name_key is a normalised name, row_key the normalised text of the whole row.
Row 0 is never matched. A student takes the first tier with a hit, and in it the
lowest row: equal names, equal tokens in any order, close names with as many
tokens, the name as a phrase of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import NameMatch, compare_names, format_mark, has, normalize_name, token_sort, tokens, trim, validate_mark_edit
from .statistics import TYPES, detected_list, extraction_accuracy, ordinal


def _name_like(text: Column) -> Column:
    letters = has(text, f"[{V.ARABIC}]|[a-zA-Z]") & ~has(text, "^\\d+$") & ~has(text, "\\d{2}[-/]\\d{2}[-/]\\d{4}")
    return letters | (has(text, "^[\\p{L} ,\\-']+$") & (F.length(text) >= 2))


def roster_names(cells: DataFrame, structure: DataFrame) -> DataFrame:
    """(sheet_id, row_idx, name): the name cell with a name-like right, then left neighbour that it doesn't contain."""
    here = cells.join(structure.select("sheet_id", "name_col"), "sheet_id").where((F.col("name_col") >= 0) & (F.abs(F.col("col_idx") - F.col("name_col")) <= 1))
    text = F.when(F.col("kind") == "string", trim(F.col("str"))).when(F.col("kind") == "number", F.col("str"))
    # cells next to the name column: at most three a row
    side = lambda k, strings: F.max(F.when((F.col("col_idx") - F.col("name_col") == k) & (F.col("kind") == "string" if strings else F.lit(True)), text))
    rows = here.groupBy("sheet_id", "row_idx").agg(side(0, False).alias("own"), side(1, True).alias("right"), side(-1, True).alias("left"))
    joined = rows.withColumn("own", F.coalesce("own", F.lit("")))
    add_right = _name_like(F.col("right")) & (F.col("right") != "") & ~F.col("own").contains(F.col("right"))
    joined = joined.withColumn("own", F.when(F.coalesce(add_right, F.lit(False)), trim(F.concat_ws(" ", F.nullif("own", F.lit("")), "right"))).otherwise(F.col("own")))
    add_left = _name_like(F.col("left")) & (F.col("left") != "") & ~F.col("own").contains(F.col("left"))
    joined = joined.withColumn("own", F.when(F.coalesce(add_left, F.lit(False)), trim(F.concat_ws(" ", "left", F.nullif("own", F.lit(""))))).otherwise(F.col("own")))
    return joined.select("sheet_id", "row_idx", F.col("own").alias("name"))


def row_texts(cells: DataFrame) -> DataFrame:
    """(sheet_id, row_idx, row_text): the row's cells in column order; an Excel row has a bounded number of cells."""
    listed = cells.groupBy("sheet_id", "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", F.coalesce("str", F.lit("")).alias("s")))).alias("c"))
    return listed.select("sheet_id", "row_idx", F.array_join(F.transform("c", lambda x: x["s"]), " ").alias("row_text"))


def equal_names(students: DataFrame, roster: DataFrame) -> DataFrame:
    """Candidates (sheet_id, number, row_idx) with the same name."""
    return students.join(roster, ["sheet_id", "name_key"]).select("sheet_id", "number", "row_idx")


def equal_tokens(students: DataFrame, roster: DataFrame) -> DataFrame:
    """Candidates whose two or more tokens are the same in any order."""
    a = students.withColumn("sorted", token_sort(F.col("name_key"))).where(F.size(tokens(F.col("name_key"))) >= 2)
    return a.join(roster.select("sheet_id", "row_idx", token_sort(F.col("name_key")).alias("sorted")), ["sheet_id", "sorted"]).select("sheet_id", "number", "row_idx")


def name_pairs(left: DataFrame, right: DataFrame, config: NameMatch = NameMatch()) -> DataFrame:
    """(sheet_id, n, a, b): the pairs of ``left`` (sheet_id, n, a) and ``right`` (sheet_id, n, b) that ``compare_names`` may accept, and few others.

    Each of its branches leaves a trace that an equality join finds, so no sheet's
    names all meet. Keys are counted by sheet and the rarest are taken:

    * equal names; names that contain each other without blanks: the shorter
      one's rarest run of ``contained`` letters is among all runs of the longer one;
    * similarity of at least ``base``: of strings of at most L letters at most
      k = floor((1 - base) L) edits apart, each edit spoils two pairs of neighbouring
      letters, so one of the 2k + 1 rarest pairs of each is shared, k places apart
      at most, in one of the three forms that are compared;
    * similarity of at least ``overlap`` with common words: of s distinct words m
      are shared, so one of the s - m + 1 rarest; names that repeat a word show all.
    """
    forms = lambda c: F.array(c, F.replace(c, F.lit(" "), F.lit("")), token_sort(c))
    names = left.select("sheet_id", "n", F.col("a").alias("name"), F.lit(0).alias("side")).unionByName(right.select("sheet_id", "n", F.col("b").alias("name"), F.lit(1).alias("side"))).distinct()
    bare = F.replace(F.col("name"), F.lit(" "), F.lit(""))
    words = F.array_distinct(tokens(F.col("name")))
    edge = F.least(F.lit(config.base), F.lit(config.short))
    most = lambda length: F.floor(length * (1 - edge) / edge + 1e-9).cast("int")  # noqa: E731  edits to a longer partner

    # kinds: 0 to 2 letter pairs of a form, 3 words, 4 runs of letters
    pairs = F.flatten(F.transform(forms(F.col("name")), lambda f, i: F.transform(F.sequence(F.lit(1), F.greatest(F.length(f), F.lit(1))), lambda at: F.struct(i.cast("int").alias("kind"), F.substr(F.concat(F.lit("^"), f), at, F.lit(2)).alias("key"), at.cast("int").alias("at"), F.length(f).alias("length"), (2 * most(F.length(f)) + 1).alias("take")))))
    shared = F.greatest(F.lit(1), F.ceil(F.size(words) * 0.6).cast("int"))
    take = F.when(F.size(words) == F.col("n"), F.size(words) - shared + 1).otherwise(F.size(words))
    word_keys = F.transform(words, lambda w: F.struct(F.lit(3).alias("kind"), w.alias("key"), F.lit(0).alias("at"), F.size(words).alias("length"), take.alias("take")))
    runs = F.when(F.length(bare) >= config.contained, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(bare) - config.contained + 1), lambda at: F.substr(bare, at, F.lit(config.contained))))).otherwise(F.array().cast("array<string>"))
    run_keys = F.transform(runs, lambda w: F.struct(F.lit(4).alias("kind"), w.alias("key"), F.lit(0).alias("at"), F.length(bare).alias("length"), F.lit(1).alias("take")))
    keys = names.select("sheet_id", "n", "name", "side", F.inline(F.concat(pairs, word_keys, run_keys)))

    by = ["sheet_id", "n", "kind", "key"]
    counted = keys.join(keys.groupBy(*by).agg(F.count("*").alias("often")), by)
    rank = F.row_number().over(Window.partitionBy("sheet_id", "n", "side", "name", "kind").orderBy("often", "key", "at"))
    ranked = counted.withColumn("rare", rank <= F.col("take"))
    repeats = F.col("kind").eqNullSafe(3) & (F.col("length") < F.col("n"))
    row = lambda side, to: ranked.where(F.col("side") == side).select(*by, F.col("name").alias(to), F.col("at").alias(f"at_{to}"), F.col("length").alias(f"length_{to}"), F.col("rare").alias(f"rare_{to}"), repeats.alias(f"repeats_{to}"))
    one, other = row(0, "a"), row(1, "b")
    k = F.floor(F.greatest("length_a", "length_b") * (1 - edge) + 1e-9)
    close = (F.abs(F.col("length_a") - F.col("length_b")) <= k) & (F.abs(F.col("at_a") - F.col("at_b")) <= k)
    found = [
        one.where("rare_a and kind <= 3").join(other.where("rare_b and kind <= 3"), by).where((F.col("kind") == 3) | close),
        one.where("repeats_a").join(other.where("kind = 3 and not repeats_b"), by),
        one.where("kind = 3 and not repeats_a").join(other.where("repeats_b"), by),
        one.where("kind = 4 and rare_a").join(other.where("kind = 4"), by).where("length_a <= length_b"),
        one.where("kind = 4").join(other.where("kind = 4 and rare_b"), by).where("length_a > length_b"),
    ]
    equal = left.join(right, (left["sheet_id"] == right["sheet_id"]) & (left["a"] == right["b"])).select(left["sheet_id"], left["n"], "a", "b")
    out = equal
    for some in found:
        out = out.unionByName(some.select("sheet_id", "n", "a", "b"))
    return out.distinct()


def close_names(students: DataFrame, roster: DataFrame, config: NameMatch = NameMatch()) -> DataFrame:
    """Candidates (sheet_id, number, row_idx) with as many tokens and a name close enough."""
    return students.join(close_rows(students, roster, config), ["sheet_id", "name_key"]).select("sheet_id", "number", "row_idx")


LETTERS = ("letters0", "letters1")  # 128 bits


def letter_bits(name: Column) -> list[Column]:
    """LETTERS: a bit for each letter of a name and each time it comes (two may share one)."""
    bare = F.replace(name, F.lit(" "), F.lit(""))
    times = lambda c: F.length(bare) - F.length(F.replace(bare, c, F.lit("")))
    seen = F.flatten(F.transform(F.array_distinct(F.split(bare, "")), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(times(c), F.lit(1))), lambda k: F.pmod(F.xxhash64(c, k), F.lit(128)).cast("int"))))
    one = lambda at, k: F.when(F.floor(at / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)).otherwise(F.lit(0).cast("long"))
    half = lambda k: F.aggregate(seen, F.lit(0).cast("long"), lambda bits, at: bits.bitwiseOR(one(at, k)))
    return [half(k).alias(c) for k, c in enumerate(LETTERS)]


def may_be_close(config: NameMatch) -> Column:
    """True for names a and b, with a_ and b_ LETTERS, that ``compare_names`` may accept.

    An edit takes at most one letter from a name and adds at most one, in each of
    the three forms compared, so letters that only one of the two has are never
    more than edits; names that contain each other are let through.
    """
    x, y = (F.replace(F.col(c), F.lit(" "), F.lit("")) for c in ("a", "b"))
    only = lambda p, q: sum((F.bit_count(F.col(f"{p}_{c}").bitwiseAND(F.bitwise_not(F.col(f"{q}_{c}")))) for c in LETTERS[1:]), F.bit_count(F.col(f"{p}_{LETTERS[0]}").bitwiseAND(F.bitwise_not(F.col(f"{q}_{LETTERS[0]}")))))
    edge = min(config.base, config.short, config.overlap)
    few = F.greatest(only("a", "b"), only("b", "a")) <= F.greatest(F.length("a"), F.length("b")) * (1 - edge) + 1e-9
    return few | x.contains(y) | y.contains(x)


ALL_PAIRS = 500  # names of a sheet and number of tokens that are compared with each other without an index


def close_rows(names: DataFrame, roster: DataFrame, config: NameMatch = NameMatch()) -> DataFrame:
    """(sheet_id, name_key, row_idx): the lowest row with a close name. Distinct names are compared: in a sheet all of as many tokens, in one with more than ALL_PAIRS of them those that ``name_pairs`` finds."""
    counted = F.size(tokens(F.col("name_key"))).alias("n")
    left = names.select("sheet_id", counted, F.col("name_key").alias("a")).distinct()
    right = roster.groupBy("sheet_id", counted, F.col("name_key").alias("b")).agg(F.min("row_idx").alias("row_idx"))
    crowds = right.groupBy("sheet_id", "n").agg(F.count("*").alias("names")).where(F.col("names") > ALL_PAIRS).select("sheet_id", "n")
    by = ["sheet_id", "n"]
    bits = lambda df, c: df.select(*by, c, *[x.alias(f"{c}_{k}") for x, k in zip(letter_bits(F.col(c)), LETTERS)])
    if crowds.isEmpty():  # as many pairs as a left name's group has names, and those are few
        pairs = bits(left, "a").join(bits(right, "b"), by).where(may_be_close(config))
    else:
        few = left.join(right.join(crowds, by, "left_anti").select(*by, "b"), by).select(*by, "a", "b")
        pairs = few.unionByName(name_pairs(left.join(crowds, by, "left_semi"), right.join(crowds, by, "left_semi").select(*by, "b"), config))
    near = pairs.where(compare_names(F.col("a"), F.col("b"), config))
    return near.join(right, ["sheet_id", "n", "b"]).groupBy("sheet_id", F.col("a").alias("name_key")).agg(F.min("row_idx").alias("row_idx"))


def phrase_in_row(students: DataFrame, roster: DataFrame) -> DataFrame:
    """Candidates (sheet_id, number, row_idx) whose name is a whole phrase of the row's text."""
    return students.join(phrase_rows(students, roster), ["sheet_id", "name_key"]).select("sheet_id", "number", "row_idx")


def phrase_rows(names: DataFrame, roster: DataFrame) -> DataFrame:
    """(sheet_id, name_key, row_idx): the rows whose text has the name as a whole phrase.

    A name is looked for under the one of its words that the fewest rows of the
    sheet have, so a first name that half of them bear is no key; a name with a
    word that no row has is in none. Distinct names are looked for once.
    """
    words = roster.select("sheet_id", "row_idx", F.explode(F.array_distinct(tokens(F.col("row_key")))).alias("word"))
    often = words.groupBy("sheet_id", "word").agg(F.count("*").alias("rows"))
    names = names.where("name_key <> ''").select("sheet_id", "name_key").distinct()
    parts = names.select("sheet_id", "name_key", F.explode(F.array_distinct(tokens(F.col("name_key")))).alias("word")).join(often, ["sheet_id", "word"], "left")
    anchors = parts.groupBy("sheet_id", "name_key").agg(F.min(F.struct("rows", "word")).alias("least"), F.count_if(F.col("rows").isNull()).alias("nowhere")).where("nowhere = 0").select("sheet_id", "name_key", F.col("least.word").alias("word"))
    inside = F.concat(F.lit(" "), F.col("row_key"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("name_key"), F.lit(" ")))
    texts = roster.select("sheet_id", "row_idx", "row_key")
    return anchors.join(words, ["sheet_id", "word"]).join(texts, ["sheet_id", "row_idx"]).where(inside).select("sheet_id", "name_key", "row_idx")


def match_rows(students: DataFrame, roster: DataFrame, config: NameMatch = NameMatch(), semantics: str = "reference") -> DataFrame:
    """(sheet_id, number, name, row_idx, tier) per student; row_idx and tier are null where no tier has a hit.

    Tiers 1 and 2 are one join: names under themselves and under their sorted
    tokens, each with its lowest row. Tiers 3 and 4 look for the distinct names
    that are left. Each name takes the least (tier, row), and its students take
    that. Reference: an empty name matches the first row with an empty name;
    corrected: it matches nothing.
    """
    roster = roster.where("row_idx > 0")
    if "row_key" not in roster.columns:
        roster = roster.withColumn("row_key", F.col("name_key"))
    names = students.select("sheet_id", "name_key").distinct()
    if semantics != "reference":
        names = names.where("name_key <> ''")
    own = F.struct(F.lit(1).alias("tier"), F.col("name_key").alias("key"))
    in_order = F.struct(F.lit(2).alias("tier"), token_sort(F.col("name_key")).alias("key"))
    keys = F.inline(F.when(F.size(tokens(F.col("name_key"))) >= 2, F.array(own, in_order)).otherwise(F.array(own)))
    index = roster.select("sheet_id", "row_idx", keys).groupBy("sheet_id", "tier", "key").agg(F.min("row_idx").alias("row_idx"))
    hits = names.select("sheet_id", "name_key", keys).join(index, ["sheet_id", "tier", "key"]).select("sheet_id", "name_key", "tier", "row_idx")
    best = lambda df: df.groupBy("sheet_id", "name_key").agg(F.min(F.struct("tier", "row_idx")).alias("best"))
    known = names.join(best(hits), ["sheet_id", "name_key"], "left")
    rest = known.where("best is null").select("sheet_id", "name_key")
    tier = lambda found, k: found.select("sheet_id", "name_key", F.lit(k).alias("tier"), "row_idx")
    more = tier(close_rows(rest, roster, config), 3).unionByName(tier(phrase_rows(rest, roster), 4))
    settled = known.where("best is not null").unionByName(best(more))
    out = students.join(settled, ["sheet_id", "name_key"], "left")
    return out.select("sheet_id", "number", "name", F.col("best.row_idx").alias("row_idx"), F.col("best.tier").alias("tier"))


def unmatched(matches: DataFrame) -> DataFrame:
    """(sheet_id, n_unmatched, names): students without a row, by number."""
    gone = matches.where("row_idx is null")
    return gone.groupBy("sheet_id").agg(F.count("*").alias("n_unmatched"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "name"))), lambda x: x["name"]), "; ").alias("names"))


def wanted_marks(students: DataFrame, detected: DataFrame) -> DataFrame:
    """(sheet_id, number, mark_type, mark) for the types detected in the sheet's document."""
    types = detected.select("sheet_id", F.explode(detected_list()).alias("mark_type"))
    return students.unpivot(["sheet_id", "number"], list(TYPES), "mark_type", "mark").join(types, ["sheet_id", "mark_type"])


def mapping_preview(students: DataFrame, matches: DataFrame, detected: DataFrame, structure: DataFrame) -> DataFrame:
    """Per student and detected type: value, target column, its header and whether it will be inserted."""
    marks = wanted_marks(students, detected).join(matches.select("sheet_id", "number", "row_idx"), ["sheet_id", "number"])
    known = marks.join(structure.select("sheet_id", "mark_cols", "headers"), "sheet_id")
    target = F.coalesce(F.element_at("mark_cols", F.col("mark_type")), F.lit(-1))
    header = F.when(target >= 0, F.coalesce(F.nullif(F.get("headers", target), F.lit("")), F.concat(F.lit("Column "), target + 1))).otherwise(V.NO_COLUMN)
    insert = F.col("row_idx").isNotNull() & (target >= 0) & F.col("mark").isNotNull()
    return known.select("sheet_id", "number", "mark_type", "mark", "row_idx", target.alias("target_col"), header.alias("target_header"), insert.alias("will_insert"))


def preview_summary(preview: DataFrame, matches: DataFrame) -> DataFrame:
    """(sheet_id, n_students, n_found, n_not_found, n_marks)."""
    people = matches.groupBy("sheet_id").agg(F.count("*").alias("n_students"), F.count("row_idx").alias("n_found"))
    marks = preview.groupBy("sheet_id").agg(F.count_if("will_insert").alias("n_marks"))
    return people.join(marks, "sheet_id", "left").select("sheet_id", "n_students", "n_found", (F.col("n_students") - F.col("n_found")).alias("n_not_found"), F.coalesce("n_marks", F.lit(0)).alias("n_marks"))


def insertions(students: DataFrame, matches: DataFrame, detected: DataFrame, structure: DataFrame, available: DataFrame) -> DataFrame:
    """(sheet_id, row_idx, col_idx, number, str): every write, for types detected in the document and available in the sheet."""
    preview = mapping_preview(students, matches, detected, structure).where("will_insert")
    types = available.select("sheet_id", F.explode(detected_list()).alias("mark_type"))
    return preview.join(types, ["sheet_id", "mark_type"]).select("sheet_id", "row_idx", F.col("target_col").alias("col_idx"), "number", format_mark(F.col("mark")).alias("str"))


def insert_one(students: DataFrame, matches: DataFrame, detected: DataFrame, structure: DataFrame, mark_type: str) -> DataFrame:
    """The writes for one type; where it isn't detected, for the first detected type."""
    chosen = detected.select("sheet_id", F.when(F.col(f"has_{mark_type}"), F.lit(mark_type)).otherwise(F.get(detected_list(), F.lit(0))).alias("mark_type"))
    preview = mapping_preview(students, matches, detected, structure).where("will_insert")
    return preview.join(chosen, ["sheet_id", "mark_type"]).select("sheet_id", "row_idx", F.col("target_col").alias("col_idx"), "number", format_mark(F.col("mark")).alias("str"))


def apply_writes(cells: DataFrame, writes: DataFrame) -> DataFrame:
    """``cells`` with the writes in; of several to one cell that of the last student wins; other cells stay as they are."""
    last = writes.groupBy("sheet_id", "row_idx", "col_idx").agg(F.max_by("str", "number").alias("new"))
    joined = cells.join(last, ["sheet_id", "row_idx", "col_idx"], "full")
    written = F.col("new").isNotNull()
    return joined.select("sheet_id", "row_idx", "col_idx", F.when(written, F.when(F.col("new") == "", "empty").otherwise("string")).otherwise(F.col("kind")).alias("kind"), F.coalesce("new", "str").alias("str"), F.when(~written, F.col("num")).alias("num"))


def positional_writes(students: DataFrame, mark_type: str, start_row: int, column: int) -> DataFrame:
    """The i-th student's mark, or an empty text, goes to row start_row + i of one column."""
    place = F.row_number().over(Window.partitionBy("sheet_id").orderBy("number")) - 1
    return students.select("sheet_id", (place + start_row).alias("row_idx"), F.lit(column).alias("col_idx"), "number", F.coalesce(format_mark(F.col(mark_type)), F.lit("")).alias("str"))


def insertion_result(writes: DataFrame, matches: DataFrame) -> DataFrame:
    """(sheet_id, success, not_found): every write counts, also those a later student overwrites."""
    done = writes.groupBy("sheet_id").agg(F.count_if(F.col("str") != "").alias("success"))
    return matches.groupBy("sheet_id").agg(F.count_if(F.col("row_idx").isNull()).alias("not_found")).join(done, "sheet_id", "left").select("sheet_id", F.coalesce("success", F.lit(0)).alias("success"), "not_found")


def apply_corrections(long: DataFrame, corrections: DataFrame, key: str = "class_id") -> DataFrame:
    """Long marks (key, number, mark_type, mark, uncertain) with the last valid edit of each; an empty edit clears a mark; invalid ones are ignored."""
    read = corrections.withColumn("edit", validate_mark_edit(F.col("raw"))).where("edit.valid")
    last = read.groupBy(key, "number", "mark_type").agg(F.max_by(F.struct(F.col("edit.value").alias("value")), "edit_seq").alias("last"))
    joined = long.join(last, [key, "number", "mark_type"], "left")
    return joined.select(key, "number", "mark_type", F.when(F.col("last").isNotNull(), F.col("last.value")).otherwise(F.col("mark")).alias("mark"), (F.col("uncertain") & F.col("last").isNull()).alias("uncertain"))


def corrected_students(students: DataFrame, detected: DataFrame, corrections: DataFrame, uncertain, key: str = "class_id") -> DataFrame:
    """``apply_corrections`` of the students' long marks, ``uncertain`` telling of a mark whether it is: a student's row meets its edits whole, before it is parted by types."""
    read = corrections.withColumn("edit", validate_mark_edit(F.col("raw"))).where("edit.valid")
    of = lambda t, c: F.when(F.col("mark_type") == t, c)
    last = read.groupBy(key, "number").agg(*[F.max_by(of(t, F.struct(F.col("edit.value").alias("value"))), of(t, F.col("edit_seq"))).alias(f"e_{t}") for t in TYPES])
    known = students.join(detected.select(key, detected_list().alias("wanted")), key).join(last, [key, "number"], "left")

    def mark(t: str) -> Column:
        edited = F.col(f"e_{t}").isNotNull()
        return F.struct(F.lit(t).alias("mark_type"), F.when(edited, F.col(f"e_{t}.value")).otherwise(F.col(t)).alias("mark"), (F.coalesce(uncertain(F.col(t)), F.lit(False)) & ~edited).alias("uncertain"))

    long = known.select(key, "number", "wanted", F.inline(F.array(*map(mark, TYPES))))
    return long.where(F.array_contains("wanted", F.col("mark_type"))).drop("wanted")


def review_queue(long: DataFrame, students: DataFrame, detected: DataFrame, key: str = "class_id") -> DataFrame:
    """Uncertain marks of documents whose accuracy is below 100, in order."""
    poor = extraction_accuracy(students, detected, key).where("accuracy < 100").select(key, "accuracy")
    return long.where("uncertain").join(poor, key).withColumn("place", ordinal(F.col("mark_type"))).select(key, "number", "mark_type", "mark", "place", "accuracy")


def with_keys(names: DataFrame, column: str = "name", compose: bool = True) -> DataFrame:
    """``names`` with name_key, made where the row is: a name that composition can't change takes a few patterns, less than a shuffle to its like."""
    return names.withColumn("name_key", normalize_name(F.col(column), compose))
