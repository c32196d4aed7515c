"""Scalar functions over columns: digits, names, marks, rows of recognised text.

``semantics="reference"`` keeps known quirks; ``"corrected"`` mends those named
in each docstring. All are built-in expressions but ``nfkc``, which only texts
that it may change reach.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V

GAPS = f"[{V.SPACE}]+"
COMPOSED = "\\x00-\\x7F\\u0621-\\u063A\\u0641-\\u064A\\u0660-\\u0669"  # texts of these are their own NFKC form
# what isn't in a class is named by ranges here, as a negated class is searched for several times slower
NOT_PLAIN = "\\x00-\\x1F!-/:-@\\[-`{-\\u0620\\u063B-\\u0640\\u064B-\\x{10FFFF}"  # a name without these (Arabic and ASCII letters, digits, spaces) needs no step but of letters and spaces
CASED = "A-Z\\x80-\\u05FF\\u0700-\\x{10FFFF}"  # what may have another lower case
ALIKE = ("أإآةىؤئ", "اااهيوي")  # those of the letters that are read as one which a plain name may have
SPACES = "".join(c for c in map(chr, range(1 << 16)) if re.match(f"[{V.SPACE}]", c))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    # element_at knows its type, where get asks the whole body for it at every row
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(SPACES))


def has(s: Column, pattern: str) -> Column:
    return F.coalesce(s.rlike(pattern), F.lit(False))


def any_of(s: Column, words) -> Column:
    """Whether ``s`` contains one of ``words``."""
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return F.coalesce(out, F.lit(False))


def lowered(s: Column) -> Column:
    """Lower case; texts of Arabic and of ASCII without capitals, which have none to change, are spared the slow walk through Unicode's rules."""
    return F.when(s.rlike(f"[{CASED}]"), F.lower(s)).otherwise(s)


def normalize_arabic_digits(s: Column) -> Column:
    return F.when(s.rlike("[\\u0660-\\u0669]"), F.translate(s, "٠١٢٣٤٥٦٧٨٩", "0123456789")).otherwise(s)


def single_gaps(s: Column) -> Column:
    """``s`` with each run of white space made one space; most texts have nothing else and are spared the search for all kinds."""
    return F.when(s.contains("  ") | s.rlike("[\\t-\\r\\u00A0\\u1680-\\u3000\\uFEFF]"), F.regexp_replace(s, GAPS, " ")).otherwise(s)


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def before_nfkc(s: Column) -> Column:
    """The steps of ``normalize_name`` before Unicode composition."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), "[\\u200B-\\u200D\\uFEFF\\u2060\\u200E\\u200F\\u061C\\u202A-\\u202E\\u2066-\\u2069]", "")
    return F.regexp_replace(F.regexp_replace(s, "[\\u00A0\\u2000-\\u200A\\u202F\\u205F\\u3000]", " "), "\\u0640", "")


def after_nfkc(s: Column) -> Column:
    s = F.regexp_replace(s, "[\\u0610-\\u061A\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E8\\u06EA-\\u06ED]", "")
    s = F.translate(s, "یکہأإآٱةىؤئ", "يكهااااهيوي")
    s = F.regexp_replace(s, "[\\uFEFB-\\uFEFE]", "لا")
    s = F.regexp_replace(s, f"[^{V.ARABIC}a-zA-Z0-9{V.SPACE}]", " ")
    return lowered(trim(F.regexp_replace(s, GAPS, " ")))


def plain_form(s: Column) -> Column:
    """``normalize_name`` of a text without NOT_PLAIN characters: letters are replaced in one walk, without a pattern's search for each step."""
    return F.trim(F.regexp_replace(F.translate(s, ALIKE[0] + string.ascii_uppercase, ALIKE[1] + string.ascii_lowercase), " {2,}", " "))


def normalize_name(s: Column, compose: bool = True) -> Column:
    """A name's comparison form; null gives the empty string. ``compose=False`` leaves out NFKC, for columns known to need none."""
    given = F.coalesce(s, F.lit(""))
    other = given.rlike(f"[{NOT_PLAIN}]")
    bare = before_nfkc(s)
    if compose:
        # Python gets null in place of a text that composition leaves as it is
        changes = bare.rlike(f"[^{COMPOSED}]")
        bare = F.when(changes, nfkc(F.when(other, F.when(changes, bare)))).otherwise(bare)
    return F.when(other, after_nfkc(bare)).otherwise(plain_form(given))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, " +"), lambda w: w != "")


def token_sort(s: Column) -> Column:
    return F.array_join(F.array_sort(tokens(s)), " ")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 less the share of edits in the longer string; two empty strings: 1."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(F.try_divide((longer - F.levenshtein(a, b)).cast("double"), longer.cast("double")))


@dataclass(frozen=True)
class NameMatch:
    base: float = 0.82
    short: float = 0.9
    short_length: int = 6
    overlap: float = 0.78
    contained: int = 3


def compare_names(a: Column, b: Column, config: NameMatch = NameMatch()) -> Column:
    """Whether two normalised names are close enough."""
    pair = F.struct(a.alias("a"), b.alias("b"), F.replace(a, F.lit(" "), F.lit("")).alias("x"), F.replace(b, F.lit(" "), F.lit("")).alias("y"), F.array_distinct(tokens(a)).alias("s"), F.array_distinct(tokens(b)).alias("t"))

    def judged(p: Column) -> Column:
        inside = (p["x"].contains(p["y"]) | p["y"].contains(p["x"])) & (F.least(F.length(p["x"]), F.length(p["y"])) >= config.contained)
        best = F.greatest(similarity(p["a"], p["b"]), similarity(p["x"], p["y"]), similarity(token_sort(p["a"]), token_sort(p["b"])))
        first = F.when(F.least(F.length(p["a"]), F.length(p["b"])) <= config.short_length, config.short).otherwise(config.base)
        needed = F.greatest(F.lit(1), F.ceil(F.least(F.size(p["s"]), F.size(p["t"])) * 0.6).cast("int"))
        relaxed = (F.size(F.array_intersect(p["s"], p["t"])) >= needed) & (F.greatest(F.size(p["s"]), F.size(p["t"])) >= 2)
        return (p["a"] == p["b"]) | inside | (best >= F.when(relaxed, F.least(first, F.lit(config.overlap))).otherwise(first))

    return let(pair, judged)


def preprocess_mark(s: Column, corrected: bool = False) -> Column:
    """A mark's text after common recognition errors are mended; null or empty: null."""
    tight = F.regexp_replace(s, GAPS, "")
    if corrected:
        tight = F.regexp_replace(F.regexp_replace(s, "(?i)\\s*out\\s*of\\s*", "/"), GAPS, "")
    tight = F.regexp_replace(F.translate(tight, "،oO", ",00"), "[٫﹒·]", ".")

    def fixed(t: Column) -> Column:
        return (
            F.when(t.rlike("^\\d{2}100$"), F.concat(F.substring(t, 1, 2), F.lit(",00")))
            .when(t.rlike("^\\d100$"), F.concat(F.lit("0"), F.substring(t, 1, 1), F.lit(",00")))
            .when(t.rlike("^\\d{3}00$") & (t != "10000"), F.when(F.substring(t, 1, 2).try_cast("int") <= 20, F.concat(F.substring(t, 1, 2), F.lit(",00"))).otherwise(t))
            .when(t == "108,00", "10,00")
            .otherwise(t)
        )

    return F.when(F.length(s) > 0, let(tight, fixed))


def parse_mark(s: Column, semantics: str = "reference") -> Column:
    """A mark from 0 to 20 read from text, else null.

    Reference: a ratio's slash is optional, so "15" is 1 out of 5; a sign is
    dropped and any text around digits is ignored. Corrected: a ratio needs its
    slash or "out of", and a sign or letters make it no mark.
    """
    corrected = semantics == "corrected"
    ratio = "^(\\d{1,2})/(\\d{1,2})$" if corrected else "^(\\d{1,2})/?(?:0utf)?(\\d{1,2})$"
    number = "^(\\d+\\.?\\d*|\\.\\d+)"

    within = lambda v: F.when(v.between(0, 20), F.round(v, 2))

    def parsed(t: Column) -> Column:
        # no match gives an empty text: made null first, as a cast that fails costs far more than the match
        top, bottom = (F.nullif(F.regexp_extract(t, ratio, k), F.lit("")).try_cast("int") for k in (1, 2))
        share = F.when(bottom > 0, F.try_divide(top.cast("double"), bottom.cast("double")) * 20)
        dotted = F.regexp_replace(t, "^([^,]*),", "$1.")
        plain = F.when(dotted.rlike("^\\d+(\\.\\d*)?$"), dotted) if corrected else F.regexp_replace(dotted, "[^\\d.]", "")
        value = F.nullif(F.regexp_extract(plain, number, 1), F.lit("")).try_cast("double")
        return let(share, lambda r: F.coalesce(within(r), let(value, within)))

    def read(x: Column) -> Column:
        # a text without a digit, or an O read for one, has no mark; a plain decimal stays as it is in every step, and one or two digits in the first ones
        plain = let(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"), lambda v: F.when(v <= 20, v))
        return (
            F.when(~x.rlike("[0-9oO]"), None)
            .when(x.rlike("^[0-9]{1,2}[.,][0-9]{1,2}\\z"), plain)
            .when(x.rlike("^[0-9]{1,2}\\z"), parsed(x))
            .otherwise(let(preprocess_mark(x, corrected), parsed))
        )

    return let(s, read)


def is_numeric(s: Column) -> Column:
    return parse_mark(s).isNotNull()


def two_places(x: Column) -> Column:
    """``x`` with two decimals, rounded by its exact binary value: 10.575 lies below its decimal text and gives 10.57, where "%.2f" rounds that text up."""
    return F.call_function("format_number", x, F.lit("0.00"))


def format_mark(x: Column) -> Column:
    return two_places(x)


def numeric_prefix(s: Column) -> Column:
    """The number a text begins with, as a lenient reader takes it ("12abc": 12), else null."""
    return F.regexp_extract(s, f"^[{V.SPACE}]*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)", 1).try_cast("double")


def is_valid_name(s: Column) -> Column:
    return let(trim(s), lambda t: F.coalesce((F.length(t) >= 2) & t.rlike("\\p{L}"), F.lit(False)))


def is_strict_header(s: Column) -> Column:
    return F.coalesce(let(trim(s), lambda t: lowered(t).isin(*V.STRICT_HEADERS)), F.lit(False))


def bare_letters(s: Column) -> Column:
    return trim(F.regexp_replace(s, f"[^{V.ARABIC}{V.SPACE}A-Za-z]", ""))


def is_valid_student_name(s: Column) -> Column:
    """Whether a text has a letter and is no header; what has a letter is neither empty nor a number."""
    return has(s, f"[{V.ARABIC}A-Za-z]") & ~is_strict_header(s)


def clean_student_name(s: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(s, "[:؛]$", ""), f"^\\d+[{V.SPACE}]*", ""))


def is_summary_row(s: Column) -> Column:
    names = F.regexp_extract_all(s, F.lit(f"([{V.ARABIC}]{{3,}})"), F.lit(1))
    named = F.exists(names, lambda n: ~any_of(n, V.SUMMARY_NAMES))

    def tested(low: Column) -> Column:
        starts = F.lit(False)
        for word in V.SUMMARY_WORDS:
            starts = starts | low.startswith(word)
        return F.coalesce(starts | ((F.length(s) < 20) & any_of(low, V.SUMMARY_WORDS) & ~named), F.lit(False))

    return let(trim(s), lambda t: let(lowered(t), tested))


def titles(line: Column) -> Column:
    return F.filter(F.split(line, f"[{V.SPACE}|،]+"), lambda c: c != "")


def is_header_line(s: Column) -> Column:
    # a line that fits one of the first five patterns has a word of the last two, which are words alone: found without a pattern
    words = [w for p in V.HEADER_LINE[6:] for w in p.split("|")]
    return (any_of(s, words) | (any_of(s, ["student"]) & has(s, V.HEADER_LINE[5]))) & (F.size(titles(F.coalesce(s, F.lit("")))) >= 3)


def title_kind(title: Column) -> Column:
    kind = F
    for name, pattern in V.TITLE_KIND:
        kind = kind.when(title.rlike(pattern), name)
    return kind.otherwise("unknown")


def title_to_mark_type(title: Column) -> Column:
    plain = F.translate(F.regexp_replace(lowered(title), GAPS, ""), "أإآٱةى", "ااااهي")
    return let(plain, lambda t: _cases(t, V.TITLE_TYPE))


def _cases(t: Column, pairs) -> Column:
    kind = F
    for name, pattern in pairs:
        kind = kind.when(t.rlike(pattern), name)
    return kind.otherwise(F.lit(None).cast("string"))


def label_to_mark_type(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in V.LABEL_TO_TYPE.items() for x in pair]), label)


def validate_mark_edit(raw: Column) -> Column:
    """(valid, value): empty text clears a mark; a number from 0 to 20 sets it; anything else is no edit."""
    text = F.regexp_replace(trim(F.coalesce(raw, F.lit(""))), ",", ".")
    return let(text, lambda t: let(numeric_prefix(t), lambda v: F.struct(((t == "") | F.coalesce(v.between(0, 20), F.lit(False))).alias("valid"), F.when(v.between(0, 20), v).alias("value"))))


def score_band(x: Column) -> Column:
    return F.when(x >= 16, "excellent").when(x >= 14, "good").when(x >= 10, "pass").when(x.isNotNull(), "low")


def accuracy_band(p: Column) -> Column:
    return F.when(p >= 90, "success").when(p >= 75, "info").otherwise("warning")


def report_file_label(s: Column) -> Column:
    for pattern, to in (('[\\\\/:*?"<>|]+', "-"), (GAPS, "-"), ("-+", "-"), ("^-+", ""), ("-+$", "")):
        s = F.regexp_replace(s, pattern, to)
    return s
