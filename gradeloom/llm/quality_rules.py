"""Quality rules as a short-circuit cascade of DataFrame expressions.

Each rule is a boolean expression over signals of a text. Rules are independent,
so any order gives the same verdict; the order decides how much is computed.
``plan_cascade`` measures every rule on a bounded sample: how often it rejects
and how long it takes. Rules then run by rejection per cost, the highest first,
as one CASE expression, so a rejected document pays for no later rule.

All of it is built-in expressions: no Python runs on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a ``window``-word stretch found at least twice in the array (the first occurrence included).

    Windows are compared by 64-bit hashes of their words' 64-bit hashes. Most
    texts repeat nothing, which the distinct count of hashes tells; only the
    others sort (hash, place) and count the union of the repeated stretches.
    """
    one = F.lit(1).cast("long")

    def covered(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            twice = F.filter(pairs, lambda x, j: (x["h"] == F.get(pairs, j - 1)["h"]) | (x["h"] == F.get(pairs, j + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        start = F.struct(F.lit(-window).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda seen, x: F.struct(x.alias("last"), (seen["n"] + F.least(F.lit(window).cast("long"), x - seen["last"])).alias("n"))
        return let(pairs, lambda p: F.aggregate(places(p), start, step, lambda seen: seen["n"]))

    def by_windows(ids: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ids) - window), lambda i: F.xxhash64(*[F.get(ids, i + k) for k in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), one - 1).otherwise(covered(h)))

    return F.when(F.size(words) <= window, one - 1).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), by_windows))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def signals(text: Column) -> dict[str, Column]:
    """The measures of a text (null: empty), each computed from the text alone."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words, repeated_words),
        "n_lines": F.size(worded_lines(text)).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit(r"[!?]{2,}(?=[\x20\x09-\x0D]|\z)")).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the signals it needs, by name, to a boolean."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]

    def of(self, known: dict[str, Column]) -> Column:
        return F.coalesce(self.rejects(*(known[n] for n in self.needs)), F.lit(True))


RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 100 * s > 30 * n),
    Rule("shouting", ("n_words", "n_shouts"), lambda n, s: 100 * s > 30 * n),
    Rule("long_words", ("n_words", "word_chars"), lambda n, c: (c > 40 * n) | (c < n * 3 / 2)),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 60 * n),
)
#: Rules that make up base_failed.
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Measured:
    rule: Rule
    rejection: float
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejection / self.seconds


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, seed: int = 7) -> list[Measured]:
    """Rules by rejection per second, measured on about ``sample_rows`` rows (a documented bound; the verdicts don't depend on it).

    An empty table or sample leaves the rules in the given order.
    """
    total = docs.count()
    if not total:
        return [Measured(r, 0.0, 1.0) for r in rules]
    some = cut(docs.select("text").sample(min(1.0, sample_rows / total), seed), "rules-sample")
    known = signals(F.col("text"))

    def timed(value: Column) -> tuple[float, float]:
        began = time.perf_counter()
        row = some.agg(F.avg(value.cast("double")).alias("share")).first()
        return row["share"] or 0.0, time.perf_counter() - began

    timed(F.length("text") < 0)  # warms the readers up
    _, idle = timed(F.length("text") < 0)
    found = []
    for rule in rules:
        share, seconds = timed(rule.of(known))
        found.append(Measured(rule, share, max(seconds - idle, 1e-3)))
    return sorted(found, key=lambda m: -m.worth)


def first_failure(order: Sequence[Rule], known: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, else null; later rules aren't evaluated."""
    case = F
    for rule in order:
        case = case.when(rule.of(known), F.lit(rule.name))
    return case.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every row of ``docs`` (doc_id, text).

    A null or empty text has no words and is rejected; a null doc_id stays null;
    repeated rows are judged each; an empty table gives no rows; other columns
    are ignored. Very long texts are measured whole.
    """
    order = order or [m.rule for m in plan_cascade(docs, rules)]
    measured = docs.select("doc_id", *(c.alias(n) for n, c in signals(F.col("text")).items()))
    known = {n: F.col(n) for n in measured.columns}
    by_name = {r.name: r for r in rules}
    failed = by_name[BASE[0]].of(known) | by_name[BASE[1]].of(known)
    out = measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), first_failure(order, known).isNull().alias("kept"))
    return out


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are; each rule is computed only where the earlier ones passed."""
    order = [m.rule for m in plan_cascade(docs, rules)]
    return docs.where(first_failure(order, signals(docs["text"])).isNull())


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS window_text FROM w, unnest(range(1, len(words) - 6)) u(i) WHERE len(words) >= 8),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, window_text) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '[!?]{2,}([\x20\x09-\x0D]|$)')) AS n_shouts
      FROM w LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_shouts > 30 * n_words OR word_chars > 40 * n_words OR word_chars < n_words * 3 / 2 OR 100 * n_dup_lines > 60 * n_lines) AS kept
FROM f
"""
