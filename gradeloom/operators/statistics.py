"""Class statistics: every operator takes ``students`` and ``detected`` and is keyed by class_id.

students: (class_id, number, name, fard1..fard4, activities); detected:
(class_id, has_fard1..has_fard4, has_activities). A null mark is a missing mark.
Ties keep the order of ``number``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scalars import accuracy_band, is_valid_name, two_places

TYPES = V.MARK_TYPES
PLACES = 6


def _round(c: Column) -> Column:
    """``c`` rounded; what a sum's order leaves of a half (10.0390624999…) is that half first."""
    return F.round(F.round(c, PLACES + 4), PLACES)


def ordinal(mark_type: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), mark_type).cast("int")


def detected_list(prefix: str = "") -> Column:
    return F.array_compact(F.array(*[F.when(F.col(f"{prefix}has_{t}"), F.lit(t)) for t in TYPES]))


def long_marks(students: DataFrame, detected: DataFrame, key: str = "class_id") -> DataFrame:
    """(class_id, number, name, mark_type, mark): one row per student and detected type, null marks included.

    A student's row meets its class before it is parted by types, so that one row is
    shuffled and not five, and what groups by class finds its rows together.
    """
    known = students.join(detected.select(key, detected_list().alias("wanted")), key)
    long = known.unpivot([key, "number", "name", "wanted"], list(TYPES), "mark_type", "mark")
    return long.where(F.array_contains("wanted", F.col("mark_type"))).select(key, "number", "name", "mark_type", "mark")


def _bins(mark: Column) -> list[Column]:
    return [
        F.count_if((mark >= 0) & (mark < 5)).alias("bin_0_5"),
        F.count_if((mark >= 5) & (mark < 10)).alias("bin_5_10"),
        F.count_if((mark >= 10) & (mark < 15)).alias("bin_10_15"),
        F.count_if((mark >= 15) & (mark <= 20)).alias("bin_15_20"),
    ]


def mark_statistics(students: DataFrame, detected: DataFrame) -> DataFrame:
    """Per class and type: count, sum, min, max, avg, median, sd, pass, fail, missing and the four bins.

    All five types of a class appear; one without marks has count 0, min 20 and
    max 0. One grouping; the exact median is cheap as marks have two decimals.
    """
    mark = F.col("mark")
    found = long_marks(students, detected).groupBy("class_id", "mark_type").agg(
        F.count("mark").alias("n_marks"), F.sum("mark").alias("sum_marks"), F.min("mark").alias("least"), F.max("mark").alias("most"), F.avg("mark").alias("mean"), F.percentile("mark", F.lit(0.5)).alias("mid"), F.stddev_pop("mark").alias("spread"),
        F.count_if(mark >= 10).alias("n_pass"), F.count_if(mark < 10).alias("n_fail"), F.count_if(mark.isNull()).alias("n_missing"), *_bins(mark),
    )
    every = students.select("class_id").distinct().select("class_id", F.explode(F.array(*map(F.lit, TYPES))).alias("mark_type"))
    out = every.join(found, ["class_id", "mark_type"], "left")
    zero = ("n_marks", "n_pass", "n_fail", "n_missing", "bin_0_5", "bin_5_10", "bin_10_15", "bin_15_20")
    nought = lambda c: _round(F.coalesce(F.col(c), F.lit(0.0)))
    return out.select(
        "class_id", "mark_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], nought("sum_marks").alias("sum_marks"), F.least(F.lit(20.0), F.coalesce("least", F.lit(20.0))).alias("min_mark"), F.greatest(F.lit(0.0), F.coalesce("most", F.lit(0.0))).alias("max_mark"), nought("mean").alias("avg_mark"), nought("mid").alias("median_mark"), nought("spread").alias("sd_mark")
    )


def overall(students: DataFrame, detected: DataFrame, semantics: str = "reference") -> DataFrame:
    """Per class over all detected marks: average, median, sd, pass and fail rate, missing rate, count.

    Marks are counted by value first, so that the many missing ones are one row of a
    type, and a class's counts are then one group. Reference: missing marks count
    only for types without any mark. Corrected: all missing marks count.
    """
    mark, k = F.col("mark"), F.col("k")
    counts = long_marks(students, detected).groupBy("class_id", "mark_type", "mark").agg(F.count("*").alias("k"))
    count = lambda test: F.coalesce(F.sum(F.when(test, k)), F.lit(0))
    by_type = [c for t in TYPES for c in (count((F.col("mark_type") == t) & mark.isNotNull()).alias(f"n_{t}"), count((F.col("mark_type") == t) & mark.isNull()).alias(f"gone_{t}"))]
    lost = sum(F.col(f"gone_{t}") if semantics == "corrected" else F.when(F.col(f"n_{t}") == 0, F.col(f"gone_{t}")).otherwise(0) for t in TYPES)
    whole = counts.groupBy("class_id").agg(count(mark.isNotNull()).alias("total_marks"), F.sum(mark * k).alias("s1"), F.sum(mark * mark * k).alias("s2"), F.percentile("mark", F.lit(0.5), k).alias("m"), count(mark >= 10).alias("passed"), *by_type).where("total_marks > 0").withColumn("missing", lost)
    n = F.col("total_marks")
    mean, p = F.col("s1") / n, F.col("passed") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.round(F.col("s2") / n - mean * mean, 12)))
    return whole.select("class_id", "total_marks", _round(mean).alias("overall_average"), _round(F.col("m")).alias("overall_median"), _round(deviation).alias("overall_sd"), _round(p).alias("pass_rate"), _round(1 - p).alias("fail_rate"), _round(F.col("missing") / (n + F.col("missing"))).alias("missing_rate"))


def _by_type(*order) -> Window:
    return Window.partitionBy("class_id", "mark_type").orderBy(*order)


def ranked(students: DataFrame, detected: DataFrame, k: int | None = None) -> DataFrame:
    """(…, rank): marks from the highest down, ties by number; ``k`` keeps the first k of each class and type."""
    out = long_marks(students, detected).where("mark is not null").withColumn("rank", F.row_number().over(_by_type(F.desc("mark"), "number")))
    return out if k is None else out.where(F.col("rank") <= k)


def bottom(students: DataFrame, detected: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest marks of each class and type, ties by number."""
    return long_marks(students, detected).where("mark is not null").withColumn("rank", F.row_number().over(_by_type("mark", "number"))).where(F.col("rank") <= k)


def in_difficulty(students: DataFrame, detected: DataFrame) -> DataFrame:
    return bottom(students, detected, 5).where("mark < 10")


def outliers(students: DataFrame, detected: DataFrame) -> DataFrame:
    """Marks at least two deviations from the mean; with no deviation a mark is both high and low."""
    stats = mark_stats_only(students, detected)
    long = long_marks(students, detected).where("mark is not null")
    joined = long.join(stats, ["class_id", "mark_type"])
    sides = F.array_compact(F.array(F.when(F.col("mark") >= F.col("mean") + 2 * F.col("spread"), F.lit("high")), F.when(F.col("mark") <= F.col("mean") - 2 * F.col("spread"), F.lit("low"))))
    return joined.select("class_id", "mark_type", "number", "mark", F.explode(sides).alias("side"))


def mark_stats_only(students: DataFrame, detected: DataFrame) -> DataFrame:
    return long_marks(students, detected).groupBy("class_id", "mark_type").agg(F.avg("mark").alias("mean"), F.stddev_pop("mark").alias("spread"))


def mastery(students: DataFrame, detected: DataFrame) -> DataFrame:
    """Students by their mean mark: mastered from 15, in progress from 10, else (or without marks) not mastered; counts and rounded percentages."""
    known = students.join(detected, "class_id")
    marks = F.array_compact(F.array(*[F.when(F.col(f"has_{t}"), F.col(t)) for t in TYPES]))
    mean = F.try_divide(F.aggregate(marks, F.lit(0.0), lambda a, x: a + x), F.size(marks).cast("double"))
    level = known.select("class_id", _round(mean).alias("mean"))
    counts = level.groupBy("class_id").agg(F.count("*").alias("n_students"), F.count_if(F.col("mean") >= 15).alias("mastered"), F.count_if((F.col("mean") >= 10) & (F.col("mean") < 15)).alias("in_progress"))
    counts = counts.withColumn("not_mastered", F.col("n_students") - F.col("mastered") - F.col("in_progress"))
    percent = lambda c: F.floor(F.col(c) / F.col("n_students") * 100 + 0.5).cast("int").alias(f"{c}_pct")
    return counts.select("*", percent("mastered"), percent("in_progress"), percent("not_mastered"))


def recommendations(students: DataFrame, detected: DataFrame, semantics: str = "reference") -> DataFrame:
    """(class_id, place, rule, mark_type, text) in order: low pass rate, then per type low average, wide spread, many missing.

    Reference: a class without any mark still gets the low-pass advice;
    corrected: it doesn't.
    """
    rate = students.select("class_id").distinct().join(overall(students, detected).select("class_id", "pass_rate"), "class_id", "left")
    poor = F.col("pass_rate") < 0.6 if semantics == "corrected" else F.coalesce("pass_rate", F.lit(0.0)) < 0.6
    low = rate.where(poor).select("class_id", F.lit(0).alias("place"), F.lit("low_pass").alias("rule"), F.lit(None).cast("string").alias("mark_type"), F.lit(V.ADVICE["low_pass"]).alias("text"))
    wanted = detected.select("class_id", F.explode(detected_list()).alias("mark_type"))
    stats = mark_statistics(students, detected).join(wanted, ["class_id", "mark_type"])
    label = F.element_at(F.create_map(*[F.lit(x) for pair in V.LABELS.items() for x in pair]), F.col("mark_type"))
    missing = F.col("n_missing") / F.greatest(F.col("n_marks") + F.col("n_missing"), F.lit(1))
    rules = (
        ("low_average", (F.col("n_marks") > 0) & (F.col("avg_mark") < 10), F.format_string(V.ADVICE["low_average"], label)),
        ("spread", F.col("sd_mark") > 4, F.format_string(V.ADVICE["spread"], label, F.col("sd_mark"))),
        ("missing", missing > 0.1, F.format_string(V.ADVICE["missing"], label)),
    )
    found = F.array_compact(F.array(*[F.when(test, F.struct((ordinal(F.col("mark_type")) * 3 + k - 2).alias("place"), F.lit(name).alias("rule"), text.alias("text"))) for k, (name, test, text) in enumerate(rules)]))
    rest = stats.select("class_id", "mark_type", F.explode(found).alias("r")).select("class_id", "r.place", "r.rule", "mark_type", "r.text")
    return low.unionByName(rest)


def extraction_accuracy(students: DataFrame, detected: DataFrame, key: str = "class_id") -> DataFrame:
    """(class_id, accuracy, band): percent from valid marks (nine tenths) and valid names (one tenth); without detected types names alone."""
    known = students.join(detected, key)
    valid = sum((F.col(f"has_{t}") & F.coalesce(F.col(t).between(0, 20), F.lit(False))).cast("int") for t in TYPES)
    asked = sum(F.col(f"has_{t}").cast("int") for t in TYPES)
    sums = known.groupBy(key).agg(F.count("*").alias("n"), F.sum(valid).alias("good"), F.sum(asked).alias("asked"), F.count_if(is_valid_name(F.col("name"))).alias("named"))
    share = F.when(F.col("asked") == 0, F.col("named") / F.col("n")).otherwise(0.9 * F.try_divide(F.col("good"), F.col("asked")) + 0.1 * F.col("named") / F.col("n"))
    out = sums.select(key, F.floor(_round(share * 100) + 0.5).cast("int").alias("accuracy"))
    return out.withColumn("band", accuracy_band(F.col("accuracy")))


def shown_types(students: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected types of each class with at least one mark, in order."""
    return long_marks(students, detected).groupBy("class_id", "mark_type").agg(F.count("mark").alias("n_marks")).where("n_marks > 0").withColumn("place", ordinal(F.col("mark_type")))


def review_table(students: DataFrame, detected: DataFrame) -> DataFrame:
    """One row per student with a column per type, null where the type isn't detected."""
    known = students.join(detected, "class_id")
    return known.select("class_id", "number", "name", *[F.when(F.col(f"has_{t}"), F.col(t)).alias(t) for t in TYPES])


def report_series(students: DataFrame, detected: DataFrame) -> DataFrame:
    """(class_id, series, label, value): the averages by type, and the pass, fail and missing percentages."""
    wanted = detected.select("class_id", F.explode(detected_list()).alias("mark_type"))
    averages = mark_statistics(students, detected).join(wanted, ["class_id", "mark_type"]).where("n_marks > 0").select("class_id", F.lit("average").alias("series"), F.col("mark_type").alias("label"), "avg_mark")
    rates = overall(students, detected).unpivot("class_id", ["pass_rate", "fail_rate", "missing_rate"], "label", "rate").select("class_id", F.lit("rate").alias("series"), "label", F.floor(F.col("rate") * 100 + 0.5).cast("double").alias("value"))
    return averages.withColumnRenamed("avg_mark", "value").unionByName(rates)


def bin_shares(students: DataFrame, detected: DataFrame) -> DataFrame:
    """(class_id, mark_type, bin, n, share, percent): each bin against the largest one; 0 where all are empty."""
    stats = mark_statistics(students, detected)
    bins = ["bin_0_5", "bin_5_10", "bin_10_15", "bin_15_20"]
    most = stats.withColumn("most", F.greatest(*bins))
    long = most.unpivot(["class_id", "mark_type", "most"], bins, "bin", "n")
    share = F.coalesce(F.try_divide(F.col("n"), F.col("most")), F.lit(0.0))
    return long.select("class_id", "mark_type", "bin", "n", _round(share).alias("share"), F.floor(share * 100 + 0.5).cast("int").alias("percent"))


def kpi_rows(students: DataFrame, detected: DataFrame) -> DataFrame:
    """(class_id, place, label, value): average, pass and fail percent, students, marks, and the three mastery lines."""
    both = overall(students, detected).join(mastery(students, detected), "class_id")
    percent = lambda c: F.format_string("%d%%", F.floor(F.col(c) * 100 + 0.5).cast("long"))
    line = lambda c: F.format_string("%d%% — %d/%d", F.col(f"{c}_pct"), F.col(c), F.col("n_students"))
    rows = (("average", two_places(F.col("overall_average"))), ("pass", percent("pass_rate")), ("fail", percent("fail_rate")), ("students", F.col("n_students").cast("string")), ("marks", F.col("total_marks").cast("string")), *((c, line(c)) for c in ("mastered", "in_progress", "not_mastered")))
    return both.select("class_id", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("label"), value.alias("value")) for k, (name, value) in enumerate(rows)])).alias("r")).select("class_id", "r.*")
