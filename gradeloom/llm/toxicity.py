"""Toxicity classifier regularised by counterfactuals.

A logistic model over a text's distinct words and word beginnings (hashed). In
training, every labelled text that names a group is also seen with its identity
terms swapped for others of the same list, and the squared change of the score's
logit is penalised: the model can't lean on the mere mention of a group, which
is what makes neutral mentions false positives.

Terms come from two places: fixed lists of words that name groups, and the
labelled texts themselves (``mention_lists``): words that toxic texts hold more
often than others although clean texts hold them too, each listed with a word as
common that says nothing. A word of the second kind is what a group's name is in
a corpus whose groups no list knows: its mention alone must not decide.

Training reads a bounded sample of labelled rows (``TRAIN_ROWS``, a parameter);
scoring reads every text whole. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TRAIN_ROWS = 12_000
BUCKETS = 1 << 20
MIN_TEXTS = 6  # training texts a feature must be in
CHI_SQUARE = 15.0  # for one feature's presence against the label
MIN_CLEAN = 5  # clean training texts that a term found in the data must be in
MAX_TERMS = 2_000  # terms found in the data, at most, the most telling first
KNOWN_WORDS = 500_000  # entries of a worker's memory of words, cleared when full; scores don't depend on it
PREFIXES = (4, 5, 6)
TOKEN = re.compile(r"[^\W\d_]{2,}")

# Words that name groups, by list; a swap stays inside a list.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "latino", "arab", "european"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("schwule", "lesben", "heterosexuelle"),
    ("ausländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("inmigrantes", "refugiados", "extranjeros"),
)


def tokens(text: str | None) -> set[str]:
    return set(TOKEN.findall((text or "").lower()))


def buckets(word: str) -> list[int]:
    """Hashed features of a word: itself, and its beginnings if it is long enough."""
    digest = xxhash.xxh32_intdigest
    return [digest("=" + word) % BUCKETS, *(digest("^" + word[:n]) % BUCKETS for n in PREFIXES if len(word) >= n)]


def features(words: set[str]) -> np.ndarray:
    """Hashed features of a text's distinct words, sorted and distinct."""
    return np.array(sorted({b for w in words for b in buckets(w)}), dtype=np.int32)


def swapped(words: set[str], seed: int, lists: Sequence[Sequence[str]] = IDENTITY_TERMS) -> set[str] | None:
    """The words with every identity term replaced by another of its list, or None if there is none."""
    out, found = set(words), False
    for terms in lists:
        for k, term in enumerate(terms):
            if term in words:
                found = True
                out.discard(term)
                out.add(terms[(k + 1 + seed % (len(terms) - 1)) % len(terms)])
    return out if found else None


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one (``where`` is sorted), and how many training texts had a counterfactual."""

    where: np.ndarray
    weights: np.ndarray
    bias: float
    swapped: int = 0

    def score(self, text: str | None, known: dict[str, tuple[int, ...]] | None = None) -> float:
        """0 to 1; ``known`` is a memory of the weights that words' features have."""
        known = {} if known is None else known
        if len(known) > KNOWN_WORDS:
            known.clear()
        place = self.place
        at: set[int] = set()
        for word in tokens(text):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(place[b] for b in buckets(word) if b in place)
            if own:
                at.update(own)
        z = float(self.weights[sorted(at)].sum()) + self.bias if at else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @cached_property
    def place(self) -> dict[int, int]:
        return {b: k for k, b in enumerate(self.where.tolist())}


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int, seed: int = 13) -> DataFrame:
    """(toxic, text) of a seeded sample of about ``rows`` labelled rows; repeated labels of an id count as their maximum."""
    truth = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = truth.count()
    share = min(1.0, rows / total) if total else 1.0
    chosen = truth.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, hits, toxic): in how many of ``texts`` (toxic, text), and of the toxic ones, each word is; only words of MIN_TEXTS texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1)):
                words = tokens(text.as_py())
                hits.update(words)
                if label.as_py():
                    toxic.update(words)
        yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.string()), pa.array(list(hits.values()), pa.int64()), pa.array([toxic[w] for w in hits], pa.int64())], names=["word", "hits", "toxic"])

    return texts.select("toxic", "text").mapInArrow(scan, "word string, hits long, toxic long").groupBy("word").agg(F.sum("hits").alias("hits"), F.sum("toxic").alias("toxic")).where(F.col("hits") >= MIN_TEXTS)


def mention_lists(texts: DataFrame, most: int = MAX_TERMS) -> list[list[str]]:
    """Lists of two words: one that toxic texts hold more often than chance allows although MIN_CLEAN clean ones hold it too, and one as common that is as often in clean texts as any, drawn by hash.

    At most ``most`` lists, the most telling words first; none where the texts
    (toxic, text) have one label only. Both words of a list are in no other.
    """
    sums = texts.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("t")).first()
    n, t = sums["n"], sums["t"] or 0
    if not 0 < t < n:
        return []
    expected = F.col("hits") * t / n
    spread = expected * (1 - t / n) * (1 - F.col("hits") / n)
    z = (F.col("toxic") - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9)))
    scored = cut(word_counts(texts).withColumn("z", z), "toxicity-words")
    mentions = scored.where((F.col("z") >= CHI_SQUARE**0.5) & (F.col("hits") - F.col("toxic") >= MIN_CLEAN)).orderBy(F.desc("z"), "word").limit(most).select("word", "hits").collect()
    plain = scored.where(F.abs("z") < 0.5).orderBy(F.xxhash64("word"), "word").limit(20 * most).select("word", "hits").collect()
    free = sorted((r["hits"], place, r["word"]) for place, r in enumerate(plain))  # of one count by hash, so that partners share no beginning
    lists = []
    for r in mentions:
        if not free:
            break
        at = min(bisect_left(free, (r["hits"], -1)), len(free) - 1)
        lists.append([r["word"], free.pop(at)[2]])
    return lists


def telling_features(texts: DataFrame) -> np.ndarray:
    """Features of at least MIN_TEXTS of ``texts`` (toxic, text) whose presence says something about the label (chi-square of CHI_SQUARE), sorted.

    Counted in Spark: each task sums the features of its texts first. At most
    BUCKETS numbers come to the driver.
    """
    sums = texts.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("t")).first()
    n, t = sums["n"], sums["t"] or 0
    if not 0 < t < n:
        return np.empty(0, np.int32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1)):
                found = features(tokens(text.as_py()))
                hits[found] += 1
                if label.as_py():
                    toxic[found] += 1
        some = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(hits[some]), pa.array(toxic[some])], names=["feature", "hits", "toxic"])

    counts = texts.select("toxic", "text").mapInArrow(scan, "feature int, hits long, toxic long").groupBy("feature").agg(F.sum("hits").alias("hits"), F.sum("toxic").alias("toxic"))
    expected = F.col("hits") * t / n
    spread = expected * (1 - t / n) * (1 - F.col("hits") / n)
    telling = counts.where((F.col("hits") >= MIN_TEXTS) & ((F.col("toxic") - expected) ** 2 >= CHI_SQUARE * F.greatest(spread, F.lit(1e-9))))
    return np.sort(telling.select("feature").toArrow().column("feature").to_numpy()).astype(np.int32)


def labelled_features(texts: DataFrame, lists: Sequence[Sequence[str]], where: np.ndarray, seed: int = 13) -> DataFrame:
    """(toxic, found, swapped, other) of each of ``texts`` (toxic, text): which features of ``where`` it has, whether it has a counterfactual, and which features that has."""
    shared = texts.sparkSession.sparkContext.broadcast(([list(x) for x in lists], where.tolist()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, where = shared.value
        by_term = {term: k for k, terms in enumerate(lists) for term in terms}
        place = {b: k for k, b in enumerate(where)}

        def places(words: set[str] | None) -> list[int]:
            return sorted({place[b] for w in words or () for b in buckets(w) if b in place})

        for batch in batches:
            found, others, has = [], [], []
            for text in batch.column(1):
                words = tokens(text.as_py())
                mine = sorted({by_term[w] for w in words if w in by_term})
                other = swapped(words, seed + len(words), [lists[k] for k in mine])
                found.append(places(words))
                others.append(places(other))
                has.append(other is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(has, pa.bool_()), pa.array(others, pa.list_(pa.int32()))], names=["toxic", "found", "swapped", "other"])

    return texts.select("toxic", "text").mapInArrow(scan, "toxic int, found array<int>, swapped boolean, other array<int>")


def fit(rows: Sequence[tuple[int, Sequence[int], Sequence[int] | None]], where: np.ndarray, counterfactual: float = 1.0, l1: float = 5e-6, rounds: int = 500) -> Model:
    """Logistic regression plus ``counterfactual`` times the squared logit change of each swapped text, by proximal AdaGrad.

    Rows are (label, features, features of the counterfactual or None), features
    as places in ``where``. Both labels count the same in total. No rows, one
    label only or no features give a model of the base rate alone.
    """
    n = len(rows)
    labels = np.array([r[0] for r in rows], dtype=np.float64)
    positive = float(labels.sum())
    pairs = [(r[1], r[2]) for r in rows if r[2] is not None]
    if not 0 < positive < n or not len(where):
        return Model(np.empty(0, np.int32), np.empty(0), float(np.log((positive + 0.5) / (n - positive + 9.5))), len(pairs))

    def flat(lists: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], dtype=np.int64)

    row, column = flat([r[1] for r in rows])
    sides = [flat([p[side] for p in pairs]) for side in (0, 1)]
    swap_row, swap_column = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
    swap_sign = np.repeat([1.0, -1.0], [len(s[0]) for s in sides])

    weights, bias = np.zeros(len(where)), 0.0
    square, bias_square = np.full(len(where), 1e-6), 1e-6
    share = np.where(labels > 0, 0.5 / positive, 0.5 / (n - positive))
    for _ in range(rounds):
        z = np.bincount(row, weights=weights[column], minlength=n) + bias
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        gradient = np.bincount(column, weights=error[row], minlength=len(where))
        if pairs:
            change = np.bincount(swap_row, weights=swap_sign * weights[swap_column], minlength=len(pairs))
            gradient += 2 * counterfactual / n * np.bincount(swap_column, weights=swap_sign * change[swap_row], minlength=len(where))
        square += gradient**2
        pace = 0.4 / np.sqrt(square)
        moved = weights - pace * gradient
        weights = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0)
        bias_square += float(error.sum()) ** 2
        bias -= 0.4 / np.sqrt(bias_square) * float(error.sum())
    some = weights != 0
    return Model(where[some], weights[some], bias, len(pairs))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, counterfactual: float = 1.0, lists: Sequence[Sequence[str]] = IDENTITY_TERMS, discover: int = MAX_TERMS) -> Model:
    """A model from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    Of at most about ``rows`` rows the telling features come to the driver, and
    at most ``discover`` terms found in the texts, stated bounds. Repeated labels
    of an id count as their maximum; null labels are left out. Warns where no
    labelled text holds a term, as the counterfactuals then do nothing.
    """
    texts = cut(labelled_texts(docs, labels, rows), "toxicity-texts")
    given = {w for terms in lists for w in terms}
    found = [x for x in mention_lists(texts, discover) if not given.intersection(x)] if discover else []
    where = telling_features(texts)
    got = labelled_features(texts, [*lists, *found], where).collect()
    data = sorted((int(r["toxic"] > 0), r["found"], r["swapped"], r["other"]) for r in got)
    model = fit([(y, f, o if has else None) for y, f, has, o in data], where, counterfactual)
    if data and not model.swapped:
        warnings.warn("no labelled text holds a term to swap: counterfactuals have no effect", stacklevel=2)
    return model


def scorer(model: Model):
    """A column function: the score, 0 to 1, of a text column; null and empty texts have the score of no features."""
    known: dict[str, tuple[int, ...]] = {}

    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py(), known) for t in texts], pa.float64())

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "double")


def judge(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, counterfactual: float = 1.0, lists: Sequence[Sequence[str]] = IDENTITY_TERMS, discover: int = MAX_TERMS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text); labels of held-out rows aren't read.

    held_out is crc32 of the id's decimal text modulo 5 being 0 (null id: held
    out). Null, empty and wordless texts get the score of a text without
    features. Repeated rows are scored each; an empty table gives no rows; other
    columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    model = train(docs, labels.where(~held), rows, counterfactual, lists, discover)
    score = scorer(model)
    return docs.select("doc_id", held.alias("held_out"), score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, all columns as they are; learns from every labelled row of ``docs``."""
    return docs.where(scorer(train(docs, labels, rows))(docs["text"]) < 0.5)
