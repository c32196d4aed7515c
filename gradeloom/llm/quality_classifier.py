"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (UTF-16 units, lower-cased), four at a time: a
64-bit key holds a 4-gram exactly, its context is the key without the last unit,
and the gram one order lower is the key without the first. It is trained on all
trusted texts. Counts, discounts and probabilities are joins and groupings of small tables.

Scoring is a count join: texts are dealt to blocks, each block names its
distinct 4-grams, the distinct 4-grams of all blocks join the model's tables
order by order (backing off where a gram or a context is unknown), and every
block gets its grams' probabilities back next to its texts. Blocks are dealt by
a hash of the id, so no source or language weighs on one of them, and the texts
are shuffled once.

A text is kept if its perplexity is at most its language's threshold: a high
quantile of the perplexities of that language's trusted texts, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BITS, cut, id_filter

ORDER = 4
BLOCK_CHARS = 16_000_000
QUANTILE = 0.999
MARGIN = 1.1
START = 1  # unit before a text's first
UNITS = 1 << 16


def units(text: str | None) -> np.ndarray:
    """UTF-16 units of the lower-cased text after three START units."""
    body = np.frombuffer((text or "").lower().encode("utf-16-le", "surrogatepass"), dtype="<u2")
    return np.concatenate([np.full(ORDER - 1, START, np.uint16), body])


def grams(text: str | None) -> np.ndarray:
    """A key for each unit of the text, with the three units before it."""
    u = units(text).astype(np.int64)
    n = len(u) - ORDER + 1
    key = np.zeros(n, dtype=np.int64)
    for k in range(ORDER):
        key = (key << 16) | u[k : k + n]
    return key


def _counts(texts: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                keys, n = np.unique(np.concatenate([grams(t.as_py()) for t in batch.column(0)[at : at + 1000]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.select("text").mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counted: DataFrame) -> tuple[float, float, float]:
    row = counted.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = row
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def _tail(key: Column, order: int) -> Column:
    """The last ``order`` units of a key."""
    return key.bitwiseAND(F.lit((1 << (16 * order)) - 1)) if order < 4 else key


def train(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to 4 two tables: (gram, p) of seen grams and (context, left) of seen contexts, left being the lower order's weight."""
    counted = {ORDER: cut(_counts(texts), "quality-grams")}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer grams one ends
        counted[order] = cut(counted[order + 1].groupBy(_tail(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n")), "quality-grams")
    tables: list[tuple[DataFrame, DataFrame]] = []
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counted[order])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        grams_of = counted[order].select("gram", "n", F.shiftrightunsigned("gram", 16).alias("context"), off.alias("off"))
        contexts = cut(grams_of.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("off")).select("context", "total", (F.col("off") / F.col("total")).alias("left")), "quality-contexts")
        known = grams_of.join(contexts, "context")
        own = (F.col("n") - F.col("off")) / F.col("total")
        if order == 1:
            seen = known.select("gram", (own + F.col("left") / UNITS).alias("p"))
        else:
            lower = tables[-1][0].select(F.col("gram").alias("tail"), F.col("p").alias("lower"))
            seen = known.withColumn("tail", _tail(F.col("gram"), order - 1)).join(lower, "tail").select("gram", (own + F.col("left") * F.col("lower")).alias("p"))
        tables.append((cut(seen, "quality-model"), contexts.select("context", "left")))
    return tables


def probabilities(keys: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, logp) of distinct 4-gram ``keys`` (gram): natural logarithms, by joins with each order's tables."""
    p = None
    out = keys
    for order in range(1, ORDER + 1):
        seen, contexts = model[order - 1]
        out = out.withColumn("k", _tail(F.col("gram"), order))
        out = out.join(seen.select(F.col("gram").alias("k"), F.col("p").alias("own")), "k", "left")
        out = out.withColumn("c", F.shiftrightunsigned("k", 16)).join(contexts.select(F.col("context").alias("c"), "left"), "c", "left")
        lower = F.lit(1.0 / UNITS) if p is None else F.col("p")
        out = out.withColumn("p", F.coalesce("own", F.coalesce("left", F.lit(1.0)) * lower)).select("gram", "p")
        p = "p"
    return out.select("gram", F.ln("p").alias("logp"))


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], blocks: int | None = None) -> DataFrame:
    """(doc_id, lang, units, perplexity) per row of ``docs`` (doc_id, text, lang); perplexity is per unit, 1 for an empty text."""
    if blocks is None:
        chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
        blocks = max(1, -(-chars // BLOCK_CHARS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))
    dealt = docs.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), "doc_id", "text", F.col("lang").cast("string").alias("lang")).repartitionById(blocks, "block")

    def name(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        distinct, held, size = np.empty(0, np.int64), [], 0
        for text in group["text"]:
            held.append(grams(text))
            size += len(held[-1])
            if size > 2_000_000:
                distinct, held, size = np.unique(np.concatenate([distinct, *held])), [], 0
        return pd.DataFrame({"block": key[0], "gram": np.unique(np.concatenate([distinct, *held]))})

    named = dealt.groupBy("block").applyInPandas(name, "block int, gram long")
    known = probabilities(named.select("gram").distinct(), model)
    back = named.join(known, "gram").select("block", "gram", "logp")

    def score(key: tuple, texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        stored = table["gram"].to_numpy()
        order = np.argsort(stored)
        stored, logp = stored[order], table["logp"].to_numpy()[order]
        total, length = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts["text"]):
            found = grams(text)
            length[k] = len(found)
            if len(found):
                total[k] = logp[np.searchsorted(stored, found)].sum()
        return pd.DataFrame({"doc_id": texts["doc_id"], "lang": texts["lang"], "units": length, "perplexity": np.exp(-total / np.maximum(length, 1))})

    return dealt.groupBy("block").cogroup(back.repartitionById(blocks, "block").groupBy("block")).applyInPandas(score, f"doc_id {kind}, lang string, units long, perplexity double")


def trusted_texts(docs: DataFrame, labels: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The texts of all trusted documents (label quality 1), without a shuffle of texts.

    A filter of two bytes a trusted id is broadcast. The ids of the few other documents
    that pass it are found by a join of ids alone and written; Spark
    broadcasts them while they are measured small, to leave their texts out.
    """
    own = F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id")  # hashes differ by type
    good = cut(labels.where("quality = 1").select(own).where("doc_id is not null").distinct(), "quality-trusted")
    passes = id_filter(good, most_bits)
    others = cut(docs.select("doc_id").where("doc_id is not null").where(passes).join(good, "doc_id", "left_anti").distinct(), "quality-others")
    return docs.select("doc_id", "text").where("doc_id is not null").where(passes).join(others, "doc_id", "left_anti")


def trusted_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int = 5) -> DataFrame:
    """For models of bounded cost, which ``judge`` doesn't use: texts of about ``rows`` trusted documents (label quality 1), seeded; their ids, at most a few more than ``rows``, are broadcast."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    total = good.count()
    share = round(1_000_000 * min(1.0, rows / total)) if total else 0
    chosen = good.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, units, perplexity, threshold, kept) per row of ``docs`` (doc_id, text, lang).

    A language's threshold is ``margin`` times the ``quantile`` of perplexity over
    its trusted documents; a language without any (or a null one) takes that of
    all. Null and empty texts have perplexity 1 and aren't kept. Without trusted
    text nothing is known: every text has the perplexity of a uniform choice and
    no threshold, and is kept unless it is empty. Repeated rows are judged each;
    an empty table gives no rows; other columns are ignored.
    """
    scored = cut(perplexities(docs, train(trusted_texts(docs, labels))), "quality-scores")
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = scored.where("units > 0").join(good, "doc_id", "left_semi")
    by_lang = trusted.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, F.lit(100_000)).alias("limit"))
    overall = trusted.agg(F.percentile_approx("perplexity", quantile, F.lit(100_000)).alias("limit")).first()["limit"]
    limits = cut(by_lang.where("lang is not null"), "quality-limits")  # written, so its few rows are known to be few
    judged = scored.join(limits, "lang", "left").withColumn("threshold", margin * F.coalesce("limit", F.lit(overall).cast("double")))
    kept = (F.col("units") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "units", "perplexity", "threshold", kept.alias("kept"))
