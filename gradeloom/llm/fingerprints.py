"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Each paragraph is hashed to 128 bits and those to a wide vector of 1024 lanes of
+1 or -1; a text's fingerprint is the sum of its paragraphs' vectors, lane by
lane modulo 2^32, with the number of paragraphs modulo 2^32 as one more lane.
Equal multisets of paragraphs have equal fingerprints in any order, and a
paragraph is inserted or deleted by adding or subtracting its vector
(``combine``). The squared length of the difference of two fingerprints, taken
modulo 2^32 first, estimates how many paragraphs differ, which gives a likeness
of texts from their fingerprints alone; it holds while a lane stays below 2^31.

A paragraph is a run of words up to the end of a line or sentence, of at most
``SPAN`` words; the paragraphs of a text joined are the text, so texts that
differ in anything but the order of paragraphs have other fingerprints.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 1024
SPAN = 5
PARAGRAPH = re.compile(rf"(?:[^\s.!?]+[^\S\n]*){{1,{SPAN}}}[.!?]*\s*|[.!?]+\s*|\s+")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # splitmix64's multipliers
BLOCK = 4096
RANGE_BYTES = 16 << 20  # of text in a range of ids, about
MAX_RANGES = 100_000


def paragraphs(text: str) -> list[str]:
    return PARAGRAPH.findall(text)


def vector_sum(parts: list[str]) -> np.ndarray:
    """Sum of the parts' vectors and their number: LANES + 1 lanes of int32, wrapping modulo 2^32."""
    total = np.zeros(LANES + 1, dtype=np.int64)
    digest = xxhash.xxh3_128_digest
    turn = np.arange(1, LANES // 64 + 1, dtype=np.uint64)[None, :]
    for at in range(0, len(parts), BLOCK):
        some = parts[at : at + BLOCK]
        seeds = np.frombuffer(b"".join([digest(p.encode("utf-8", "surrogatepass")) for p in some]), dtype="<u8").reshape(-1, 2)
        z = seeds[:, :1] + turn * (seeds[:, 1:] | np.uint64(1))  # a sequence of its own for each 128 bits
        z = (z ^ (z >> np.uint64(30))) * MIX[0]
        z = (z ^ (z >> np.uint64(27))) * MIX[1]
        z ^= z >> np.uint64(31)
        ones = np.unpackbits(z.view(np.uint8), axis=1).sum(0, dtype=np.uint16)  # at most BLOCK
        total[:LANES] += 2 * ones.astype(np.int64) - len(some)
        total[LANES] += len(some)
    return total.astype(np.int32)


def fingerprint(text: str | None) -> np.ndarray:
    return vector_sum(paragraphs(text or ""))


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprint of the union (sign 1) of two texts' paragraphs, or of the first without the second's (sign -1)."""
    return a + b if sign > 0 else a - b


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of paragraphs in common, 0 to 1, estimated from fingerprints: 1 if they are equal."""
    if np.array_equal(a, b):
        return 1.0
    gap = (a - b)[:LANES].astype(np.float64)  # modulo 2^32, then centred
    x, y = a[:LANES].astype(np.float64), b[:LANES].astype(np.float64)
    whole = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1.0 - float(gap @ gap) / whole)) if whole else 0.0


def edited(text: str, other: str) -> str:
    """``text`` with its last half of code points replaced by the first as many (or all) of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, place, doc_id, text): every row in its range of ids (place 0) and, at each range's end, a copy of the next range's first row (place 1).

    Ranges are in descending order of doc_id, null last; the last range is
    followed by the first row of all. Texts are shuffled once, by range, one
    range a partition. There is a range for each RANGE_BYTES of text, at most
    MAX_RANGES; their bounds come from an approximate percentile of the ids, and
    only bounds and each range's first id reach the driver and, as a broadcast
    table, the tasks.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if buckets is None:
        bytes_ = plain.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
        buckets = min(MAX_RANGES, max(1, -(-bytes_ // RANGE_BYTES)))
    at = [k / buckets for k in range(1, buckets)]
    bounds = plain.agg(F.percentile_approx("doc_id", at or [0.5], F.lit(max(10_000, 10 * buckets))).alias("b")).first()["b"] or []
    splits = [-float("inf"), *sorted({float(b) for b in bounds} or {0.0}), float("inf")]
    number = F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf")))  # descending, null last
    cuts = [-s for s in reversed(splits)]
    ranged = Bucketizer(splits=cuts, inputCol="__number", outputCol="__range").transform(plain.withColumn("__number", number))
    ranged = ranged.select(F.col("__range").cast("int").alias("bucket"), "doc_id", "text")
    heads = sorted((r["bucket"], r["head"]) for r in ranged.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return ranged.select("bucket", F.lit(0).alias("place"), "doc_id", "text")
    # partitions are numbered by their ranges that have rows; a range's head again follows the range before it, the first head the last range
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = spark.createDataFrame([(bucket, head, k, (k - 1) % len(heads)) for k, (bucket, head) in enumerate(heads)], f"bucket int, head {kind}, own int, before int")
    named = ranged.join(F.broadcast(known), "bucket")
    again = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("place")))
    dealt = named.select(F.explode(F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("place")), again))).alias("p"), "doc_id", "text").select("p.bucket", "p.place", "doc_id", "text")
    return dealt.repartitionById(len(heads), "bucket").sortWithinPartitions("bucket", "place", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (lanes of 32 bits, little-endian), near_edited, near_next.

    The next document is that with the next smaller doc_id; after the smallest
    comes the largest. Null texts count as empty, and the empty text's
    fingerprint is zero. Rows with equal or null ids follow each other by text;
    a table of one row is its own next. An empty table gives no rows; other
    columns are ignored. Memory holds a batch of rows at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, doc_id, text, fingerprint of a row that waits for its next
        for batch in batches:
            out: list[tuple] = []
            for bucket, place, doc_id, text in zip(*(batch.column(k) for k in range(4))):
                bucket, place, doc_id, text = bucket.as_py(), place.as_py(), doc_id.as_py(), text.as_py()
                if place and held is None:
                    continue  # further copies of a repeated id
                mark = fingerprint(text)
                if held is not None:
                    if held[0] != bucket:
                        raise RuntimeError("a range of ids has no following row")
                    changed = edited(held[2], text)
                    other = fingerprint(changed)
                    out.append((held[1], len(held[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), held[3].astype("<i4").tobytes(), other.astype("<i4").tobytes(), likeness(held[3], other), likeness(held[3], mark)))
                held = None if place else (bucket, doc_id, text, mark)
            columns = list(zip(*out)) or [[] for _ in names]
            types = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if held is not None:
            raise RuntimeError("a range of ids has no following row")

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return with_next(docs, buckets).mapInArrow(scan, schema)


def digests(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``fingerprint_pairs`` with each fingerprint named by a 128-bit digest of its lanes."""
    short = lambda c: F.substring(F.sha2(F.col(c), 256), 1, 32).alias(c)
    return fingerprint_pairs(docs, buckets).select("doc_id", "n_chars", "edited_sha256", short("fingerprint"), short("edited_fingerprint"), "near_edited", "near_next")
