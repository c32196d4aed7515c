"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: bit i is set when it is set in more than half
of the 64-bit hashes of the text's word shingles. Two texts link when their
fingerprints differ in at most three bits.

Finding links. The perfect binary Golay code has 4096 codewords of 23 bits, and
each 23-bit vector lies within three bits of exactly one of them. The
fingerprint is cut into three segments of 22, 21 and 21 bits. Three errors over
three segments leave two segments with at most one error each, so it is enough
to look at pairs of segments, each with at most one error. For a segment,
``near(v)`` is the codeword v decodes to and ``around(v)`` all codewords within
four bits of v (one, or six when v is three bits off its codeword). If u and v
differ in at most one bit then near(u) is in around(v), and near(v) in
around(u). So for a pair of segments (i, j) a fingerprint stands on the left
under near(u_i) x around(u_j) and on the right under around(u_i) x near(u_j):
12 keys at most on each side, and any two fingerprints within three bits meet
for some pair. The join on (pair, key) verifies the true distance, so results
are exact. Only distinct fingerprints are joined: copies never multiply.

The pipeline's groups by shingle similarity (``similar_groups``) go through these
fingerprints and links first: what they join is checked against the whole shingle
sets, and texts that it joins are compared no more. SimHash always misses some
pairs, so an exact search follows among the texts that are still apart. Shingle
sets are larger than their texts, so they are never stored for all: pairs that
sizes and parity bits don't rule out have theirs made from the documents again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import MOST_BITS, connected_components, cut, drop_cut, filter_size, id_filter, marked_bits

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the Golay code's generator polynomial


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codeword index of each 23-bit vector, syndrome of each, errors to the codewords within four bits of each syndrome).

    Built from the generator polynomial: a vector's syndrome is its remainder;
    each of the 2048 syndromes has one error of at most three bits. The third
    table has a row per syndrome with up to six error patterns, padded with the
    first.
    """
    vectors = np.arange(1 << 23, dtype=np.uint32)
    rest = vectors.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> np.uint32(bit) & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    rest = rest.astype(np.uint16)
    weight = np.bitwise_count(vectors)
    errors = np.zeros((2048, 6), dtype=np.uint32)
    few = vectors[weight <= 3]
    leader = np.zeros(2048, dtype=np.uint32)
    leader[rest[few]] = few
    errors[:] = leader[:, None]
    four = vectors[weight == 4]
    order = np.argsort(rest[four], kind="stable")
    heads = rest[four][order]
    starts = np.searchsorted(heads, np.arange(2048))
    place = np.arange(len(heads)) - starts[heads]
    own = np.bitwise_count(leader[heads]) == 3  # only then are there codewords four bits away
    errors[heads[own], place[own] + 1] = four[order][own]
    return (vectors >> np.uint32(11)).astype(np.uint16), rest, errors


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), 0
    hashes = np.fromiter((digest(p, seed) for p in parts), dtype="<u8")
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = hashes[at : at + (1 << 16)]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) per row of ``docs``; fp is the fingerprint's bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, fp long")


def keyed(prints: DataFrame) -> DataFrame:
    """(side, key, fp): the Golay keys of each fingerprint, 24 bits of codeword indices and the pair of segments."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rest, errors = golay_tables()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 20_000):
                fp = whole[at : at + 20_000]
                near, around = [], []
                for first, bits in SEGMENTS:
                    v = (fp >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.uint32)
                    e = errors[rest[v]]
                    near.append(index[v ^ e[:, 0]].astype(np.int64))
                    around.append(index[v[:, None] ^ e].astype(np.int64))
                for p, (i, j) in enumerate(PAIRS):
                    for side, one, many, at_one, at_many in ((0, near[i], around[j], 12, 0), (1, near[j], around[i], 0, 12)):
                        key = (p << 24) + (one[:, None] << at_one) + (many << at_many)
                        # columns after the first that repeat it are padding
                        real = np.ones(key.shape, dtype=bool)
                        real[:, 1:] = many[:, 1:] != many[:, :1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(real.sum()), side, np.int8)), pa.array(key[real].astype(np.int32)), pa.array(np.repeat(fp.view(np.int64), real.sum(1)))], names=["side", "key", "fp"])
        golay_tables.cache_clear()  # the worker's memory is free for what comes next

    return prints.select("fp").mapInArrow(scan, "side byte, key int, fp long")


def links(keys: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``max_bits`` (up to 3) bits apart, by their ``keyed`` keys; a pair may repeat."""
    left = keys.where("side = 0").select("key", F.col("fp").alias("u"))
    right = keys.where("side = 1").select("key", F.col("fp").alias("v"))
    near = left.join(right, "key").where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
    return near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included.
    Null, empty or wordless texts have fingerprint zero and link like any other.
    Rows with a null doc_id link too but never name a component: theirs is null
    if no other row is in it. Repeated rows come out as often as they came in.
    An empty table gives no rows; other columns are ignored.
    """
    return grouped_prints(cut(fingerprints(docs, shingle, seed), "simhash-prints"), max_bits)


def grouped_prints(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``near_duplicates`` of documents whose fingerprints are known: written ``prints`` (doc_id, fp)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments of three hold at most one error each only up to three errors")
    keys = cut(keyed(prints.select("fp").distinct()), "simhash-keys")
    groups = connected_components(links(keys, max_bits), "simhash-links")
    drop_cut(keys)
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = smallest.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = grouped.select("fp", "component").join(named, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SKETCH = 128  # hashes of a sketch (the groups below compare whole sets)


def jaccard(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Similarity of two texts from their sketches: among the smallest hashes of the union, the share that both have."""
    union = np.union1d(a, b)[:size]
    return float(np.isin(union, np.intersect1d(a, b)).mean()) if len(union) else 1.0


def shingle_hashes(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles (fewer words: the whole sequence; none: empty), sorted."""
    if len(words) < shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p) for p in parts), dtype="<u8"))


def alike(a: np.ndarray, b: np.ndarray, bound: Fraction) -> bool:
    """Whether the Jaccard similarity of two sets of distinct hashes is at least ``bound``; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * bound.denominator >= bound.numerator * (len(a) + len(b) - both)


def words_and_node(text: str | None) -> tuple[list[bytes], int]:
    """The words of a text and the hash that names its sequence of words, as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    node = xxhash.xxh3_64_intdigest(b" ".join(words))
    return words, node - (1 << 64) if node >> 63 else node


def distinct_texts(column: pa.Array, seen: set[int]) -> Iterator[tuple[int, list[bytes]]]:
    """(node, words) of the texts that are not in ``seen``, which is kept small; later steps bear repeats."""
    for text in column:
        words, node = words_and_node(text.as_py())
        if node not in seen:
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(node)
            yield node, words


FREQUENT = 100_000  # shingles that come last in the order of prefixes
WINDOW = 2_000_000  # shingles counted at once


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles of many texts, sorted by hash.

    Counts leave out what is rare in a window of texts. They decide only in which
    order shingles are looked at: any order gives the same pairs.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(parts), return_counts=True)
            many = n > 1
            return pa.RecordBatch.from_arrays([pa.array(hashes[many].view(np.int64)), pa.array(n[many].astype(np.int64))], names=["hash", "n"])

        parts, held, seen = [], 0, set()
        for batch in batches:
            for _, words in distinct_texts(batch.column(0), seen):
                parts.append(shingle_hashes(words, shingle))
                held += len(parts[-1])
                if held >= WINDOW:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    counts = docs.select("text").mapInArrow(scan, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    hashes, n = (top.column(k).to_numpy() for k in ("hash", "n"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix_keys(docs: DataFrame, bound: Fraction, shingle: int) -> DataFrame:
    """(key, node, place, size): the first shingles of each text, ``size`` of them in all, in one order of all shingles, rare ones first.

    A text of n shingles that is alike another shares at least ceil(bound * n) of
    them, so the two have one among the first n - ceil(bound * n) + 1 of each.
    Rows may repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        seen = set()

        def rows(found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            times = [len(k) for _, _, k in found]
            columns = [np.concatenate([k for _, _, k in found]).view(np.int64), np.repeat(np.array([n for n, _, _ in found], np.int64), times), np.concatenate([np.arange(t, dtype=np.int32) for t in times]), np.repeat(np.array([s for _, s, _ in found], np.int32), times)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "place", "size"])

        for batch in batches:
            found, held = [], 0
            for node, words in distinct_texts(batch.column(0), seen):
                own = shingle_hashes(words, shingle)
                if not len(own):
                    continue
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    own = own[np.lexsort((own, np.where(hashes[at] == own, counts[at], 0)))]
                needed = -(-bound.numerator * len(own) // bound.denominator)
                found.append((node, len(own), own[: len(own) - needed + 1]))
                held += len(found[-1][2])
                if held >= 200_000:
                    yield rows(found)
                    found, held = [], 0
            if found:
                yield rows(found)

    return docs.select("text").mapInArrow(scan, "key long, node long, place int, size int")


def may_be_alike(bound: Fraction):
    """Condition on columns of a key's two texts: true where the key is the first that both have, if they are alike."""
    most = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))  # the key and all after it
    up, low = bound.numerator, bound.denominator
    return most * (up + low) >= up * (F.col("size") + F.col("other_size"))  # both >= bound * (size + other_size - both)


PARITY = tuple(f"parity{k}" for k in range(8))  # 512 bits: whether a text has an odd number of the shingles that fall to a bit


def parities(hashes: np.ndarray) -> np.ndarray:
    """A set's parity bits, as eight signed longs."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def few_differences(bound: Fraction):
    """Condition on two texts' sizes and parities: true if they are alike.

    Each shingle that only one of them has changes one parity bit, so the bits
    that differ are never more than such shingles, of which alike texts have at
    most (1 - bound) / (1 + bound) of both sizes.
    """
    up, low = bound.numerator, bound.denominator
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in PARITY[1:]), F.bit_count(F.col(PARITY[0]).bitwiseXOR(F.col(f"other_{PARITY[0]}"))))
    return bits * (up + low) <= (low - up) * (F.col("size") + F.col("other_size"))


def shared_rows(keyed: DataFrame, heads: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``keyed`` under the keys of ``heads``, and by chance few others: a filter that doesn't move the many rows under keys of one text."""
    size, n = filter_size(heads.count(), most_bits), len(SLICES)
    slices = F.array(*[F.shiftright("key", k).bitwiseAND(F.lit(size - 1)) for k in SLICES])
    shared = keyed.sparkSession.sparkContext.broadcast(marked_bits(heads.select(F.explode(slices).alias("place")), size))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, good = batch.column(0).to_numpy(), np.ones(batch.num_rows, dtype=bool)
            for k in range(n):
                at = key >> SLICES[k] & (size - 1)
                good &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(good))

    return keyed.select("key", "node", "place", "size").mapInArrow(scan, "key long, node long, place int, size int")


SLICES = (0, 18, 36)  # keys are hashes, so bits from these on are three more
BITS = 1 << 24  # of the marks that a driver holds for the texts to read again


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): all shingle hashes of the texts in ``nodes``, and by chance of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(marked_bits(nodes.select(F.pmod("node", F.lit(BITS)).alias("place")), BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = shared.value, set()
        for batch in batches:
            found = []
            for node, words in distinct_texts(batch.column(0), seen):
                at = node % BITS
                if int(marks[at >> 6]) >> (at & 63) & 1:
                    found.append((node, shingle_hashes(words, shingle).tobytes()))
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles"])

    return docs.select("text").mapInArrow(scan, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


class Sets(NamedTuple):
    """What tells the shingle sets of the texts of ``docs``: written ``marks`` (node, size, parity bits) of those with words, and the length of a shingle."""

    docs: DataFrame
    marks: DataFrame
    shingle: int


def verified(pairs: DataFrame, sets: Sets, bound: Fraction) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole shingle sets are alike, written. Sets are made for the pairs alone that sizes and parity bits leave."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x: np.frombuffer(x.as_buffer(), dtype="<u8")
        for batch in batches:
            good = pa.array([alike(read(x), read(y), bound) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    of_b = sets.marks.select(F.col("node").alias("b"), *(F.col(c).alias(f"other_{c}") for c in ("size", *PARITY)))
    near = cut(pairs.join(sets.marks.withColumnRenamed("node", "a"), "a").join(of_b, "b").where(few_differences(bound)).select("a", "b"), "similar-near")
    if near.isEmpty():
        return near
    hashes = cut(shingle_sets(sets.docs, near.select(F.col("a").alias("node")).union(near.select("b")), sets.shingle), "similar-sets")
    left, right = (hashes.select(F.col("node").alias(end), F.col("shingles").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    good = cut(near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "similar-alike")
    drop_cut(hashes)
    return good


def likely_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): each text, by node, under the smallest of its SimHash component, from ``texts`` (node, fp)."""
    prints = cut(texts.select(F.col("node").alias("doc_id"), "fp").distinct(), "similar-prints")
    return cut(grouped_prints(prints).where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "similar-likely")


def alike_pairs(sets: Sets, bound: Fraction, likely: DataFrame) -> DataFrame:
    """(a, b): pairs of texts, by node, that are alike, and enough of them to give the components of all such pairs.

    The ``likely`` pairs (a, b), which have each b once and under an a that is no b, are compared first.
    Then texts that share a prefix key and are still apart are compared with the key's smallest node.
    What these links join is one component however many pairs it has; a second
    text for each key follows, and then every pair under a key that is not yet
    joined is looked at too: those whose places under the key or whose parity
    bits show that they can't be alike end inside the join, the others are
    compared. A key whose texts are mostly not alike takes bit counts of the
    square of their number, and comparisons of few more pairs than are alike.
    """
    keyed = cut(prefix_keys(sets.docs, bound, sets.shingle), "similar-keys")
    heads = cut(keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head"), "similar-heads")
    shared = cut(shared_rows(keyed, heads).join(heads, "key").distinct(), "similar-shared")
    drop_cut(keyed)
    drop_cut(heads)
    likely = verified(likely, sets, bound)
    head_rows = shared.where("node = head").select("key", F.col("place").alias("other_place"), F.col("size").alias("other_size"))
    under_heads = shared.where("node <> head").join(head_rows, "key").where(may_be_alike(bound)).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = cut(not_joined(under_heads, likely), "similar-stars")
    first = likely.unionByName(verified(stars, sets, bound))
    open_rows = cut(apart(shared.drop("head"), first).join(sets.marks.select("node", *PARITY), "node"), "similar-open")
    drop_cut(shared)
    # then one text of each key, another one for each, so that a group that the first heads did not join falls together
    ranked = open_rows.withColumn("rank", F.xxhash64("key", "node"))
    tops = ranked.groupBy("key").agg(F.min("rank").alias("rank"))
    pairs = open_pairs(open_rows, ranked.join(tops, ["key", "rank"]).drop("rank")).where(may_be_alike(bound) & few_differences(bound))
    more = cut(ordered(pairs).join(stars, ["a", "b"], "left_anti"), "similar-more")
    first = first.unionByName(verified(more, sets, bound))
    still_open = cut(apart(open_rows.drop("component"), first), "similar-open")
    drop_cut(open_rows)
    open_rows = still_open
    rest = open_pairs(open_rows, open_rows).where((F.col("node") < F.col("other_node")) & may_be_alike(bound) & few_differences(bound))
    left = ordered(rest).join(stars.unionByName(more), ["a", "b"], "left_anti")
    second = verified(left, sets, bound)
    drop_cut(open_rows)
    return first.unionByName(second)


def not_joined(pairs: DataFrame, likely: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are not in one star of ``likely``."""
    star = lambda end: likely.select(F.col("b").alias(end), F.col("a").alias(f"top_{end}"))
    topped = pairs.join(star("a"), "a", "left").join(star("b"), "b", "left")
    return topped.where(F.coalesce("top_a", "a") != F.coalesce("top_b", "b")).select("a", "b")


def apart(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``shared`` under keys whose texts ``edges`` do not join all, with their component."""
    groups = connected_components(edges, "similar-links")
    joined = shared.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = joined.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    return joined.join(keys, "key")


def open_pairs(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows with the other rows of their key that are in another component."""
    renamed = others.select("key", *(F.col(c).alias(f"other_{c}") for c in ("node", "place", "size", "component", *PARITY)))
    return rows.join(renamed, "key").where(F.col("component") != F.col("other_component"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def grouped_texts(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(doc_id, node, component, component_id) per row of ``docs``."""
    bound = Fraction(str(similarity))
    if not 0 < bound <= 1:
        raise ValueError("texts without a common shingle are never compared")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            nodes, size, bits = [], [], np.zeros((len(texts), len(PARITY)), dtype=np.int64)
            for k, text in enumerate(texts):
                words, node = words_and_node(text)
                own = shingle_hashes(words, shingle)
                nodes.append(node)
                size.append(len(own))
                bits[k] = parities(own)
            prints = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
            columns = [pa.array(nodes, pa.int64()), pa.array(prints.view(np.int64)), pa.array(size, pa.int32()), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(PARITY)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "node", "fp", "size", *PARITY])

    schema = f"doc_id {kind}, node long, fp long, size int, " + ", ".join(f"{c} long" for c in PARITY)
    texts = cut(docs.select("doc_id", "text").mapInArrow(scan, schema), "similar-texts")
    marks = cut(texts.where("size > 0").select("node", "size", *PARITY).dropDuplicates(["node"]), "similar-marks")
    groups = connected_components(alike_pairs(Sets(docs, marks, shingle), bound, likely_pairs(texts)), "similar-links")
    nodes = texts.groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return texts.join(grouped.join(named, "component").select("node", "component", "component_id"), "node").select("doc_id", "node", "component", "component_id")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of texts joined by a shingle similarity of at least ``similarity``.

    The similarity is that of the whole sets of ``shingle``-word shingles, and all
    pairs of at least ``similarity`` are joined. Candidates are the components of
    ``near_duplicates``, by SimHash, and for what is still apart the texts that
    share one of their first shingles in one order (``prefix_keys``), which leaves
    out no such pair. Equal texts are one from the start. component_id is the
    smallest doc_id of a component, null if none has an id.
    """
    return grouped_texts(docs, similarity, shingle).select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each of the ``similar_groups``: that with the smallest doc_id (of repeated ids in a group the one row with the smallest text, and of equal texts that whose columns hash lowest, so reruns agree).

    Rows of one doc_id whose texts are in different groups stand for each of them.
    Rows whose doc_id is null can't be named as one of a group; they stay.
    """
    rows = cut(grouped_texts(docs, similarity, shingle).where("doc_id is not null"), "similar-rows")
    kept = rows.where("doc_id = component_id").select("doc_id", "node", "component").distinct()
    # an id that is one row's alone says whether that row stays; texts are moved for the other ids only
    ids = cut(rows.groupBy("doc_id").agg((F.count("*") == 1).alias("once"), F.bool_and(F.col("doc_id") == F.col("component_id")).alias("stays")), "similar-ids")
    unsure = id_filter(ids.where("not (once and stays)"))
    open_ids = cut(ids.where(unsure).where("stays or not once"), "similar-open-ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [words_and_node(t.as_py())[1] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64())], names=["row", "doc_id", "node"])

    # a row is held whole in one struct, so that no name of its columns meets ours
    # written, as a stage with two Python steps holds two workers a core
    contested = cut(docs.where(F.col("doc_id").isNotNull() & unsure & id_filter(open_ids)), "similar-contested")
    rows = contested.select(F.struct("*").alias("row"), "doc_id", "text")
    schema = StructType([rows.schema["row"], rows.schema["doc_id"], StructField("node", LongType())])
    named = rows.mapInArrow(scan, schema).join(kept, ["doc_id", "node"])
    tie = F.xxhash64(F.to_json(F.struct(*(F.col("row")[c] for c in docs.columns if c != "text"))))
    first = F.row_number().over(Window.partitionBy("component").orderBy("row.text", tie))
    return named.withColumn("place", first).where("place = 1").select("row.*").unionByName(docs.where(F.col("doc_id").isNull() | ~unsure))
