"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Tokens are words, then one end a text; a text's first word follows a start
mark. Words are 64-bit hashes. Counting goes in three shuffles of packed arrays
(one row per task and shard, not per bigram), each combined map-side first:

1. (context, word) -> count, by shards of the context. A context with more than
   its share of all tokens is spread over all shards by word. There is a shard
   for each SHARD_BYTES of text.
2. word -> number of distinct contexts (the continuation counts), by word.
3. word -> plain count, by word.

Each shard's task writes sorted arrays to the shared folder, a file for each kind:
bigram keys with counts, context keys with their mass left for the lower order,
word keys with count and probability. Workers map those files, at most MAPS at a
time and without an open file for any, and search them with sorted queries, a
shard after the other; files are written under a temporary name and renamed, so repeated
tasks do no harm. Nothing is pruned.

p(w | h) = (c(h w) - D(c)) / c(h) + left(h) p(w), where left(h) is the mass of
all discounts at h; p(w) is the same over continuation counts, interpolated
with the uniform 1 / (V + 1), the share of an unknown word.
"""

from __future__ import annotations

import json
import mmap
import os
import shutil
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh_folder, local_path

START, END = np.uint64(1), np.uint64(2)
ODD = np.uint64(0x9E3779B97F4A7C15)  # splitmix64's increment and multiplier
MUL = np.uint64(0xBF58476D1CE4E5B9)
COMBINE_TOKENS = 4_000_000  # tokens that a task holds before it combines them
SHARD_BYTES = 64_000_000  # of text, about eleven million tokens
HOT_WORDS = 65_536  # spread contexts, at most


def word_ids(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the text's words, A-Z lower-cased, then END."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found = list(map(known.get, words))
    if None in found:
        if len(known) > 1_000_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w) | 4  # never START or END
        found = [known[w] for w in words]
    found.append(2)
    return np.array(found, dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a * ODD) ^ (b * MUL)
    z = (z ^ (z >> np.uint64(29))) * MUL
    return z ^ (z >> np.uint64(32))


def combined(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def pairs_combined(context: np.ndarray, word: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) with their summed counts, sorted by context."""
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    if not len(context):
        return context, word, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
    total = np.diff(np.append(first, len(context))) if count is None else np.add.reduceat(count[order], first)
    return context[first], word[first], total


def pack_counts(count: np.ndarray) -> bytes:
    """Counts as bytes; those above 254 follow as 64-bit numbers."""
    small = np.minimum(count, 255).astype(np.uint8)
    return small.tobytes() + count[small == 255].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    count = np.frombuffer(data, np.uint8, n).astype(np.int64)
    count[count == 255] = np.frombuffer(data, "<i8", offset=n)
    return count


def pack_pairs(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Pairs sorted by context: each context once with the length of its run."""
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    return context[first].tobytes(), pack_counts(np.diff(np.append(first, len(context)))), word.tobytes(), pack_counts(count)


def unpack_pairs(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts = np.frombuffer(row[0], np.uint64)
    word = np.frombuffer(row[2], np.uint64)
    return np.repeat(contexts, unpack_counts(row[1], len(contexts))), word, unpack_counts(row[3], len(word))


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from how many entries have counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    folder: str
    shards: int
    tokens: int
    types: int
    pairs: int
    discount: np.ndarray
    lower_discount: np.ndarray
    lower_left: float
    hot: np.ndarray = field(repr=False)  # spread contexts, sorted: at most 4 per shard and HOT_WORDS
    hot_count: np.ndarray = field(repr=False)
    hot_kinds: np.ndarray = field(repr=False)  # per hot context: followers seen once, twice, more often


def _store(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file, whole: under a name of this attempt, then renamed. A line of JSON, then the arrays, each at a multiple of 64 bytes."""
    head, at = {}, 0
    for key, array in arrays.items():
        head[key] = (array.dtype.str, array.shape, at)
        at += -(-array.nbytes // 64) * 64
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 64) + b"\n"

    def write(f) -> None:
        f.write(line)
        for array in arrays.values():
            f.write(np.ascontiguousarray(array).tobytes() + bytes(-array.nbytes % 64))

    target = f"{folder}/{name}"
    if (path := local_path(target)) is not None:
        part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(part, "wb") as f:
            write(f)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(target)
    part = f"{path}.{os.urandom(6).hex()}"
    with store.open_output_stream(part) as f:
        write(f)
    store.move(part, path)


def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """A file of arrays, memory-mapped where the shared folder is a mounted path, else from an unnamed local copy. The map holds no file open."""
    target = f"{folder}/{name}"
    if (path := local_path(target)) is not None:
        f = open(path, "rb")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(target)
        f = tempfile.TemporaryFile()
        with store.open_input_stream(path) as given:
            shutil.copyfileobj(given, f)
        f.flush()
    with f:
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    end = whole.find(b"\n") + 1
    return {key: np.frombuffer(whole, np.dtype(kind), int(np.prod(shape)), end + at).reshape(shape) for key, (kind, shape, at) in json.loads(whole[:end]).items()}


def _word_rows(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, words, counts): packed plain counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys, counts = combined(np.concatenate(held))
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order], shard[order]
            edges = np.searchsorted(shard, np.arange(shards + 1))
            parts = [(s, keys[a:b].tobytes(), pack_counts(counts[a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.binary(), pa.binary()))], names=["shard", "words", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(word_ids(text.as_py(), known))
                size += len(held[-1])
                if size >= COMBINE_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(scan, "shard int, words binary, counts binary")


def _pair_rows(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """(shard, contexts, runs, words, counts): packed bigram counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        size = 0

        def flush():
            context = np.concatenate([np.concatenate([[START], x[:-1]]) for x in held])
            context, word, count = pairs_combined(context, np.concatenate(held))
            shard = shard_of(context, word, shards, hot)
            order = np.argsort(shard, kind="stable")
            context, word, count, shard = context[order], word[order], count[order], shard[order]
            edges = np.searchsorted(shard, np.arange(shards + 1))
            parts = [(s, *pack_pairs(context[a:b], word[a:b], count[a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), *[pa.binary()] * 4))], names=["shard", "contexts", "runs", "words", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(word_ids(text.as_py(), known))
                size += len(held[-1])
                if size >= COMBINE_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(scan, "shard int, contexts binary, runs binary, words binary, counts binary")


def shard_of(context: np.ndarray, word: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """By the context, or by the word where the context is hot."""
    by = context
    if len(hot):
        by = np.where(np.isin(context, hot), word, context)
    return (mix(by, by) % np.uint64(shards)).astype(np.int64)


def count(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` (text) and store a model of them in the shared folder."""
    spark = docs.sparkSession
    folder = fresh_folder(spark, "lm")
    if (path := local_path(folder)) is not None:
        os.makedirs(path, exist_ok=True)
    bytes_ = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // SHARD_BYTES))

    # plain counts of words, still packed
    words = cut(_word_rows(docs, shards), "lm-words")

    def tally(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in group["words"]])
        counts = np.concatenate([unpack_counts(c, len(b) // 8) for b, c in zip(group["words"], group["counts"])])
        keys, counts = combined(keys, counts)
        top = np.argsort(-counts, kind="stable")[:64]  # of a shard's words these may be hot; which ones are changes no score
        return pd.DataFrame({"shard": [key[0]], "words": [keys.tobytes()], "counts": [pack_counts(counts)], "types": [len(keys)], "tokens": [int(counts.sum())], "ends": [int(counts[keys == END].sum())], "top": [keys[top].view(np.int64)], "top_counts": [counts[top].astype(np.int64)]})

    tallied = cut(words.repartitionById(shards, "shard").groupBy("shard").applyInPandas(tally, "shard int, words binary, counts binary, types long, tokens long, ends long, top array<long>, top_counts array<long>"), "lm-tally")
    drop_cut(words)
    sums = tallied.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.sum("ends").alias("ends")).first()
    tokens, types, texts = sums["tokens"] or 0, sums["types"] or 0, sums["ends"] or 0
    limit = max(1, tokens // (4 * shards), tokens // HOT_WORDS)
    often = tallied.select(F.inline(F.arrays_zip("top", "top_counts"))).where(F.col("top_counts") > limit).collect()  # a word is in one shard
    spread = {r["top"] % (1 << 64): r["top_counts"] for r in often} | ({int(START): texts} if texts > limit else {})
    spread.pop(int(END), None)  # nothing follows an end
    hot = np.array(sorted(spread), dtype=np.uint64)
    hot_count = np.array([spread[k] for k in hot.tolist()], dtype=np.int64)

    def store_pairs(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        some = [unpack_pairs(r) for r in group[["contexts", "runs", "words", "counts"]].itertuples(index=False)]
        context, word, total = pairs_combined(*(np.concatenate(x) for x in zip(*some)))
        name = f"{key[0]:06d}"
        pair = mix(context, word)
        order = np.argsort(pair)
        _store(folder, f"pair-{name}", {"keys": pair[order], "count": total[order].astype(np.uint32 if total.max(initial=0) < 2**32 else np.uint64)})
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        kinds = [np.add.reduceat((total == k) if k < 3 else (total >= 3), first, dtype=np.int64) for k in (1, 2, 3)]
        sizes = np.add.reduceat(total, first)
        where = np.isin(context[first], hot)
        _store(folder, f"context-{name}", {"keys": context[first][~where], "count": sizes[~where].astype(np.int64), "kinds": np.stack(kinds, 1)[~where].astype(np.uint32)})
        once = combined(word)
        by = (once[0] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(by, kind="stable")
        edges = np.searchsorted(by[order], np.arange(shards + 1))
        rows = [(s, once[0][order][a:b].tobytes(), pack_counts(once[1][order][a:b])) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
        out = pd.DataFrame(rows, columns=["shard", "words", "counts"])
        out["n"] = None
        counts = [int((total == k).sum()) for k in (1, 2, 3, 4)] + [len(total)]
        head = pd.DataFrame({"shard": [-1], "words": [None], "counts": [None], "n": [counts], "hot": [context[first][where].view(np.int64)], **{f"kind{k + 1}": [kinds[k][where]] for k in range(3)}})
        return pd.concat([head, out.assign(hot=None, kind1=None, kind2=None, kind3=None)], ignore_index=True)

    longs = ", ".join(f"{c} array<long>" for c in ("n", "hot", "kind1", "kind2", "kind3"))
    followed = cut(_pair_rows(docs, shards, hot).repartitionById(shards, "shard").groupBy("shard").applyInPandas(store_pairs, f"shard int, words binary, counts binary, {longs}"), "lm-pairs")
    heads = followed.where("shard = -1")
    *n, pairs = (x or 0 for x in heads.agg(*[F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(5)]).first())
    kinds = np.zeros((len(hot), 3), dtype=np.int64)
    for r in heads.select(F.inline(F.arrays_zip("hot", "kind1", "kind2", "kind3"))).groupBy("hot").agg(*[F.sum(f"kind{k}").alias(f"kind{k}") for k in (1, 2, 3)]).collect():  # one row per spread context
        kinds[np.searchsorted(hot, np.uint64(r["hot"] % (1 << 64)))] = r["kind1"], r["kind2"], r["kind3"]
    discount = discounts(n)

    # counts of contexts per word, first for their counts of counts, then stored with the probabilities
    def followers(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in group["words"]])
        return combined(keys, np.concatenate([unpack_counts(c, len(b) // 8) for b, c in zip(group["words"], group["counts"])]))

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = followers(group)
        return pd.DataFrame({"shard": [key[0]], "words": [keys.tobytes()], "counts": [pack_counts(counts)], "n": [[int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum()), int(counts.sum())]]})

    merged = cut(followed.where("shard >= 0").select("shard", "words", "counts").repartitionById(shards, "shard").groupBy("shard").applyInPandas(merge, "shard int, words binary, counts binary, n array<long>"), "lm-followers")
    drop_cut(followed)
    m = merged.agg(*[F.sum(F.get("n", F.lit(k))).alias(f"m{k}") for k in range(6)]).first()
    m = [x or 0 for x in m]
    lower = discounts(m[:4])
    lower_left = float(lower[1] * m[0] + lower[2] * m[1] + lower[3] * m[4]) / max(m[5], 1)

    def store_words(key: tuple, plain: pd.DataFrame, contexts: pd.DataFrame) -> pd.DataFrame:
        if not len(contexts):
            return pd.DataFrame({"words": pd.Series([], dtype="int64")})
        keys, counts = followers(contexts)
        p = (counts - lower[np.minimum(counts, 3)]) / m[5] + lower_left / (types + 1)
        name = f"{int(contexts['shard'].iloc[0]):06d}"
        own, held = followers(plain)
        assert np.array_equal(own, keys)
        _store(folder, f"word-{name}", {"keys": keys, "count": held.astype(np.int64), "p": p.astype(np.float64)})
        return pd.DataFrame({"words": [len(keys)]})

    stored = tallied.select("shard", "words", "counts").groupBy("shard").cogroup(merged.select("shard", "words", "counts").groupBy("shard")).applyInPandas(store_words, "words long")
    cut(stored, "lm-stored")
    drop_cut(tallied)
    drop_cut(merged)
    return Model(folder, shards, tokens, types, pairs, discount, lower, lower_left, hot, hot_count, kinds)


MAPS = 256  # files that a worker keeps mapped


class Lookup:
    """A worker's view of a stored model: mapped files, opened when first asked for, the least recently used given up beyond MAPS."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()

    def arrays(self, kind: str, shard: int) -> dict[str, np.ndarray] | None:
        name = f"{kind}-{shard:06d}"
        if name not in self.open:
            try:
                self.open[name] = _mapped(self.model.folder, name)
            except FileNotFoundError:  # no word or context fell into this shard
                self.open[name] = None
            if len(self.open) > MAPS:
                self.open.popitem(last=False)
        self.open.move_to_end(name)
        return self.open[name]

    def search(self, kind: str, keys: np.ndarray, shard: np.ndarray, fields: tuple[str, ...], shapes: tuple[int, ...] = (1, 1)) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are stored, and their fields (zero elsewhere)."""
        order = np.lexsort((keys, shard))
        found = np.zeros(len(keys), dtype=bool)
        values = [np.zeros((len(keys), w)) for w in shapes[: len(fields)]]
        shards, starts = np.unique(shard[order], return_index=True)
        for s, a, b in zip(shards.tolist(), starts, [*starts[1:], len(order)]):
            held = self.arrays(kind, s)
            if held is None or not len(held["keys"]):
                continue
            stored, rows = held["keys"], order[a:b]
            place = np.minimum(np.searchsorted(stored, keys[rows]), len(stored) - 1)
            same = stored[place] == keys[rows]
            found[rows] = same
            for value, name in zip(values, fields):
                got = held[name][place[same]]
                value[rows[same]] = got[:, None] if got.ndim == 1 else got
        return found, values

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text of word hashes: known tokens, log10 probability by the plain counts with add-half, log10 probability by the model."""
        m = self.model
        word = np.concatenate(texts)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        context = np.concatenate([np.concatenate([[START], x[:-1]]) for x in texts])
        words, at = np.unique(word, return_inverse=True)
        known, (count, p) = self.search("word", words, (words % np.uint64(m.shards)).astype(np.int64), ("count", "p"))
        count, p = count[:, 0], np.where(known, p[:, 0], m.lower_left / (m.types + 1) if m.pairs else 1 / (m.types + 1))
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.types + 1)))

        contexts, c_at = np.unique(context, return_inverse=True)
        seen, (size, kinds) = self.search("context", contexts, shard_of(contexts, contexts, m.shards, m.hot[:0]), ("count", "kinds"), (1, 3))
        size = size[:, 0]
        if len(m.hot):
            place = np.minimum(np.searchsorted(m.hot, contexts), len(m.hot) - 1)
            is_hot = m.hot[place] == contexts
            size[is_hot], kinds[is_hot], seen[is_hot] = m.hot_count[place[is_hot]], m.hot_kinds[place[is_hot]], True
        left = np.where(seen, kinds @ m.discount[1:] / np.maximum(size, 1), 1.0)

        pair = mix(context, word)
        pairs, first, p_at = np.unique(pair, return_index=True, return_inverse=True)
        _, (total,) = self.search("pair", pairs, shard_of(context[first], word[first], m.shards, m.hot), ("count",))
        total = total[:, 0].astype(np.int64)[p_at]
        c = c_at
        own = (total - m.discount[np.minimum(total, 3)]) / np.maximum(size[c], 1)
        logs = np.log10(own + left[c] * p[at])
        n = len(texts)
        return np.bincount(text, weights=count[at] > 0, minlength=n).astype(np.int64), np.bincount(text, weights=base[at], minlength=n), np.bincount(text, weights=logs, minlength=n)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, known = Lookup(model), {}
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size, begin = [], 0, at
                while at < batch.num_rows and size < 1_000_000:
                    texts.append(word_ids(batch.column(1)[at].as_py(), known))
                    size += len(texts[-1])
                    at += 1
                n_known, base, score = lookup.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:at], pa.array([len(x) for x in texts], pa.int64()), pa.array(n_known), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text).

    The model learns from rows whose id's decimal text has crc32 modulo 5 other
    than 1; the others (and a null id) are held out. Null and empty texts have
    one token, the end. Repeated rows count and are scored each; an empty table
    gives no rows, and where no row may be learned from every token is unknown.
    Other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))
    model = count(docs.where(~held))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
