"""Packing tokenised documents into sequences by the sum-of-squares rule.

A document's token ids end with a separator. Only documents longer than a
sequence are cut, into full pieces; the last piece may be shorter. Pieces are
dealt to shards by a hash, each with a bounded number of pieces, and every shard
packs its own: a piece goes where the sum over gaps g of N(g)^2 becomes
smallest, N(g) being the number of open sequences with g free places, which
keeps sequences of every gap at hand. Putting a piece of length s in a sequence
with gap g changes that sum by 2 (N(g-s) - N(g) + 1), where a gap of zero (a
full sequence) counts nothing and a new sequence is a gap of the full size that
also counts nothing. Pieces come longest first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SEQUENCE = 2048
SEPARATOR = 0
SHARD_PIECES = 100_000
BLOCK_BYTES = 8 << 20  # texts encoded together, by size; one of them may be longer by itself
KNOWN_WORDS = 1_000_000  # entries of a worker's memory of encoded words, cleared when full; results don't depend on it


MARK = "\x01"  # stands between stretches that are encoded together


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    (mark,) = tokenizer.encode(MARK, add_special_tokens=False).ids
    bare = Tokenizer.from_str(json.dumps(json.loads(tokenizer.to_str()) | {"normalizer": None}))
    ends = {e: np.array(tokenizer.encode(e.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes() for e in (b".", b",")}
    return tokenizer, bare, mark, ends, {}


def encode(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, without special tokens.

    The tokenizer drops white space and never joins what it parts, so a text's
    ids are those of its stretches between ASCII white space in a row. The
    texts' stretches are parted and numbered as Arrow columns, and each text's
    ids are gathered by those numbers, so Python sees each distinct stretch of
    the texts once, and encodes it once per worker memory, many in one call with
    MARK in between; those that hold MARK or the opening of a special token go
    one by one. As the tokenizer lower-cases, texts without such an opening are
    lower-cased first; a full stop or comma after a letter is a token of its own;
    and Latin-1 text in lower case needs no normalising.
    """
    tokenizer, bare, mark, ends, known = _tokenizer(path)
    raw = [text.encode("utf-8", "surrogatepass") for text in texts]
    flat = pa.array([r if b"<|" in r else r.lower() for r in raw], pa.large_binary())
    parts = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(flat), flat.buffers()))
    numbered = parts.values.dictionary_encode()
    distinct = pa.Array.from_buffers(pa.large_binary(), len(numbered.dictionary), numbered.dictionary.buffers()).to_pylist()
    fresh = {w for w in distinct if w not in known}
    if len(known) + len(fresh) > KNOWN_WORDS:
        known.clear()
        fresh = set(distinct)
    known[b""] = b""  # before and after white space at a text's ends
    fresh.discard(b"")
    stops = {w for w in fresh if w[-1:] in ends and w[-2:-1].isalpha() and b"<|" not in w}
    asked = fresh.difference(stops).union({w[:-1] for w in stops} - known.keys())
    plain = [w for w in asked if MARK.encode() not in w and b"<|" not in w]
    for word in asked.difference(plain):
        known[word] = np.array(tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype="<u4").tobytes()
    between = f" {MARK} ".encode()
    for at in range(0, len(plain), 5_000):
        some = plain[at : at + 5_000]
        text = between.join(some).decode("utf-8", "surrogatepass")
        if latin := max(text) <= "\xff":
            text = text.lower()
        (got,) = (bare if latin else tokenizer).encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4")
        edges = np.flatnonzero(ids == mark).tolist()
        buffer = ids.tobytes()
        for word, start, stop in zip(some, [-1, *edges], [*edges, len(ids)], strict=True):
            known[word] = buffer[4 * start + 4 : 4 * stop]
    for word in stops:
        known[word] = known[word[:-1]] + ends[word[-1:]]
    ready = list(map(known.__getitem__, distinct))
    ids = np.frombuffer(b"".join(ready), dtype="<u4")
    sizes = np.fromiter(map(len, ready), dtype=np.int64, count=len(ready)) // 4
    word = numbered.indices.to_numpy()
    taken = sizes[word]
    until = np.concatenate([[0], np.cumsum(taken)])  # ids before each stretch
    shift = (np.cumsum(sizes) - sizes)[word] - until[:-1]
    gathered = ids[np.arange(until[-1]) + np.repeat(shift, taken)]
    edges = until[parts.offsets.to_numpy()].tolist()
    return [gathered[start:stop].tobytes() for start, stop in zip(edges, edges[1:])]


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = SEPARATOR.to_bytes(4, "little")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            seen = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64) // BLOCK_BYTES
            starts = [0, *(np.flatnonzero(np.diff(seen)) + 1).tolist()]
            for at, stop in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(at, stop - at)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()], path)):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[start : start + 4 * size]
                        rows.append((doc_id, k, start // 4, len(piece) // 4, zlib.crc32(piece)))
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the given order; sequences are numbered from 0."""
    count = np.zeros(size + 1, dtype=np.int64)  # open sequences by gap; the full ones and the new one count nothing
    open_by_gap: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for k, s in enumerate(lengths.tolist()):
        if s == size:
            sequence[k], offset[k] = made, 0
            made += 1
            continue
        # changes of the sum over gaps s..size, halved: N(g-s) - N(g) + 1, with the special ends
        change = count[: size + 1 - s] - count[s:] + 1
        change[0] = 1 - count[s]  # fills a sequence: (N-1)^2 - N^2, in half steps below
        doubled = 2 * change
        doubled[0] = 1 - 2 * count[s]
        doubled[-1] = 2 * count[size - s] + 1  # opens a sequence: (N+1)^2 - N^2
        able = count[s:] > 0
        able[-1] = True
        g = s + int(np.argmin(np.where(able, doubled, np.iinfo(np.int64).max)))
        if g == size:
            where = made
            made += 1
        else:
            where = open_by_gap[g].pop()
            count[g] -= 1
        sequence[k], offset[k] = where, size - g
        if g > s:
            open_by_gap[g - s].append(where)
            count[g - s] += 1
    return sequence, offset


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row per piece of every row of ``docs`` (doc_id, text).

    Null and empty texts have one piece, the separator. Null or repeated doc_ids
    are packed row by row like any other. An empty table gives no rows; other
    columns are ignored. A text is tokenised whole, however long.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cutted = cut(pieces(docs, path, size), "pack-pieces")
    total = cutted.count()
    shards = max(1, -(-total // shard_pieces))
    dealt = cutted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long"))

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = sum_of_squares(group["length"].to_numpy(), size)
        return group.drop(columns="shard").assign(sequence_id=(key[0] << 40) + sequence, offset=offset)

    return dealt.groupBy("shard").applyInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
