"""Ranked lexical search by a document FP-tree with branch and bound.

Every row of ``items`` is a query against every row of ``docs``. Terms are
maximal runs of ASCII digits and letters and of all that isn't ASCII, A-Z
lower-cased. Scores are integers: with N documents that hold a term, L terms in
all, n terms of a document and df documents of a term, a term weighs
w = floor(1000 ln((2N + 2) / (2df + 1))), a document has m = 50 + 50 n N div L,
and its score is the sum of w (10^9 tf div (1000 tf + 20 m)) over the item's
terms.

1. Items are dealt to blocks of BLOCK_TERMS (item, term) pairs or so, and for
   each block the documents are searched whole; the terms of a block are all
   that the driver and the tasks hold of the items.
2. A pass over the documents keeps of each its number of terms and its vector
   restricted to the block's terms, written to the shared folder. N, L and df
   are groupings of what is written.
3. A task turns its documents' vectors, terms in order of falling frequency,
   into a trie, TREE_ENTRIES vector entries at a time. A chain of nodes without
   a branch is one node, and up to LEAF equal or neighbouring vectors hang under
   one. A node keeps the largest tf of each term of its subtree and the smallest
   m there, which bound every score of the subtree, as a score grows with tf and
   falls with m. Each item walks the trie depth first, best child first, and
   leaves out children whose bound is below its k-th score so far. Documents of
   equal vectors and m are one entry with their ids in order.
4. A task's best k documents of each item meet those of the others in a
   grouping by item, ranked with a limit by group on both sides of the shuffle.

No step needs two documents together, so no group of documents is gathered;
bounds leave out nothing that could be in the result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

BLOCK_TERMS = 200_000  # (item, term) pairs of the items that are searched together
TREE_ENTRIES = 3_000_000  # entries of the vectors of one trie
LEAF = 24  # vectors that hang under one node without nodes of their own

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, with repeats."""
    return text.translate(_LETTERS).split() if text else []


def term_lists(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (id, text) as (id, terms): distinct terms of each row, as strings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t.decode() for t in sorted(set(terms_of(x.as_py())))] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["id", "terms"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col(text).cast("binary")).mapInArrow(scan, f"id {kind}, terms array<string>")


def restricted_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with at least one term: places in ``vocabulary`` and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): k for k, t in enumerate(vocabulary)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    counts = Counter(map(place, words))
                    counts.pop(None, None)
                    ids.append(k)
                    ns.append(len(words))
                    terms.append(list(counts))
                    tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(scan, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


class Tree:
    """A trie of term vectors. ``children`` has of each node the terms, the tfs and the child of each entry, the children's m, and the children: nodes (negative), with their bounds, or vectors."""

    def __init__(self, ranks: list[np.ndarray], tfs: list[np.ndarray], ms: list[int], places: list[int]):
        """``ranks``: terms of each document by falling frequency, rising; ``places``: documents in the order that ties take."""
        whole = [r.astype(">u4").tobytes() for r in ranks]
        order = sorted(range(len(ranks)), key=lambda i: (whole[i], tfs[i].tobytes(), ms[i], places[i]))
        self.documents: list[list[int]] = []  # of each distinct vector
        self.vectors: list[tuple[np.ndarray, np.ndarray]] = []
        self.m: list[int] = []
        last = None
        keys: list[bytes] = []
        for i in order:
            key = (whole[i], tfs[i].tobytes(), ms[i])
            if key != last:
                last = key
                keys.append(whole[i])
                self.vectors.append((ranks[i], tfs[i]))
                self.m.append(ms[i])
                self.documents.append([])
            self.documents[-1].append(places[i])
        shared = [_common(a, b) for a, b in zip(keys, keys[1:])]  # terms that neighbours begin with
        self.children: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]] = {}
        self.root = self._grow(shared)

    def _grow(self, shared: list[int]) -> int:
        """Nodes from the lengths that neighbours share: a stack of open nodes (depth, children), closed where the shared length falls."""
        stack: list[tuple[int, list[int]]] = [(0, [])]
        bounds: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}  # of nodes: terms, largest tfs, smallest m
        size: list[int] = []
        few: dict[int, list[int]] = {}  # nodes of at most LEAF vectors, not built while they may give way to those

        def build(node: int, members: list[int]) -> None:
            parts = [(*self.vectors[x], self.m[x]) if x >= 0 else bounds.pop(x) for x in members]
            term, tf, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([p[2] for p in parts], dtype=np.int64)
            self.children[node] = (term, tf, np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]), m, members)
            by = np.lexsort((tf, term))
            top = np.flatnonzero(np.append(term[by][1:] != term[by][:-1], True))
            bounds[node] = (term[by][top], tf[by][top], int(m.min()))

        def close(members: list[int]) -> int:
            """A node over ``members``, which are vectors by their number and nodes by negative numbers."""
            node = -len(size) - 1
            size.append(sum(size[-x - 1] if x < 0 else 1 for x in members))
            if size[-1] <= LEAF:
                few[node] = [y for x in members for y in (few.pop(x) if x < 0 else [x])]
                return node
            for x in members:
                if x in few:
                    build(x, few.pop(x))
            build(node, members)
            return node

        stack[0][1].append(0)
        for k, depth in enumerate(shared, 1):
            while stack[-1][0] > depth:
                done = close(stack.pop()[1])
                if stack[-1][0] < depth:
                    stack.append((depth, [done]))
                else:
                    stack[-1][1].append(done)
            if stack[-1][0] < depth:  # the vector before this one and this one meet below what is open
                before = stack[-1][1].pop()
                stack.append((depth, [before]))
            stack[-1][1].append(k)
        while len(stack) > 1:
            members = stack.pop()[1]
            stack[-1][1].append(close(members))
        root = close(stack[0][1])
        if root in few:
            build(root, few.pop(root))
        return root

    def search(self, weight: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Take the documents into ``best``, a heap of (score, minus place) of at most ``k``. ``weight``: of each term, 0 for those not in the item."""
        todo = [(1 << 62, self.root)]
        while todo:
            bound, v = todo.pop()
            if len(best) == k and bound < best[0][0]:
                continue
            term, tf, child, m, members = self.children[v]
            some = np.flatnonzero(weight[term])
            w, f, c = weight[term[some]], tf[some], child[some]
            scores = np.zeros(len(members), dtype=np.int64)
            np.add.at(scores, c, w * (1_000_000_000 * f // (1000 * f + 20 * m[c])))
            least = best[0][0] if len(best) == k else 1
            open_ = []
            for j in np.flatnonzero(scores >= least).tolist():
                x, score = members[j], int(scores[j])
                if x < 0:
                    open_.append((score, x))
                    continue
                for place in self.documents[x]:
                    if len(best) < k:
                        heapq.heappush(best, (score, -place))
                    elif (score, -place) > best[0]:
                        heapq.heapreplace(best, (score, -place))
                    else:
                        break
            todo += sorted(open_)


def _common(a: bytes, b: bytes) -> int:
    """How many terms two vectors begin with together."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, ">u4", n) != np.frombuffer(b, ">u4", n))
    return int(differ[0]) if len(differ) else n


def top_documents(vectors: DataFrame, items: list[tuple[int, list[int]]], df: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): every task's best ``k`` documents of each item. ``items``: (number, terms)."""
    by_df = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), dtype=np.int64)
    rank[by_df] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in df[by_df].tolist()], dtype=np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast(([(i, rank[np.array(t, dtype=np.int64)]) for i, t in items], rank, weight))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rank, weight = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]
        names: dict[int, object] = {}
        kept: list[tuple] = []  # the documents of the trie to come
        held, own = 0, np.zeros(len(weight), dtype=np.int64)

        def search() -> None:
            nonlocal held, names
            # places: the order of ids (null last) among these documents and those that lead so far
            ids = {*names.values(), *(d for d, *_ in kept)}
            order = {d: p for p, d in enumerate(sorted(ids, key=lambda d: (d is None, 0 if d is None else d)))}
            for heap in best:
                heap[:] = [(s, -order[names[-p]]) for s, p in heap]
                heapq.heapify(heap)
            names = {p: d for d, p in order.items()}
            tree = Tree([r for _, r, _, _ in kept], [f for *_, f, _ in kept], [m for *_, m in kept], [order[d] for d, *_ in kept])
            for heap, (_, terms) in zip(best, wanted):
                own[terms] = weight[terms]
                tree.search(own, heap, k)
                own[terms] = 0
            alive = {-p for heap in best for _, p in heap}
            names = {p: names[p] for p in alive}
            kept.clear()
            held = 0

        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            terms, tfs = batch.column(2), batch.column(3)
            at = terms.offsets.to_numpy()
            flat, counts = rank[terms.values.to_numpy()], tfs.values.to_numpy()
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if a < b:
                    by = np.argsort(flat[a:b])
                    kept.append((ids[i], flat[a:b][by], counts[a:b][by], 50 + 50 * n[i] * total // length))
                    held += b - a
                    if held >= TREE_ENTRIES:
                        search()
        if kept:
            search()
        rows = [(i, names[-p], s) for heap, (i, _) in zip(best, wanted) for s, p in heap]
        kind = batch_kind
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(vectors.schema["doc_id"].dataType)
    return vectors.mapInArrow(scan, f"item long, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item by the rule above, ranks from 1.

    ``items`` has item_id and text; rows of one item_id are one item with the
    terms of them all, those with a null id too. Equal scores are ranked by
    rising doc_id, null last. Each row of ``docs`` (doc_id, text) is a document,
    repeated ones too. Null and empty texts have no terms: such documents and
    items are in no result. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = term_lists(items.select(F.col("item_id").alias("id"), "text")).groupBy(F.col("id").alias("item_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)
    asked = cut(asked, "search-items")
    pairs = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-pairs // BLOCK_TERMS))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = [_search_block(docs, numbered.where(F.col("block") == b), k) for b in range(blocks)]
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """Candidates (item_id, doc_id, score) of one block of items: at most ``k`` a task and item."""
    rows = block.select("item_id", "terms").collect()  # BLOCK_TERMS pairs or so
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    place = {t: n for n, t in enumerate(vocabulary)}
    vectors = cut(restricted_vectors(docs, vocabulary), "search-vectors")
    total, length = (x or 0 for x in vectors.agg(F.count("*"), F.sum("n")).first())
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # one row a term
    df = np.zeros(len(vocabulary), dtype=np.int64)
    df[held.column("term").to_numpy()] = held.column("n").to_numpy()
    listed = [(n, [place[t] for t in r["terms"]]) for n, r in enumerate(rows)]
    found = cut(top_documents(vectors, listed, df, total, length, k), "search-found")
    drop_cut(vectors)
    names = docs.sparkSession.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], f"item long, item_id {block.schema['item_id'].dataType.simpleString()}")
    return found.join(names, "item").select("item_id", "doc_id", "score")


ORACLE = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
whole AS (SELECT count(*) AS big_n, sum(n)::HUGEINT AS big_l FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
m AS (SELECT doc_id, (50 + (50 * n::HUGEINT * big_n) // big_l)::BIGINT AS m FROM n, whole),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM items JOIN tf USING (term) JOIN df USING (term) JOIN m USING (doc_id), whole GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
