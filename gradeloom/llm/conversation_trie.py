"""Prefix trie of conversations as balanced parentheses.

A conversation is a sequence of turns (role, text); equal beginnings share
nodes. Spark orders the conversations by their turns' hashes and deals ranges of
that order to tasks, and each task encodes BLOCK_TURNS turns at a time:

* The block's trie in preorder is a sequence of parentheses, an opening one where
  a node begins and a closing one where its subtree ends.
* Blocks of 2, 4, 8, ... parentheses keep their least and greatest excess (opening
  less closing ones so far); ``findclose`` climbs over blocks that don't hold the
  wanted excess and goes down into the first that does, for all nodes at once.
* A node's subtree lies between its parentheses, so the leaves in it are a
  difference of ranks of "()", conversations are a difference of counted ends, and
  saved tokens a difference of cumulated sums.

Of a block only the nodes on the path of its first or last conversation can go
on in other blocks: its spines. All others are whole. Spine nodes are named by a
hash of their turns and their parts are summed by name, in Spark. What a subtree
needs of other spine nodes (how many are leaves, their texts' bytes) is summed
without listing ancestors: each node is counted on one path through it, a running
sum from the path's end gives each depth what lies below it on that path, and a
node takes the sum over all paths through it. So nothing grows with a group's
size but the conversations themselves: a beginning or a whole conversation that a
third of all share is spread over as many blocks as it fills. Lists of
conversations that end in a spine node are pieced together from chunks of
CHUNK_IDS ids, hashed one after the other by the task that reads them sorted.

A task holds a block: 24 bytes of hash and length for each of its turns, and at
least one whole conversation. Texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

HASH = 16  # bytes of SHA-256 that stand for a turn or a node
BLOCK_TURNS = 500_000
CHUNK_IDS = 512
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.sha256(b"").digest()[:HASH]


def turns_taken(conv_id: Column) -> Column:
    """How many turns of its group's first conversation a conversation begins with, at most."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, key): each conversation's first turns replaced by those of the first of its group of five ids.

    ``turns`` has a struct of hash and UTF-8 bytes for each turn, ``key`` the hashes one after the other.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    named = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * HASH))
    turns = conversations.where("conv_id is not null").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", named.alias("hash"), F.octet_length(text).cast("long").alias("bytes")).alias("x"))
    # dealt by group once: conversations, and each group's first one beside them
    whole = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("x")).alias("own"))
    first = F.first(F.when(F.col("base") == F.col("conv_id"), F.slice("own", 1, 8)), ignorenulls=True).over(Window.partitionBy("base"))
    h = turns_taken(F.col("conv_id"))
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["hash"].alias("hash"), x["bytes"].alias("bytes")))
    begun = F.coalesce(plain(F.slice("first", F.lit(1), h)), F.array().cast("array<struct<hash:binary,bytes:bigint>>"))
    joined = whole.withColumn("first", first).select("conv_id", F.concat(begun, plain(F.slice("own", h + 1, F.size("own")))).alias("turns"))
    return joined.withColumn("key", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["hash"])), "")))


def find_close(opens: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place of an opening parenthesis that of the one that closes it. ``opens``: True where one opens."""
    excess = np.cumsum(np.where(opens, 1, -1))
    top = max(1, int(len(excess) - 1).bit_length())
    low = [np.pad(excess, (0, (1 << top) - len(excess)), constant_values=np.iinfo(np.int64).max // 2)]
    high = [np.pad(excess, (0, (1 << top) - len(excess)), constant_values=np.iinfo(np.int64).min // 2)]
    for _ in range(top):
        low.append(np.minimum(low[-1][::2], low[-1][1::2]))
        high.append(np.maximum(high[-1][::2], high[-1][1::2]))
    lows, highs = np.concatenate(low), np.concatenate(high)
    first = np.cumsum([0] + [len(x) for x in low])[:-1]  # where each level begins
    wanted = excess[places] - 1
    at, level = places + 1, np.zeros(len(places), dtype=np.int64)
    todo = np.arange(len(places))
    while len(todo):  # up over blocks without the wanted excess
        here = first[level[todo]] + at[todo]
        has = (lows[here] <= wanted[todo]) & (wanted[todo] <= highs[here])
        todo = todo[~has]
        onward = at[todo] & 1 == 1  # the right one of two: both are done, the next block is wider
        at[todo] = np.where(onward, (at[todo] + 1) >> 1, at[todo] + 1)
        level[todo] += onward
    todo = np.flatnonzero(level > 0)
    while len(todo):  # down into the first half that has it
        level[todo] -= 1
        at[todo] *= 2
        here = first[level[todo]] + at[todo]
        at[todo] += ~((lows[here] <= wanted[todo]) & (wanted[todo] <= highs[here]))
        todo = todo[level[todo] > 0]
    return at


class Block:
    """A trie of conversations in the order of their keys, as parentheses with arrays beside them."""

    def __init__(self, ids: list[int], keys: list[bytes], sizes: list[np.ndarray]):
        """``sizes``: bytes of each turn's text, of each conversation."""
        self.ids, self.keys = np.array(ids, dtype=np.int64), keys
        depth = np.array([len(k) // HASH for k in keys])
        shared = np.array([0, *(_shared(a, b) for a, b in zip(keys, keys[1:]))])
        fresh = depth - shared  # nodes that a conversation opens
        # the root opens; each conversation closes what it doesn't share and opens its own; all close
        closed = np.append(np.append(0, depth[:-1] - shared[1:]), depth[-1])
        runs = np.column_stack([closed, np.append(fresh, 0)]).ravel()
        self.opens = np.concatenate([[True], np.repeat(np.tile([False, True], len(runs) // 2), runs), [False]])
        place = np.flatnonzero(self.opens)
        close = find_close(self.opens, place)
        self.nodes = len(place)
        begin = np.cumsum(np.append(1, fresh))[:-1]  # first node that each conversation opens
        conv = np.repeat(np.arange(len(ids)), fresh)
        self.depth = np.append(0, shared[conv] + 2 + np.arange(self.nodes - 1) - begin[conv])
        self.bytes = np.concatenate([[0], *(s[k:] for s, k in zip(sizes, shared.tolist()))]).astype(np.int64)
        self.parent = np.full(self.nodes, -1)
        self.end = np.zeros(len(ids), dtype=np.int64)  # the node in which each conversation ends
        path = [0]
        for i, (k, d, b) in enumerate(zip(shared.tolist(), depth.tolist(), begin.tolist())):
            del path[k + 1 :]
            if d > k:
                self.parent[b] = path[k]
                self.parent[b + 1 : b + d - k] = np.arange(b, b + d - k - 1)
                path += range(b, b + d - k)
            self.end[i] = path[-1]
            if i == 0:
                self.first = list(path)
        self.last = path
        self.place, self.close = place, close
        ends = np.bincount(self.end, minlength=self.nodes)
        self.n = self.within(ends)
        self.start = np.cumsum(np.append(0, ends))[:-1]  # a node's conversations stand together in order: the first
        self.leaf = ~self.opens[place + 1]
        self.children = np.bincount(self.parent[1:], minlength=self.nodes)

    def within(self, amounts: np.ndarray) -> np.ndarray:
        """The sum of ``amounts`` (of each node) over each node's subtree: a difference of ranks at its parentheses."""
        rank = np.zeros(len(self.opens) + 1, dtype=np.int64)
        rank[self.place + 1] = amounts
        rank = np.cumsum(rank)
        return rank[self.close + 1] - rank[self.place]

    def least(self) -> np.ndarray:
        """The smallest id of each node's conversations, which stand together in order."""
        edges = np.column_stack([self.start, self.start + self.n]).ravel()
        return np.minimum.reduceat(np.append(self.ids, np.iinfo(np.int64).max), edges)[::2]


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // HASH
    if a[: n * HASH] == b[: n * HASH]:
        return n
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n * HASH) != np.frombuffer(b, np.uint8, n * HASH))
    return int(differ[0]) // HASH


def _names(key: bytes) -> list[bytes]:
    """The names of the nodes on a conversation's path, the root's first."""
    running, names = hashlib.sha256(), [ROOT]
    for at in range(0, len(key), HASH):
        running.update(key[at : at + HASH])
        names.append(running.copy().digest()[:HASH])
    return names


KINDS = NODE, SPINE, CHUNK = 0, 1, 2
SCHEMA = "kind byte, node binary, parent binary, path string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KIND_TYPES = [pa.int8(), pa.binary(), pa.binary(), pa.string(), *[pa.int64()] * 8, pa.string()]


def encoded(convs: DataFrame) -> DataFrame:
    """Rows of SCHEMA from (conv_id, key, sizes), ordered and dealt by (key, conv_id).

    NODE: a whole node; its parent's conv_id, or the parent's name where that is a spine node. SPINE: a block's part of a
    spine node on one of the block's two paths (sums only on the first of them); n_children and n_leaves count whole nodes,
    saved_tokens all bytes of members less those of whole nodes. CHUNK: ids of conversations that end in a spine node, conv_id
    is the first of them.
    """

    def rows(block: Block, name: str) -> Iterator[pa.RecordBatch]:
        least = block.least()
        spine = {v: n for path, key in ((block.first, block.keys[0]), (block.last, block.keys[-1])) for v, n in zip(path, _names(key))}
        on = np.zeros(block.nodes, dtype=bool)
        on[list(spine)] = True
        leaves = block.within((block.leaf & ~on).astype(np.int64))
        kept = block.within(block.n * block.bytes) - block.within(np.where(on, 0, block.bytes))
        whole_children = np.bincount(block.parent[1:][~on[1:]], minlength=block.nodes)
        stops = np.flatnonzero(np.append(True, block.end[1:] != block.end[:-1]))  # conversations of one end stand together
        ends = {int(block.end[a]): block.ids[a:b].tolist() for a, b in zip(stops, [*stops[1:], len(block.end)])}

        inner = np.flatnonzero(~on)
        for at in range(0, len(inner), 50_000):
            v = inner[at : at + 50_000]
            up = block.parent[v]
            hung = on[up]
            listed = [hashlib.sha256(",".join(map(str, ends[x])).encode()).hexdigest() if x in ends else NO_ENDS for x in v.tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(v), NODE, np.int8)), pa.nulls(len(v), pa.binary()), pa.array([spine.get(x) for x in up.tolist()], pa.binary()), pa.nulls(len(v), pa.string()), pa.array(least[v]), pa.array(block.depth[v]), pa.array(least[up], mask=hung),
                pa.array(block.n[v]), pa.array(block.children[v]), pa.array(leaves[v]), pa.array(kept[v]), pa.array(block.bytes[v]), pa.array(listed, pa.string()),
            ], names=NAMES)
        out = []
        for side, path in (("first", block.first), ("last", block.last)):
            for d, v in enumerate(path):
                own = side == "first" or d >= len(block.first) or block.first[d] != v
                sums = (x[v].item() if own else 0 for x in (block.n, whole_children, leaves, kept))
                out.append((SPINE, spine[v], spine[path[d - 1]] if d else None, f"{name}-{side}", least[v].item(), d, None, *sums, block.bytes[v].item(), None))
        for v, n in spine.items():
            own = ends.get(v, [])
            for at in range(0, len(own), CHUNK_IDS):
                part = own[at : at + CHUNK_IDS]
                out.append((CHUNK, n, None, None, part[0], *[None] * 7, ",".join(map(str, part))))
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000]), KIND_TYPES)], names=NAMES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, keys, sizes, held = [], [], [], 0
        for batch in batches:
            for c, k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(c)
                keys.append(k)
                sizes.append(s.values.to_numpy())
                held += 1 + len(k) // HASH
                if held >= BLOCK_TURNS:
                    yield from rows(Block(ids, keys, sizes), f"{part}-{number}")
                    ids, keys, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield from rows(Block(ids, keys, sizes), f"{part}-{number}")

    dealt = convs.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return dealt.select("conv_id", "key", "sizes").mapInArrow(scan, SCHEMA)


def chunks_hashed(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 over each node's chunks in order. A task reads its nodes' chunks sorted and holds one state."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(names: list[bytes], states: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([s.hexdigest() for s in states], pa.string())], names=["node", "ends_sha256"])

        node, state = None, None
        for batch in batches:
            names, states = [], []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != node:
                    if node is not None:
                        names.append(node)
                        states.append(state)
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield done(names, states)
        if node is not None:
            yield done([node], [state])

    ordered = chunks.repartition("node").sortWithinPartitions("node", "conv_id")
    return ordered.select("node", "ends").mapInArrow(scan, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations; columns as below.

    conv_id (smallest of the node's conversations), depth, parent_conv_id (null
    for the root), n_convs, n_children, n_leaves and saved_tokens of the subtree,
    ends_sha256 of the decimal ids of those that end here.

    ``conversations`` has conv_id, turn, role and text, a row per turn. Turns go by
    number, null first; those of equal numbers by the SHA-256 of role and text, so
    reruns agree; a repeated row is a turn again. Null roles and texts are empty.
    Rows without conv_id belong to no conversation. A conversation that keeps no
    turn is in the root alone. An empty table gives no rows; other columns are
    ignored.
    """
    convs = rebuilt(conversations).select("conv_id", "key", F.transform("turns", lambda x: x["bytes"]).alias("sizes"))
    parts = cut(encoded(cut(convs, "trie-conversations")), "trie-parts")
    spines = parts.where(F.col("kind") == SPINE)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = cut(spines.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"), F.min("path").alias("path"), *sums), "trie-spines")
    below = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("spine_children"))
    counted = cut(merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("spine_children", F.lit(0))).drop("spine_children"), "trie-counted")
    # each spine node once, on the path that names it; a node takes what lies at its depth or below on all paths through it
    own = counted.select("node", "path", (F.col("n_children") == 0).cast("long").alias("leaf"), "bytes")
    steps = spines.select("node", "path", "depth").join(own, ["node", "path"], "left")
    lower = Window.partitionBy("path").orderBy(F.desc("depth"))
    running = steps.select("node", *(F.sum(F.coalesce(c, F.lit(0))).over(lower).alias(c) for c in ("leaf", "bytes")))
    under = running.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("bytes").alias("under"))
    ends = chunks_hashed(parts.where(F.col("kind") == CHUNK))
    named = counted.join(under, "node").join(ends, "node", "left").select("node", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") - F.col("under")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    named = cut(named, "trie-merged")
    parents = named.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = parts.where(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    inner = whole.where("parent is null").select(columns)
    hung = whole.where("parent is not null").join(parents, "parent").withColumn("parent_conv_id", F.col("above")).select(columns)
    shared = named.join(parents, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(columns)
    return inner.unionByName(hung).unionByName(shared)


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, conv_id - conv_id % 5 AS base, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM t),
crcs AS (SELECT conv_id, base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c // 2, 3988292384 * (c % 2)))) AS crc FROM (SELECT DISTINCT conv_id, base FROM o)),
ids AS (SELECT conv_id, base, xor(crc, 4294967295) % 9 AS h FROM crcs),
parts AS (SELECT c.conv_id, i AS place, role, text FROM ids c JOIN o ON o.conv_id = c.base AND i <= h
    UNION ALL SELECT c.conv_id, 8 + i, role, text FROM ids c JOIN o ON o.conv_id = c.conv_id AND i > h),
whole AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY place) AS turns FROM parts GROUP BY 1),
convs AS (SELECT conv_id, coalesce(turns, []) AS turns FROM ids LEFT JOIN whole USING (conv_id)),
steps AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM convs),
nodes AS (SELECT depth, turns[1:depth] AS seq, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(any_value(turns)[depth].text) ELSE 0 END AS own FROM steps GROUP BY 1, 2),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.seq = n.seq[1:n.depth - 1]),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids k ON k.conv_id = l.conv_id AND k.depth = l.depth),
up AS (SELECT seq[1:a] AS seq, a AS depth, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_) GROUP BY 1, 2)
SELECT conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_ f JOIN up ON up.depth = f.depth AND up.seq = f.seq
"""
