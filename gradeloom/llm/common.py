"""Pieces that several text operators share: word rules, written cuts, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable, not a repeated expression."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir, or where it is unset and the master is local (tests) one of our own."""
    sc = spark.sparkContext
    uri = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not uri:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        sc.setCheckpointDir(uri)
    return uri if urlsplit(uri).scheme else "file://" + os.path.abspath(uri)


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/gradeloom/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: lineage ends, lost executors cost nothing, sizes are known to the optimizer."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a ``cut`` that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/gradeloom/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def marked_bits(places: DataFrame, size: int) -> np.ndarray:
    """``size`` bits (a multiple of 64) as unsigned words, of which those in the column place are set; held by the driver."""
    words = places.select(F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(size >> 6, dtype=np.uint64)
    marks[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return marks


FILTER_BITS = 16  # for each id
MOST_BITS = 1 << 28
SEEDS = (11, 12, 13, 14)


def filter_size(n: int, most_bits: int = MOST_BITS) -> int:
    return min(most_bits, 1 << max(6, (FILTER_BITS * n - 1).bit_length()))


def id_filter(ids: DataFrame, most_bits: int = MOST_BITS):
    """A condition on doc_id that is true for all of ``ids`` and, by chance, for about one in 400 others: a Bloom filter.

    Of very many ids it lets more others through, as it never has more than
    ``most_bits`` (a power of two); it never leaves out one of ``ids``.
    """
    size = filter_size(ids.count(), most_bits)
    places = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(size)) for seed in SEEDS])
    shared = ids.sparkSession.sparkContext.broadcast(marked_bits(ids.select(F.explode(places).alias("place")), size))

    @F.arrow_udf("boolean")
    def passes(*columns: pa.Array) -> pa.Array:
        good = np.ones(len(columns[0]), dtype=bool)
        for column in columns:
            at = column.to_numpy(zero_copy_only=False)
            good &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pa.array(good)

    return passes(*[F.get(places, F.lit(k)) for k in range(len(SEEDS))])


def local_path(uri: str) -> str | None:
    """The path behind a file: URI, or None for another kind of store."""
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


FEW_EDGES = 100_000  # no more rows than these in one task are no hub


def connected_components(edges: DataFrame, what: str = "components", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as (node, component): component is its smallest node.

    ``edges`` has columns a and b of one orderable type. Rows with a null end and
    self loops add nothing; repeated edges count once; a node without an edge has
    no row; no edges give no rows. Alternates large-star and small-star steps
    until the edges stay the same: each round links every neighbour of a node to
    the smallest one, so a long chain shrinks by half. A node with very many
    links is reduced by ``min`` with map-side combining. Of more than FEW_EDGES
    edges the minima are written before the links join them: both sides of that
    join are then read from files and dealt for it alone, so adaptive execution
    splits a hub's links over tasks (spark.sql.adaptive.skewJoin) or broadcasts
    minima whose measured size is small. Edges stay distributed and each round
    is written to the shared folder.
    """
    kind = edges.schema["a"].dataType

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = settled(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{what}-least")
        seen = both.where(F.col("b") > F.col("a")) if large else both
        out = seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def written(e: DataFrame) -> tuple[DataFrame, dict]:
        """Edges written anew, with their number and a hash of them all, observed while they are written."""
        seen = Observation()
        return cut(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), what), {"n": seen.get.get("n", 0), "h": seen.get.get("h")}

    held: list[DataFrame] = []  # written, and no longer read once the round is written

    def settled(df: DataFrame, name: str) -> DataFrame:
        """Written, if the round's edges are many."""
        if seen["n"] <= FEW_EDGES:
            return df
        held.append(cut(df, name))
        return held[-1]

    now, seen = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds if seen["n"] else 0):
        before, last = now, seen
        now, seen = written(star(settled(star(before, True), f"{what}-half"), False))
        for old in (before, *held):
            drop_cut(old)
        held.clear()
        if seen == last:
            break
    else:
        if seen["n"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.union(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
