"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch

EDGES = 200_000     # edges that a task reduces at once
LEAST_TASKS = 8


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges (a, b) as stars: each node with the smallest it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def _unfinished(stars: DataFrame) -> bool:
    """Whether a node points to two others, or to one that points on."""
    end = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")),
                            F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))).alias("end")
    each = stars.select(end).groupBy("end.node").agg(
        F.min("end.to").alias("low"), F.max("end.to").alias("high"), (F.count("*") > F.count("end.to")).alias("centre"))
    return each.where("low <> high or (low is not null and centre)").count() > 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.
    Valid while ``scratch`` is.

    Tasks first reduce their own edges to stars (never more rows than nodes), once where the edges lie and once in tasks
    of about ``EDGES`` edges. Then two star steps alternate, each round's edges reduced by task again, until every
    node points to a centre: a number of rounds that grows with the logarithm of the longest path.
    Every round is written to the shared folder."""
    def reduced(edges: DataFrame, n: int) -> DataFrame:
        return scratch.saved(edges.coalesce(max(LEAST_TASKS, -(-n // EDGES))).mapInArrow(forest, "a long, b long"), "stars")

    stars = scratch.saved(edges.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long"), "stars")
    stars = reduced(stars, stars.count())
    while _unfinished(stars):
        # large-star: a node's larger neighbours go to its smallest one
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small-star: a node's smaller neighbours, and itself, go to its smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                             F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        stars = reduced(small, stars.count())
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def id_bitmap(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of a long column with 2**bits places: a fixed size, whatever the rows."""
    segment = (1 << min(bits, 20)) // 8   # bytes

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for at in places(batch.column("id").to_numpy(), bits):
                np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        full = [s for s in range(len(own) // segment) if own[s * segment:(s + 1) * segment].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()),
             pa.array([own[s * segment:(s + 1) * segment].tobytes() for s in full], pa.binary())], ["segment", "places"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(segment, np.uint8)
        for x in group.column("places"):
            total |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"segment": group.column("segment").slice(0, 1), "places": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    shape = "segment int, places binary"
    for r in ids.select(F.col(column).alias("id")).mapInArrow(mark, shape).groupBy("segment").applyInArrow(merge, shape).collect():
        out[r["segment"] * segment:(r["segment"] + 1) * segment] = np.frombuffer(r["places"], np.uint8)
    return out


def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return [(h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)]


def maybe_in(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether ids may be in the filter; never false for one that is."""
    bits = (len(packed) * 8).bit_length() - 1
    out = np.ones(len(ids), bool)
    for at in places(ids, bits):
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
