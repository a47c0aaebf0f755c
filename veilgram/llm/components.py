"""Connected components by alternating large-star and small-star steps, all in DataFrames; what a task reads of the edges is joined
within it before, so that few edges need no step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgram.llm import common

#: Edges that a task joins at a time (16 bytes each).
EDGES = 1 << 18


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def _kept(scratch: common.Scratch, e: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges written, and their state, which is also what tells the number of files: two jobs a round."""
    e = e.persist(StorageLevel.DISK_ONLY)
    state = _state(e)
    out = scratch.put("edges", e, 1 + state[0] // common.FILE_ROWS)
    e.unpersist()
    return out, state


def heads(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges, and the smallest of its component: of two heads that an edge joins, the larger gets the smaller."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    head = np.arange(len(nodes))
    while len(x):
        np.minimum.at(head, np.maximum(head[x], head[y]), np.minimum(head[x], head[y]))
        while (head[head] != head).any():
            head = head[head]
        apart = head[x] != head[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[head]


def joined(edges: DataFrame) -> DataFrame:
    """a, b: EDGES edges of a task at a time, as the stars that they make; no more edges than before, and the same components."""
    size = EDGES

    def stars_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        b, a = heads(*(np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (0, 1)))
        return pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            parts, n = [*parts, batch], n + batch.num_rows
            if n >= size:
                yield stars_of(parts)
                parts, n = [], 0
        if n:
            yield stars_of(parts)

    return common.in_arrow(edges.select("a", "b"), work, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (b, a): each node but a component's smallest, with the smallest. Up to EDGES edges are joined in
    one task; of more, those that a task reads are joined before each round. Every step keeps a number of edges no larger than
    before; each round's edges are written and the last ones' deleted; rounds grow with the logarithm squared of the longest path."""
    scratch = common.Scratch(edges.sparkSession, "stars")
    e = edges.filter("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    e, before = _kept(scratch, e)
    if before[0] < EDGES:
        return scratch.put("edges", joined(e.coalesce(1)), 1).select("b", "a")
    while True:
        e = joined(e)
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e, now = _kept(scratch, small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct())
        if now == before:
            break
        before = now
    return e.select("b", "a")
