"""Connected components by alternating large-star and small-star steps; every step is two shuffles of long pairs, whatever the shape of the graph. Before each, the edges of a partition become a forest; a graph
that has no more than LOCAL edges is finished in one task, which gives the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


#: Edges that one task takes: 16 bytes each.
LOCAL = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges a-b: each node of a component that isn't its smallest, and the smallest."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:
            again = new[new]
            if (again == new).all():
                break
            new = again
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of up to LOCAL edges at a time."""
    a, b, n = [], [], 0

    def out() -> pa.RecordBatch:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= LOCAL:
            yield out()
            a, b, n = [], [], 0
    if n:
        yield out()


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours become neighbours of its smallest neighbour (or of itself, if that is smaller)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours become neighbours of the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    rest = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return rest.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """edges: a, b (long). Returns node, component: each node with the smallest node that it is connected with; loops and repeats do no harm. Without edges the result is empty.

    Each round is written to the shared folder; the stars are complete when a round changes nothing.
    """
    now = materialise(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forests, "a long, b long"), "edges")
    mark = None
    while True:
        if now.count() <= local:
            after = materialise(now.repartition(1).mapInArrow(_whole, "a long, b long"), "stars")
            discard(now)
            now = after
            break
        after = materialise(_small(_large(now)), "stars")
        r = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if (r[0], r[1]) == mark or r[0] == 0:
            break
        mark = (r[0], r[1])
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    if rows:
        x, y = forest(*(np.concatenate([r.column(k).to_numpy(zero_copy_only=False) for r in rows]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
