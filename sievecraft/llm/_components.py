"""Connected components: numpy inside a task, large-star/small-star rounds between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import table

#: Edges (16 bytes each) that one task may unite by itself; more go through star rounds. 0 forces the rounds.
ONE_TASK = 4_000_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, nodes 0 to n - 1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (up := label[label])).any():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as a star each: every node that isn't its component's least value, with that value."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[roots(len(nodes), at[: len(a)], at[len(a) :])]
    other = root != nodes
    return nodes[other], root[other]


def _contract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's edges as stars; memory is bounded since edges are united every few million."""
    a, b, size = [], [], 0
    for r in rows:
        a.append(r.column("a").to_numpy())
        b.append(r.column("b").to_numpy())
        size += r.num_rows
        if size > ONE_TASK:
            x, y = star(np.concatenate(a), np.concatenate(b))
            a, b, size = [x], [y], 0
    if a:
        x, y = star(np.concatenate(a), np.concatenate(b))
        for i in range(0, len(x), 1 << 20):
            yield pa.record_batch([pa.array(x[i : i + (1 << 20)]), pa.array(y[i : i + (1 << 20)])], names=["a", "b"])


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b) but the roots themselves.

    Partitions first unite their own edges. What is left goes to one task if it is at most one_task edges, checked
    by count, or up to 16 times as many of at most half as many nodes; beyond that, large-star and small-star rounds run until they
    change nothing.
    """
    limit = ONE_TASK if one_task is None else one_task
    e = table(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_contract, "a long, b long"), "edges")
    n = e.count()
    # partitions repeat each other's nodes, and _contract holds stars of distinct ones: more edges may still fit one task
    if n <= limit or n <= 16 * limit and e.select("a").union(e.select("b")).distinct().count() <= limit // 2:
        done = e.repartition(1).mapInArrow(_contract, "a long, b long")
        return done.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        # large star: neighbours above a node go to the least of it and its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        e = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = table(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
