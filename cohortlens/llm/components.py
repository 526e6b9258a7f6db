"""Connected components of a table of links, without collecting them.

Each partition of links is first reduced to stars by a union-find over that partition alone; then labels
are lowered in rounds (every vertex and every vertex's label takes the least label in sight, then labels jump to their
own labels), each round written to the shared folder, until none changes.  The number of rounds
grows with the logarithm of the longest path.

Edge cases: repeated links change nothing; a vertex that is linked with itself alone has no row; without links there are no rows.  A worker holds a number or two for each vertex of its partition's links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) of each partition replaced by links from each vertex to the least one of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        found = [(v, r) for v in list(root) if (r := find(v)) != v]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return links.select("a", "b").mapInArrow(frugal(run), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """vertex, component (the least vertex reachable) for every vertex of links (a, b: long, not null)."""
    edges = stored(stars(links), "links")
    both = edges.union(edges.select("b", "a")).distinct()
    labels = stored(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("vertex"), F.min("b")).alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.vertex).groupBy("a").agg(F.min("label").alias("seen"))
        near = labels.join(seen, labels.vertex == seen.a).select("vertex", "label", F.least("label", "seen").alias("least"))
        told = near.select("vertex", "least").union(near.select("label", "least")).groupBy("vertex").agg(F.min("least").alias("label"))
        up = told.select(F.col("vertex").alias("label"), F.col("label").alias("above"))
        jumped = told.join(up, "label").select("vertex", "above")
        after = labels.join(jumped, "vertex").select("vertex", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("changed"))
        labels = stored(after, "labels")
        if labels.where("changed").isEmpty():
            return labels.select("vertex", F.col("label").alias("component"))
        labels = labels.drop("changed")
