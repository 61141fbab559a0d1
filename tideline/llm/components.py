"""Connected components of an edge table.

Edges are first thinned: every task keeps a spanning forest of its own. While they are more than one task may hold, labels fall to the
least neighbour and to their label's label, a written table a round; at or below that number one task joins them at once.
Both ways give the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import materialise

#: Edges (of 16 bytes) that one task may hold.
ONE_TASK = 2_000_000


class Forest:
    """Union by least label, with paths halved."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent[p]
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning forest of the edges of a batch, as (node, root)."""
    for batch in batches:
        yield _labels([batch])


def _labels(batches) -> pa.RecordBatch:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = np.fromiter(forest.parent, np.int64, len(forest.parent))
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([forest.root(int(x)) for x in nodes], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, label of every node that an edge (a, b) of longs names; equal labels: connected."""
    thin = materialise(edges.select("a", "b").mapInArrow(_thin, "a long, b long"), "edges")
    if thin.count() <= one_task:
        return materialise(thin.coalesce(1).mapInArrow(lambda batches: iter([_labels(batches)]), "a long, b long").toDF("node", "label"), "labels")
    both = materialise(thin.union(thin.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialise(least.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = not new.filter("old <> label").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels
