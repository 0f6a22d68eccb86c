"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.common import cut


class Forest:
    """Union-find with the smallest member as the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[up] if up in self.up else up
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]


def thinned(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by those of a spanning forest of depth one."""
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        found = forest.edges()
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()),
                                          "b": pa.array([y for _, y in found], pa.int64())})

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(thin, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable from it.

    Smallest labels move along the edges and then jump to the label of the label, so the rounds grow with the
    logarithm of the longest path. Every round is cut by a checkpoint. No edges give no rows.
    """
    once = cut(thinned(edges).where("a != b"))
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        roots = moved.select(F.col("node").alias("of"), F.col("next").alias("root"))
        jumped = cut(moved.join(roots, F.col("next") == F.col("of"), "left").select(
            "node", "was", F.least("next", F.coalesce("root", "next")).alias("component")))
        labels = jumped.select("node", "component")
        if not jumped.where("was != component").limit(1).count():
            return labels
