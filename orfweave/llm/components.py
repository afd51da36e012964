"""Connected components of a graph that may be too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges (16 bytes each) up to which one task joins them up; more go round by round. The labels are the same.
SMALL = 1 << 20


def components(edges: DataFrame, scratch: Scratch, small: int = SMALL) -> DataFrame:
    """Edges (a, b) to (node, label): the smallest node of each node's component."""
    edges = scratch.write(edges.select("a", "b").where("a <> b"), "edges")
    if edges.count() <= small:
        labels = scratch.write(edges.repartition(1).mapInArrow(_joined, "node bigint, label bigint"), "labels")
        scratch.drop(edges)
        return labels
    return _rounds(edges, scratch)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find; a root is the smallest node of its tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "label"])


def _rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each round a node takes the smallest label among its neighbours' and then its label's own label. Both are minima by
    key, summed up before the shuffle; a hub's edges are joined by a skewed join, never gathered. What a node's label
    was before gets the new label as a neighbour, so trees of labels are pulled together from both ends and a
    chain's length falls by a factor each round, as with alternating stars; rounds go on until nothing moves.
    A round's tables are written, which cuts the lineage."""
    both = scratch.write(edges.union(edges.select("b", "a")).distinct(), "both")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        ends = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select("a", "label")
        near = ends.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = scratch.write(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("met")), "met")
        # the label that a node leaves learns of the one that it takes
        hooked = met.where("met < label").select(F.col("label").alias("node"), F.col("met").alias("hook")).groupBy("node").agg(F.min("hook").alias("hook"))
        own = scratch.write(met.join(hooked, "node", "left").select("node", "label", F.least("met", "hook").alias("met")), "own")
        jump = own.join(own.select(F.col("node").alias("met"), F.col("met").alias("far")), "met")
        new = scratch.write(jump.select("node", F.least("met", "far").alias("new"), (F.least("met", "far") < F.col("label")).alias("moved")), "labels")
        for done in (labels, met, own):
            scratch.drop(done)
        labels = new.select("node", F.col("new").alias("label"))
        if not new.where("moved").limit(1).count():
            scratch.drop(both)
            return labels
