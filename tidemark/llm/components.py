"""Distributed union-find: connected components of links by hooking and contraction."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

#: So many links, whatever the table, are finished in one task.
LAST = 20_000


def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of the last links, a and b, by union-find; the smaller of two roots stays."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable, for every node that a link names. Nodes are longs.

    Each round every node takes its smallest neighbour as parent, then the parent of that, twice, and links are redrawn between what
    the nodes took; minima are combined before they are moved, so a node with very many links is no burden. Rounds go on until few links
    are left. A round keeps only what its nodes took, and labels are passed back from the last round to the first, so that nodes
    settled early are not carried through later rounds. Every round is a written table."""
    edges = written(links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a <> b").distinct(), "links")
    rounds = []
    while edges.count() > LAST:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        taken = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent"))
        for _ in range(2):
            taken = written(taken, "parents")
            taken = taken.join(taken.select(F.col("node").alias("parent"), F.col("parent").alias("above")), "parent").select("node", F.col("above").alias("parent"))
        taken = written(taken, "parents")
        rounds.append(taken)
        pa_, pb = taken.select(F.col("node").alias("a"), F.col("parent").alias("pa")), taken.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        drawn = edges.join(pa_, "a").join(pb, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = written(drawn.where("a <> b").distinct(), "links")
    label = edges.repartition(1).mapInArrow(rest, "node long, label long")
    for taken in reversed(rounds):
        above = label.select(F.col("node").alias("parent"), "label")
        label = taken.join(above, "parent", "left").select("node", F.coalesce("label", "parent").alias("label"))
    return written(label, "labels")
