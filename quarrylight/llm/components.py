"""Connected components of links between 64-bit nodes: contracted in tasks, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._shared import checkpointed

#: Links that one task contracts.
LINKS_AT_ONCE = 1 << 18


class Forest:
    """Union-find over nodes 0..n-1; the root of a tree is its smallest node."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links a-b have, as links of each node to the smallest one of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in np.unique(np.stack([place[: len(a)], place[len(a) :]], 1), axis=0).tolist() if len(a) else []:
        forest.union(x, y)
    root = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
    apart = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[apart], nodes[root[apart]]


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars of the same components."""
    parts = list(batches)
    if parts:
        links = pa.Table.from_batches(parts)
        a, b = local_stars(links["a"].to_numpy(), links["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node reaches; `links` has a, b (long).

    Tasks of some LINKS_AT_ONCE links contract them first. If more than one was needed, rounds of stars
    follow; each round's links are cut off into the shared checkpoint folder, and the rounds end when a
    round changes nothing, after about the logarithm of the longest path.
    """
    links = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    tasks = -(-links.count() // LINKS_AT_ONCE)
    links = checkpointed(links.coalesce(max(1, tasks)).mapInArrow(_contracted, "a long, b long"))
    before = None
    while tasks > 1:
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
        links = checkpointed(_small_star(_large_star(links)))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
