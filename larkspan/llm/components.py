"""Connected components of an edge table: union-find inside partitions, star contraction between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import materialize

#: Nodes that one task keeps in its union-find before it hands its trees on.
MOST_NODES = 1_000_000


class UnionFind:
    """Trees over hashable nodes whose root is the least node."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _forest(edges: DataFrame) -> DataFrame:
    """The same components with at most one edge for each node and task."""

    def work(batches):
        trees = UnionFind()

        def out():
            pairs = [(x, r) for x in trees.up if (r := trees.find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trees.join(x, y)
            if len(trees.up) > MOST_NODES:
                yield out()
                trees = UnionFind()
        yield out()

    return edges.mapInArrow(work, "u long, v long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (u long, v long); root is the least node of the component.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until nothing changes; edges point to smaller nodes throughout.
    Self-loops and repeats do no harm. Every round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    e = materialize(_forest(e).distinct(), f"{name}-forest")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    before = e.agg(mark.alias("m")).first()["m"]
    step = 0
    while before["n"]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # least neighbours are written, so that a node with very many edges can be split in the join
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-large-{step}")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, f"{name}-met-{step}")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small-{step}")
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, f"{name}-{step}")
        after = e.agg(mark.alias("m")).first()["m"]
        if after == before:
            break
        before, step = after, step + 1
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
