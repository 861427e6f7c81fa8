"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut

#: Links that one task joins at once; rounds over all machines come before, as long as there are more.
ONE_TASK = 20_000


def _roots(edges: DataFrame) -> DataFrame:
    """(v, p) of every vertex of at most ONE_TASK links: p is the smallest vertex reachable."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        if up:
            yield pa.RecordBatch.from_pydict({"v": pa.array(list(up), pa.int64()), "p": pa.array([root(x) for x in list(up)], pa.int64())})

    return edges.coalesce(1).mapInArrow(join, "v long, p long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has a link to another: component is the smallest id reachable.

    In each round every vertex takes the smallest vertex next to it as its parent (parents are
    smaller, so this is a forest); parents are doubled until each is a root, and the links are moved
    to the roots; links within one root and repeated links go. A tree has two vertices at least, so
    each round at least halves the vertices that still have links: both loops are logarithmic.
    The last ONE_TASK links are joined in a single task, as rounds cost more than they share out.
    Every table is cut into the checkpoint folder. Nulls and self-links are ignored.
    """
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = ids.withColumn("component", F.col("id"))
    while (left_over := edges.count()) > ONE_TASK:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        parent = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("p")))
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            doubled = cut(parent.join(up, "p").select("v", F.col("p").alias("was"), F.col("pp").alias("p")))
            parent = doubled.select("v", "p")
            if not doubled.where("was <> p").count():
                break
        left = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        labels = cut(_moved(labels, parent))
        edges = cut(moved)
    return cut(_moved(labels, _roots(edges))) if left_over else labels


def _moved(labels: DataFrame, parent: DataFrame) -> DataFrame:
    return labels.join(parent.select(F.col("v").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))


def add_links(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) of the links behind ``parts`` and further links (a, b): only these are gone through."""
    side = lambda x: parts.select(F.col("id").alias(x), F.col("component").alias(f"p{x}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    more = connected_components(between)
    new = more.join(parts.select("id"), "id", "left_anti")
    return cut(_moved(parts, more.select(F.col("id").alias("v"), F.col("component").alias("p"))).unionByName(new))
