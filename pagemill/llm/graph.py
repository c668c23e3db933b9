"""Connected components: union-find inside partitions, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialize


def union_find(a: list[int], b: list[int]) -> dict[int, int]:
    """The least node reachable from each node of the edges (a[i], b[i])."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges become one edge from every node to the least of its tree."""
    for batch in batches:
        roots = union_find(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        pairs = [(x, r) for x, r in roots.items() if x != r]
        columns = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the least node of each component, for the nodes of ``edges`` (a, b: long).

    Union-find over each Arrow batch leaves a forest. Then, until nothing changes, every node hands its
    least neighbour to its larger neighbours (large star), and each node's smaller neighbours are joined to
    the least of them (small star). Rounds grow with the logarithm of a component's diameter. Edges stay
    distributed; the driver learns a count and a checksum. Each round is written to the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = materialize(edges.distinct().mapInArrow(_forest, "a long, b long").distinct(), "forest")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = materialize(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == state:
            break
        state = (now.n, now.s)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
