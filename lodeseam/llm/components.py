"""Connected components by union-find in tasks, reconciled in rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseam.llm import frames


def _forests(batches):
    """(node, root) of each node in this partition's edges; a root is the smallest node of its tree."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for low in range(0, len(nodes), 100_000):
        part = nodes[low : low + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of longs): root is the smallest node that it reaches.

    Each round, every task contracts its own edges by union-find; nodes to which two tasks
    gave different roots make the edges of the next round.  Edges are dealt by both ends, so
    that a node with many of them is not in one task: what a task holds is its share of the
    edges, and the rounds are logarithmic in the longest path.
    """
    a, b = edges.columns
    current = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    levels = []
    while True:
        local = frames.stored(current.repartition("a", "b").mapInArrow(_forests, "node long, root long"), "forest")
        best = local.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        levels.append(best.select("node", "root"))
        clashes = best.where("root <> other").select("node", F.col("root").alias("best"))
        current = local.join(clashes, "node").where("root <> best").select(F.col("root").alias("a"), F.col("best").alias("b")).distinct()
        current = frames.stored(current, "clashes")
        if current.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        step = level.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        out = out.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return out
