"""Connected components of an edge table: union-find forests, then contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import discard, lean, materialize

#: Edges of one local forest; more of them make another forest, as the later rounds join forests anyhow.
FOREST_EDGES = 200_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Union-find with path halving; the smaller id is the root. (node, root) for each node that is no root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    return nodes, [find(x) for x in nodes]


def _forests(batches):
    held, n = [], 0

    def out():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _forest(a, b)], names=["node", "root"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= FOREST_EDGES:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node that is not the smallest of its component.

    ``edges`` holds two long columns without nulls.  Every partition makes a
    union-find forest of its edges; then, round by round, a node that has several
    roots links them to the smallest, and every root is replaced by its own root,
    which halves the depth.  Rounds are written to the shared folder.  Each round
    is sums by node and a join on the node, so a component of any size is spread
    over the tasks.
    """
    a, b = edges.columns
    forest = materialize(edges.select(a, b).mapInArrow(lean(_forests), "node long, root long").distinct(), "forest")
    while True:
        least = materialize(forest.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")), "roots")
        up = least.select(F.col("node").alias("above"), F.col("least").alias("over"))
        open_ = least.where(F.col("least") != F.col("most")).limit(1).count() or least.join(up, F.col("least") == F.col("above"), "left_semi").limit(1).count()
        if not open_:
            discard(forest)
            return least.select("node", F.col("least").alias("root"))
        merged = forest.join(least.select("node", "least"), "node").where(F.col("root") != F.col("least")).select(F.col("root").alias("node"), F.col("least").alias("root"))
        merged = least.select("node", F.col("least").alias("root")).unionByName(merged)
        jumped = merged.join(up, F.col("root") == F.col("above"), "left").select("node", F.coalesce("over", "root").alias("root"))
        last = forest
        forest = materialize(jumped.where(F.col("node") != F.col("root")).mapInArrow(lean(_forests), "node long, root long").distinct(), "forest")
        discard(last, least)


def contract(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels (node, root) of the graph that had ``labels`` when ``edges`` join it."""
    if labels is not None:
        edges = labels.unionByName(edges.toDF("node", "root"))
    return connected_components(edges)
