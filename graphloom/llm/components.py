"""Connected components over an edge table: local contraction, then rounds of pointer jumping and contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

HELD = 1_000_000  # edges that a task reads before it contracts what it holds


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge for each node but the smallest, which it leads to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Rows ``u, v`` with ``u > v`` that join the same nodes as those of ``edges`` (two columns of longs).

    Each task replaces the edges that it reads by stars, so a clique of n nodes leaves n - 1 edges a task
    and no node has more than one smaller neighbour from a task. A task holds a bounded number of edges
    besides one for each node it has met.
    """
    a, b = edges.columns

    def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = v = np.zeros(0, np.int64)
        waiting, n = [], 0
        for batch in batches:
            waiting.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
            n += len(batch)
            if n >= HELD + len(u):
                u, v = _forest(*(np.concatenate(x) for x in zip((u, v), *waiting, strict=True)))
                waiting, n = [], 0
        if waiting:
            u, v = _forest(*(np.concatenate(x) for x in zip((u, v), *waiting, strict=True)))
        yield pd.DataFrame({"u": u, "v": v})

    linked = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    return linked.mapInPandas(contract, "u long, v long")


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``node, root`` for every node that an edge touches; ``root`` is the smallest node reachable.

    Nodes are longs. Self-loops and nulls carry no link and are left out; an empty edge table gives an
    empty result. In a round each edge moves to the smallest neighbour of its smaller end, then the edges of
    a node meet in one task and are contracted; both only lower what nodes lead to, until all are stars.
    The table of smallest neighbours is written, so that Spark can split the join where a root is hot. Each
    round is a written table, so neither lineage nor driver memory grows with the graph.
    """
    now = written(contracted(edges.select(a, b)), "edges")
    while _unsettled(now):
        least = written(now.groupBy("u").agg(F.min("v").alias("m")), "least").withColumnRenamed("u", "v")
        moved = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        now = written(contracted(moved.repartition("u")), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
