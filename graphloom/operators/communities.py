"""Communities by modularity: nodes move to the community that gains most, communities become the nodes of the next level.

Graphs are undirected ``edges(src, tgt, weight)``; parallel edges add up, a self loop counts twice in its node's strength.
Weights that are null or not above zero take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Gains are compared to so many digits, so that the order of sums decides nothing.
DIGITS = 9
#: Rounds after which the turns of nodes come again.
TURNS = 31


def _whole(edges: DataFrame) -> DataFrame:
    """One row a pair, ``src <= tgt``."""
    pair = edges.filter("weight > 0 and src is not null and tgt is not null").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.col("weight").cast("double").alias("weight"))
    return pair.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))


def strengths(edges: DataFrame) -> DataFrame:
    """``node, strength``: the weights that end at each node."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("strength"))


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of communities (``labels(entity_id, label)``): weights between two add up, those inside are its self loop."""
    side = lambda end: labels.select(F.col("entity_id").alias(end), F.col("label").alias(end + "_label"))
    both = _whole(edges).join(side("src"), "src").join(side("tgt"), "tgt")
    return _whole(both.select(F.col("src_label").alias("src"), F.col("tgt_label").alias("tgt"), "weight"))


def modularity_parts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, inside, total, part``: what each community adds to the modularity; ``inside`` and ``total`` count a weight from both ends."""
    small = contracted(edges, labels)
    ends = small.select("weight", F.explode(F.array("src", "tgt")).alias("label"), (F.col("src") == F.col("tgt")).alias("loop"))
    sums = ends.groupBy("label").agg(F.sum(F.when(F.col("loop"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    every = sums.agg(F.sum("total").alias("every"))
    return sums.crossJoin(F.broadcast(every)).select("label", "inside", "total", (F.col("inside") / F.col("every") - F.pow(F.col("total") / F.col("every"), 2)).alias("part"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    return modularity_parts(edges, labels).agg(F.sum("part")).first()[0] or 0.0


def _steps(graph: DataFrame, names: DataFrame) -> DataFrame:
    """``node, other, weight, turns``: each edge but self loops from either end, kept by ``other`` so that rounds don't deal it again."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other"), "weight"), F.struct(F.col("tgt").alias("node"), F.col("src").alias("other"), "weight"))
    steps = graph.filter("src <> tgt").select(F.explode(ends).alias("s")).select("s.*")
    turns = names.select(F.col("id").alias("node"), "turns").hint("shuffle_hash")
    return steps.join(turns, "node").repartition(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), "other").persist()


def _moves(steps: DataFrame, state: DataFrame, every: float, turn: int, resolution: float) -> DataFrame:
    """``state(node, label, strength, turns, within, beside)`` after the nodes whose turn it is went where they gain most.

    Nodes take turns by a hash of their name and the round, so two that want each other's community don't both move, which
    would swap them for ever. Ties go to the smaller label, and to staying before moving. Edges tell the nodes whose turn it is
    of their neighbours' labels, an edge without such a node tells its first end. Of the communities before the moves, ``within``
    sums up to the weight inside them, and ``beside`` to the squares of their strengths.
    """
    its = lambda turns: F.getbit(turns, F.lit(turn % TURNS)) == 1
    totals = state.groupBy("label").agg(F.sum("strength").alias("total"))
    state = written(state.select("node", "label", "strength", "turns").join(totals, "label"), f"totals-{turn}")
    at = state.select(F.col("node").alias("other"), "label", "total", its(F.col("turns")).alias("both")).hint("shuffle_hash")
    told = steps.join(at, "other").withColumn("mine", its(F.col("turns"))).filter(F.col("mine") | (~F.col("both") & (F.col("node") < F.col("other"))))
    none, its_own = F.lit(None).cast("double"), F.when(F.col("mine") & F.col("both"), F.col("weight") / 2).otherwise(F.col("weight"))
    votes = told.select("node", "label", "total", "weight", its_own.alias("once"), none.alias("strength"), F.lit(0).cast("long").alias("turns"))
    stay = state.select("node", "label", "total", F.lit(0.0).alias("weight"), F.lit(0.0).alias("once"), "strength", "turns")
    offers = votes.unionByName(stay).repartition("node").sortWithinPartitions("node")
    return offers.mapInArrow(_chosen(every, turn % TURNS, resolution), "node long, label long, strength double, turns long, within double, beside double")


def _chosen(every: float, turn: int, resolution: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``_moves`` makes of votes and one row of its own for each node (with ``strength``), which come by node as a stream.

    A node's votes are added up by label; only those of a batch's last node, so far, are held until the next.
    """

    def added(node, label, total, weight, once, strength, turns):
        order = np.lexsort((label, node))
        node, label = node[order], label[order]
        at = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (label[1:] != label[:-1])])
        most = (np.maximum.reduceat(total[order], at), np.add.reduceat(weight[order], at), np.add.reduceat(once[order], at))
        return [node[at], label[at], *most, np.fmax.reduceat(strength[order], at), np.maximum.reduceat(turns[order], at)]

    def moved(node, label, total, weight, once, strength, turns):
        at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        home, size = ~np.isnan(strength), np.diff(np.r_[at, len(node)])
        own, turns = np.fmax.reduceat(strength, at), np.maximum.reduceat(turns, at)
        strong = np.repeat(own, size)
        gain = np.round(weight - resolution * strong * (total - np.where(home, strong, 0.0)) / every, DIGITS)
        gain = np.where(home | (np.repeat(turns >> turn & 1, size) == 1), gain, -np.inf)
        best = gain == np.repeat(np.maximum.reduceat(gain, at), size)
        # numbers of labels aren't negative: -1 is to stay
        to = np.minimum.reduceat(np.where(best, np.where(home, -1, label), np.iinfo(np.int64).max), at)
        columns = (node[at], np.where(to < 0, label[home], to), own, turns, once[home], own * total[home])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "label", "strength", "turns", "within", "beside"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            rows = added(*(rows if held is None else map(np.concatenate, zip(held, rows, strict=True))))
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [c[last:] for c in rows]
            if last:
                yield moved(*(c[:last] for c in rows))
        if held is not None:
            yield moved(*held)

    return choose


def _level(graph: DataFrame, names: DataFrame, every: float, rounds: int, gain: float, resolution: float) -> tuple[DataFrame, int]:
    """The best labels of ``graph``'s nodes that the rounds came by, and the number of communities.

    A round's votes say what modularity the round before had come by, so no join is made for that alone.
    """
    steps = _steps(graph, names)
    loops = graph.filter("src = tgt").agg(F.sum("weight")).first()[0] or 0.0
    state = strengths(graph).join(names.select(F.col("id").alias("node"), "turns"), "node").withColumn("label", F.col("node"))
    state = written(state, "community-0")
    best, reached, still = state, float("-inf"), 0
    for turn in range(1, rounds + 2):
        after = written(_moves(steps, state, every, turn, resolution), f"community-{turn}")
        sums = after.agg(F.sum("within").alias("within"), F.sum("beside").alias("beside")).first()
        found = 2.0 * (sums.within + loops) / every - sums.beside / every**2
        still = still + 1 if found < reached + gain else 0
        if found > reached:
            best, reached = state, found
        if still == 3:
            break
        state = after
    steps.unpersist()
    return best.select(F.col("node").alias("entity_id"), "label"), best.select("label").distinct().count()


def _numbered(names: DataFrame) -> DataFrame:
    """``id, name, turns``: numbers in the order of the names, so that ties stay ties of names, and a bit for each round's turn."""
    turns = [F.when(F.pmod(F.xxhash64("name", F.lit(turn)), F.lit(2)) == 0, F.lit(1 << turn % TURNS).cast("long")).otherwise(F.lit(0).cast("long")) for turn in range(1, TURNS + 1)]
    placed = names.repartitionByRange("name").sortWithinPartitions("name").select(F.monotonically_increasing_id().alias("id"), "name")
    return written(placed.withColumn("turns", reduce(lambda a, b: a.bitwiseOR(b), turns)), "names")


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 10, rounds: int = 16, gain: float = 1e-6, resolution: float = 1.0) -> DataFrame:
    """``entity_id, label`` for every node and every end of an edge; a community has the name of one of its nodes, a lone node its own.

    Within a level nodes move in rounds until three of them gain less than ``gain``; then communities are contracted and move as
    nodes, until a level joins none. Each round is a written table, so lineage stays short and a lost executor costs one round.
    Repeated nodes count once, null ones not at all.
    """
    edges = written(edges.select("src", "tgt", "weight"), "edges")
    names = _numbered(nodes.select(F.col("entity_id").alias("name")).union(edges.select(F.explode(F.array("src", "tgt")))).filter("name is not null").distinct())
    numbered = edges
    for side in ("src", "tgt"):
        numbered = numbered.join(names.select(F.col("name").alias(side), F.col("id").alias(side + "_id")).hint("shuffle_hash"), side)
    graph = written(_whole(numbered.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), "weight")), "graph")
    every = 2.0 * (graph.agg(F.sum("weight")).first()[0] or 0.0)
    held = names.select("id", F.col("id").alias("label"))
    if every:
        size = strengths(graph).count()
        for level in range(levels):
            found, communities = _level(graph, names, every, rounds, gain, resolution)
            if communities == size:
                break
            up = found.select(F.col("entity_id").alias("label"), F.col("label").alias("upper"))
            held = written(held.join(up, "label", "left").select("id", F.coalesce("upper", "label").alias("label")), f"labels-{level}")
            graph, size = written(contracted(graph, found), f"graph-{level}"), communities
    label = names.select(F.col("id").alias("label"), F.col("name").alias("named"))
    return held.join(names, "id").join(label, "label").select(F.col("name").alias("entity_id"), F.col("named").alias("label"))
