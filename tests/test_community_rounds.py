"""A round of moves: votes are dealt once and added up as a stream, however the rows of a node fall into batches."""

import random

import numpy as np
import pyarrow as pa

from graphloom.operators import communities
from pyspark.sql import functions as F

NAMES = ["node", "label", "total", "weight", "once", "strength", "turns"]


def test_a_round_sorts_no_votes_to_group_them(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 0.5), (2, 3, 1.0)], "src long, tgt long, weight double")
    names = spark.range(4).withColumn("turns", F.lit(2**31 - 1).cast("long"))
    state = communities.strengths(edges).join(names.withColumnRenamed("id", "node"), "node").withColumn("label", F.col("node"))
    steps = communities._steps(edges, names)
    moved = communities._moves(steps, state, 9.0, 1, 1.0)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and moved.count() == 4
    got = {r.node: r for r in moved.collect()}
    assert [round(got[i].within, 6) for i in range(4)] == [0.0] * 4 and sum(r.beside for r in got.values()) == sum(x**2 for x in (1.5, 3.0, 3.5, 1.0))
    steps.unpersist()


def test_batches_decide_nothing():
    r = random.Random(1)
    rows = []
    for node in range(40):
        rows += [(node, label, 10.0 + label, r.randrange(1, 9) / 2, 0.5, np.nan, 0) for label in r.choices(range(40), k=400 if node == 7 else r.randrange(6))]
        rows.append((node, node, 10.0 + node, 0.0, 0.0, 1.0 + node % 3, r.getrandbits(31)))
        last = rows[-(1 + sum(x[0] == node for x in rows[:-1])):]
        r.shuffle(last)
        rows[-len(last):] = last

    def run(size):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*p, strict=True)], names=NAMES) for p in parts)
        return [x for b in communities._chosen(500.0, 3, 1.0)(batches) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    whole = run(len(rows))
    assert [x[0] for x in whole] == list(range(40)) and any(x[1] != x[0] for x in whole)
    for node, label, strength, turns, *_ in whole:
        mine = [x for x in rows if x[0] == node]
        own = next(x for x in mine if not np.isnan(x[5]))
        gains = {k: round(sum(x[3] for x in mine if x[1] == k) - strength * (10.0 + k - (strength if k == node else 0.0)) / 500.0, 9) for k in {x[1] for x in mine}}
        want = min(gains, key=lambda k: (-gains[k], k != node, k)) if turns >> 3 & 1 else node
        assert (label, strength, turns) == (want, own[5], own[6])
    assert all(run(size) == whole for size in (1, 3, 50, 399))
