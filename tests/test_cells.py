"""The index of cells against all rows compared."""

import numpy as np
import pytest

from graphloom.operators import cells
from graphloom.plans import catalog

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, queries, k, threshold=-1.0):
    def units(vs):
        kept = {i: np.array(v, dtype="float32").astype(float) for i, v in vs if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
        return {i: v / np.linalg.norm(v) for i, v in kept.items() if np.linalg.norm(v) > 0}

    held, out = units(rows), set()
    for q, v in units(queries).items():
        near = sorted((-round(float(v @ x), 6), i) for i, x in held.items())
        out |= {(q, i, n) for n, (s, i) in enumerate([x for x in near if -x[0] >= threshold][:k], 1)}
    return out


def found(df):
    return {(r.query_id, r.vec_id, r.ord) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    middles = r.normal(size=(12, 8))
    made = [(i, [float(x) for x in middles[i % 12] + r.normal(size=8) * 0.4]) for i in range(500)]
    copies = [(1000 + i, made[7][1]) for i in range(300)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0] * 7), (2004, [1.0] * 7 + [None]), (2005, [float("nan")] * 8), (2006, [float("inf")] * 8)]
    return made + copies + odd


def test_exact_and_recall(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    index = cells.build(table.filter("vec_id < 1100"), f"file://{tmp_path}/ix", most_cells=16, sample_rows=200, shard_rows=40)
    for _ in range(2):
        index.add(table.filter("vec_id >= 1100"), 1)
    assert index.vectors().count() == 800
    assert index.stats().agg({"shards": "max"}).first()[0] > 2
    asked = [x for x in rows if x[0] % 20 == 0 or x[0] == 2003]
    queries = spark.createDataFrame(asked, SCHEMA)
    for k, probes, threshold in ((10, 1, -1.0), (4, 3, 0.9), (900, 1, 0.2)):
        got = cells.search(index, queries, k, probes, exact=True, threshold=threshold, block_rows=7)
        assert found(got) == plain(rows, asked, k, threshold)
    exact = cells.search(index, queries, 10, 1, exact=True)
    p = cells.probes_for(index, queries, 10, 0.9)
    assert 1 <= p < len(index.centroids())
    assert cells.recall(cells.search(index, queries, 10, p).filter("query_id <> vec_id"), exact.filter("query_id <> vec_id")) >= 0.88


def test_one_direction_and_none(spark, tmp_path):
    one = spark.createDataFrame([(i, [float(i + 1), 0.0]) for i in range(5)], SCHEMA)
    index = cells.build(one, f"file://{tmp_path}/one")
    assert found(cells.search(index, one.filter("vec_id = 3"), 3)) == {(3, 0, 1), (3, 1, 2), (3, 2, 3)}
    none = cells.build(one.limit(0), f"file://{tmp_path}/none")
    none.add(one, 1)
    assert cells.search(none, one, 3, exact=True).count() == 0 and cells.probes_for(none, one) == 1
    assert cells.search(index, one.limit(0), 3, exact=True).count() == 0


def test_recall_on_embeddings(spark):
    d = "/root/testdata/sf0.01"
    exact, near = catalog.QUERIES["exact_search_by_cells"](spark, d), catalog.QUERIES["approximate_search_by_cells"](spark, d)
    assert cells.recall(near.filter("query_id <> vec_id"), exact.filter("query_id <> vec_id")) >= 0.9


def test_shards_give_no_more_than_can_enter(spark, tmp_path):
    """What lies under a query's ``least`` stays in its task, and ties are cut at ``k`` by id."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(20)]
    index = cells.build(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/least", most_cells=3, shard_rows=1000)
    units = {i: np.array(v, dtype="float32").astype(float) / np.linalg.norm(np.array(v, dtype="float32").astype(float)) for i, v in rows}
    least = {i: 0.1 * (i % 11) - 0.2 for i in units}
    probes = spark.createDataFrame([(i, [float(x) for x in v], float(least[i]), c) for i, v in units.items() for c in range(len(index.centroids()))], "query_id long, v array<double>, least double, cell int")
    got = {}
    for x in cells._scored(index, probes, 5, 6, 7).collect():
        got.setdefault(x.query_id, []).append((-x.similarity, x.vec_id))
    for q, v in units.items():
        best = sorted(x for x in ((-round(float(v @ u), 6), i) for i, u in units.items()) if -x[0] >= least[q])[:5]
        assert sorted(got.get(q, []))[:5] == best and all(-s >= least[q] for s, _ in got.get(q, []))
