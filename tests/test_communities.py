"""Communities by modularity against plain Python: the formula, all partitions of small graphs, planted groups, label propagation."""

import random

import pytest

from graphloom.operators import communities, graph
from graphloom.plans import catalog
from graphloom.sources import tables

EDGES = "src string, tgt string, weight double"


def plain(edges, labels):
    every = 2 * sum(w for *_, w in edges)
    inside, total = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            total[labels[x]] = total.get(labels[x], 0) + w
        if labels[a] == labels[b]:
            inside[labels[a]] = inside.get(labels[a], 0) + 2 * w
    return sum(inside.get(c, 0) / every - (t / every) ** 2 for c, t in total.items())


def partitions(names):
    if not names:
        yield {}
        return
    for rest in partitions(names[1:]):
        groups = sorted(set(rest.values()))
        for g in [*groups, len(groups)]:
            yield rest | {names[0]: g}


def one_by_one(edges, names):
    """Nodes move one after another in the order of their names, until none gains; then communities are the nodes."""
    label = {n: n for n in names}
    while True:
        graph = {}
        for a, b, w in edges:
            a, b = sorted((label[a], label[b]))
            graph[a, b] = graph.get((a, b), 0.0) + w
        every, near, k = 2 * sum(graph.values()), {}, {}
        for (a, b), w in graph.items():
            k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
            if a != b:
                near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
        own, total, moved = {n: n for n in k}, dict(k), True
        while moved:
            moved = False
            for n in sorted(k):
                weights = {own[n]: 0.0}
                for o, w in near.get(n, {}).items():
                    weights[own[o]] = weights.get(own[o], 0.0) + w
                gains = {c: w - k[n] * (total[c] - (k[n] if c == own[n] else 0)) / every for c, w in weights.items()}
                best = min(gains, key=lambda c: (-round(gains[c], 9), c != own[n], c))
                if best != own[n]:
                    total[own[n]] -= k[n]
                    total[best] += k[n]
                    own[n], moved = best, True
        if all(c == n for n, c in own.items()):
            return label
        label = {n: own.get(c, c) for n, c in label.items()}


def labels_of(df):
    rows = df.collect()
    found = {r.entity_id: r.label for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_small_graphs(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(8)]
    edges = [(a, b, float(r.randint(1, 4))) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < 0.4]
    used = sorted({n for e in edges for n in e[:2]})
    table = spark.createDataFrame(edges, EDGES)
    found = labels_of(communities.louvain(spark.createDataFrame([(n,) for n in names], "entity_id string"), table))
    assert set(found) == set(names) and all(found[found[n]] == found[n] for n in names)
    assert all(found[n] == n for n in set(names) - set(used))
    best = max(plain(edges, p) for p in partitions(used))
    assert plain(edges, found) >= best - 0.05 and plain(edges, found) >= plain(edges, {n: n for n in used})
    given = {n: f"g{i % 3}" for i, n in enumerate(used)}
    labelled = spark.createDataFrame(list(given.items()), "entity_id string, label string")
    assert communities.modularity(table, labelled) == pytest.approx(plain(edges, given))


def test_planted_groups_and_odd_rows(spark):
    r = random.Random(5)
    names = [f"v{i:02}" for i in range(48)]
    group = {n: i % 4 for i, n in enumerate(names)}
    edges = [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < (0.7 if group[a] == group[b] else 0.04)]
    odd = [(b, a, w) for a, b, w in edges[:9]] + [("v00", "v00", 1.0), ("v00", "x", 0.0), ("v01", "y", None), (None, "v02", 2.0), ("v03", "z", -1.0)]
    nodes = spark.createDataFrame([("alone",), ("alone",), (None,)], "entity_id string")
    found = labels_of(communities.louvain(nodes, spark.createDataFrame(edges + odd, EDGES)))
    assert {frozenset(n for n in names if found[n] == c) for c in {found[n] for n in names}} == {frozenset(n for n in names if group[n] == g) for g in range(4)}
    assert all(found[n] == n for n in ("alone", "x", "y", "z"))


def test_no_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    none = spark.createDataFrame([], EDGES)
    assert labels_of(communities.louvain(nodes, none)) == {"a": "a", "b": "b"}
    assert communities.modularity(none, nodes.withColumn("label", nodes.entity_id)) == 0.0


def test_against_label_propagation(spark):
    d = "/root/testdata/sf0.001"
    edges = tables.edges(spark, d)
    found = communities.modularity(edges, catalog.QUERIES["louvain_communities"](spark, d))
    rows = [(r.src, r.tgt, float(r.weight)) for r in edges.collect()]
    assert found >= communities.modularity(edges, graph.communities(edges))
    assert found >= 0.9 * plain(rows, one_by_one(rows, {n for e in rows for n in e[:2]}))


def test_rounds_tell_the_modularity(spark, monkeypatch):
    """Votes of a round say what the round before came by, so no round joins the graph to its labels again for that."""
    r = random.Random(9)
    edges = [(a, b, float(r.randint(1, 5))) for a in range(30) for b in range(a, 30) if r.random() < 0.3]
    labels = {n: r.randint(0, 4) for n in range(30)}
    graph_rows = spark.createDataFrame(edges, "src long, tgt long, weight double")
    names = communities._numbered(spark.createDataFrame([(f"n{n:02}",) for n in range(30)], "name string"))
    every = 2 * sum(w for *_, w in edges)
    numbers = {x.id: i for i, x in enumerate(names.orderBy("name").collect())}
    back = spark.createDataFrame([(i, n) for n, i in numbers.items()], "i long, n long")
    for side in ("src", "tgt"):
        graph_rows = graph_rows.join(back.withColumnsRenamed({"i": side, "n": "_n"}), side).drop(side).withColumnRenamed("_n", side)
    own = back.join(spark.createDataFrame(list(labels.items()), "i long, label long"), "i").selectExpr("n as node", "label")
    state = communities.strengths(graph_rows).join(names.selectExpr("id as node", "turns"), "node").join(own, "node")
    for turn in (1, 2):
        rows = communities._moves(communities._steps(graph_rows, names), state, every, turn, 1.0).collect()
        assert len(rows) == len({n for e in edges for n in e[:2]})
        within = sum(x.within for x in rows) + sum(w for a, b, w in edges if a == b)
        assert 2 * within / every - sum(x.beside for x in rows) / every**2 == pytest.approx(plain(edges, labels))
    monkeypatch.setattr(communities, "modularity", None)
    named = [(f"n{a:02}", f"n{b:02}", w) for a, b, w in edges]
    found = labels_of(communities.louvain(spark.createDataFrame([], "entity_id string"), spark.createDataFrame(named, EDGES)))
    assert plain(named, found) > plain(named, {n: n for n in found})
