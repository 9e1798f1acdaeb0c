"""Neighbourhoods of many starts against a search with a queue."""

import random

from graphloom.operators import graph


def plain(adjacent, start, depth, most):
    out, level, seen = [(start, 0)], [start], {start}
    for d in range(1, depth + 1):
        level = sorted({y for x in level for y in adjacent[x]} - seen, key=lambda y: (-len(adjacent[y]), y))
        if len(out) + len(level) > most:
            return out + [(x, d) for x in level[: most - len(out)]], True
        out, seen = out + [(x, d) for x in level], seen | set(level)
    return out, False


def test_neighbourhoods(spark):
    r = random.Random(1)
    names = [f"n{i}" for i in range(40)] + ["alone"]
    pairs = sorted({tuple(sorted(r.sample(names[:40], 2))) for _ in range(55)})
    adjacent = {n: {a if b == n else b for a, b in pairs if n in (a, b)} for n in names}
    nodes = spark.createDataFrame([(n,) for n in names], "entity_id string")
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, tgt string, weight double")
    starts = ["n0", "n1", "n2", "n2", "alone", "nobody"]
    for depth, most in ((3, 9), (2, 1000), (4, 1), (0, 5)):
        got = graph.neighbourhoods(nodes, edges, spark.createDataFrame([(s,) for s in starts], "entity_id string"), depth, most)
        want = {(s, x, d, i + 1, cut) for s in set(starts) - {"nobody"} for found, cut in [plain(adjacent, s, depth, most)] for i, (x, d) in enumerate(found)}
        rows = got.select("start", "entity_id", "depth", "place", "is_truncated").collect()
        assert {tuple(x) for x in rows} == want and len(rows) == len(want)
        inside = {(s, a, b) for s in set(starts) for a, b in pairs if {(s, a), (s, b)} <= {(x[0], x[1]) for x in want}}
        assert {(x.start, x.src, x.tgt) for x in graph.induced_by_start(edges, got).collect()} == inside


def test_only_the_first_neighbours_are_followed(spark, monkeypatch):
    """200 starts at 2 hubs of 400 nodes each: a level's rows follow ``max_nodes``, not the hubs' degrees; parallel edges take one place."""
    sizes = {}
    kept = graph.written

    def counted(df, label):
        out = kept(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(graph, "written", counted)
    pairs = [(f"h{h}", f"s{i}") for h in (0, 1) for i in range(200)] + [(f"h{h}", f"t{h}{i}") for h in (0, 1) for i in range(400)]
    pairs += [("h0", "t05")] * 3 + [("t00", "t01")]
    adjacent, degree = {}, {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            adjacent.setdefault(x, set()).add(y)
            degree[x] = degree.get(x, 0) + 1
    nodes = spark.createDataFrame([(n,) for n in adjacent], "entity_id string")
    starts = spark.createDataFrame([(f"s{i}",) for i in range(200)], "entity_id string")
    got = graph.neighbourhoods(nodes, spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, tgt string, weight double"), starts, 2, 9).collect()
    near = {n: sorted(adjacent[n], key=lambda y: (-degree[y], y)) for n in adjacent}
    for s in (f"s{i}" for i in range(200)):
        two = sorted((adjacent["h0"] | adjacent["h1"]) - {s, "h0", "h1"}, key=lambda y: (-degree[y], y))
        want = [(s, 0), *((x, 1) for x in near[s]), *((x, 2) for x in two)][:9]
        assert [(x.entity_id, x.depth) for x in sorted(got, key=lambda x: x.place) if x.start == s] == want
    assert all(x.is_truncated for x in got)
    assert max(n for label, n in sizes.items() if label != "steps") <= 10 * len(adjacent)


def test_one_step_follows_the_starts_only(spark, monkeypatch):
    kept = {}
    write = graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: kept.setdefault(label, write(df, label)))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(1, 9)], "src string, tgt string, weight double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(1, 10)], "entity_id string")
    got = graph.neighbourhoods(nodes, edges, spark.createDataFrame([("n3",)], "entity_id string"), 1, 5)
    assert [(x.entity_id, x.place) for x in got.orderBy("place").collect()] == [("n3", 1), ("n2", 2), ("n4", 3)]
    assert {x.node for x in kept["ways"].collect()} == {"n3"}
