"""Given graphs and renamed entities against plain Python, and what of their rows is dealt and sorted."""

import random

from graphloom.operators import editing


def test_only_last_rows_of_a_given_graph_meet_the_chunks(spark):
    r = random.Random(3)
    chunks = [(f"o{i}", f"chunk-{i}") for i in range(8)] + [("o0", "chunk-0")]
    at = list(range(400))
    r.shuffle(at)
    entities = [(f"s{r.randint(0, 5)}", r.choice("ANR"), f"o{r.randint(0, 11)}", a if i else None) for i, a in enumerate(at[:200])]
    relations = [(f"s{r.randint(0, 7)}", f"p{r.randint(0, 5)}", f"o{r.randint(0, 11)}", a) for a in at[200:]]
    nodes, edges = editing.custom_graph(
        spark.createDataFrame(chunks, "source_id string, chunk_id string"), spark.createDataFrame(entities, "entity_id string, entity_type string, source_id string, at int"),
        spark.createDataFrame(relations, "src string, tgt string, source_id string, at int"), ["at"],
    )
    of, last, pairs = dict(chunks), {}, {}
    for name, kind, source, _ in sorted(entities, key=lambda e: -1 if e[3] is None else e[3]):
        last[name] = (kind, of.get(source, "UNKNOWN"))
    for a, b, source, _ in sorted(relations, key=lambda e: e[3]):
        pairs[min(a, b), max(a, b)] = of.get(source, "UNKNOWN")
    for name in {n for p in pairs for n in p} - set(last):
        last[name] = ("UNKNOWN", min(s for p, s in pairs.items() if name in p))
    assert {(x.src, x.tgt): x.source_id for x in edges.collect()} == pairs
    assert {x.entity_id: (x.entity_type, x.source_id) for x in nodes.collect()} == last
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Join LeftOuter") < plan.index("max_by(")


def test_renamed_edges_are_sorted_once_to_be_merged(spark):
    r = random.Random(4)
    edges = sorted({(f"a{r.randint(0, 9)}", f"b{r.randint(0, 9)}") for _ in range(60)})
    rows = [(a, b, float(r.randint(1, 9)), i) for i, (a, b) in enumerate(edges, 1)]
    new = {f"b{i}": f"b{i + 1}" for i in range(0, 10, 2)} | {"a3": "b4"}
    nodes = spark.createDataFrame([(n, "x") for n in sorted({n for e in edges for n in e})], "entity_id string, entity_type string")
    renamed = spark.createDataFrame(list(new.items()), "old string, new string")
    found = editing.rename_entities(nodes, spark.createDataFrame(rows, "src string, tgt string, weight double, n int"), renamed)[1]
    groups = {}
    for a, b, w, n in rows:
        ends = tuple(sorted((new.get(a, a), new.get(b, b))))
        if ends[0] != ends[1]:
            groups.setdefault(ends, []).append((a, b, w, n))
    assert {(x.src, x.tgt): (x.weight, x.n) for x in found.collect()} == {k: (max(x[2] for x in g), min(g)[3]) for k, g in groups.items()}
    found = editing.rename_entities(nodes, spark.createDataFrame(rows, "src string, tgt string, weight double, n int"), renamed)[1]
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    merging = next(i for i, line in enumerate(plan) if "Exchange" in line)
    assert "REPARTITION" in plan[merging] and sum("Sort [" in line for line in plan[:merging]) == 1
