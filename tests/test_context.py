"""Retrieval by mode and graph editing on small tables, with cases the test tables don't hold."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import context, editing


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("a", "t", "first"), ("b", "t", None), ("c", "u", "")], "entity_id string, entity_type string, description string")
    edges = spark.createDataFrame([("a", "b", 2.0, "x"), ("b", "c", None, None)], "src string, tgt string, weight double, description string")
    return nodes, edges


def parts(spark, graph, mode, entity_hits, relation_hits=(), chunk_hits=(("k9", 1),)):
    nodes, edges = graph
    got = context.retrieve(
        mode,
        nodes=nodes,
        edges=edges,
        entity_sources=spark.createDataFrame([("a", "k1"), ("a", "k1"), ("b", "k2")], "entity_id string, chunk_id string"),
        relation_sources=spark.createDataFrame([("a", "b", "k1"), ("b", "c", "k3")], "src string, tgt string, chunk_id string"),
        chunks=spark.createDataFrame([("k1", "f", 1), ("k2", "f", 1), ("k3", None, 1), ("k9", "g", 1)], "chunk_id string, file_path string, tokens int"),
        entity_hits=spark.createDataFrame(list(entity_hits), "entity_id string, ord int"),
        relation_hits=spark.createDataFrame(list(relation_hits), "src string, tgt string, ord int"),
        chunk_hits=spark.createDataFrame(list(chunk_hits), "chunk_id string, ord int"),
    )
    rows = context.assembled(got).collect()
    return {p: [r.id for r in sorted(rows, key=lambda r: r.ord) if r.part == p] for p in ("entity", "relation", "chunk")}


def test_modes(spark, graph):
    assert parts(spark, graph, "local", [("a", 1), ("gone", 2)]) == {"entity": ["a"], "relation": ["a<SEP>b"], "chunk": ["k1"]}
    assert parts(spark, graph, "global", [], [("c", "b", 1)]) == {"entity": ["b", "c"], "relation": ["b<SEP>c"], "chunk": ["k2", "k3"]}
    assert parts(spark, graph, "mix", [("a", 1)])["chunk"] == ["k9", "k1"]
    assert parts(spark, graph, "naive", [("a", 1)]) == {"entity": [], "relation": [], "chunk": ["k9"]}


def test_nothing_found_gives_no_chunks(spark, graph):
    assert parts(spark, graph, "mix", []) == {"entity": [], "relation": [], "chunk": []}
    with pytest.raises(ValueError):
        parts(spark, graph, "other", [])


def test_similar_chunks(spark):
    owned = spark.createDataFrame([("a", 1, f"k{i}", i, 1) for i in range(8)], "owner string, ord int, chunk_id string, pos int, occurrences int")
    vectors = {f"k{i}": [math.cos(i), math.sin(i)] for i in range(8)}
    table = spark.createDataFrame(list(vectors.items()), "chunk_id string, embedding array<double>")
    got = [r.chunk_id for r in context.similar_chunks(owned, table, [1.0, 0.0], most=5).orderBy("ord").collect()]
    assert got == sorted(vectors, key=lambda k: -vectors[k][0])[:2]
    short = [r.chunk_id for r in context.similar_chunks(owned, table.filter("chunk_id <> 'k3'"), [1.0, 0.0], most=5).orderBy("ord").collect()]
    assert short == ["k0", "k1", "k2", "k3", "k4"]


def test_strategies(spark):
    rows = spark.createDataFrame(
        [("x", 1, "", 0.0, "b, a", "2"), ("x", 2, "one", 3.0, None, "10"), ("x", 3, "two", 1.0, "a", None), ("y", 1, None, None, " ,", "q")],
        "k string, o int, d string, w double, c string, t string",
    )
    how = {"d": "concatenate", "w": "max", "c": "join_unique_comma", "t": "max"}
    got = {r.k: (r.d, r.w, r.c, r.t) for r in editing.merged_attributes(rows, ["k"], ["o"], how).collect()}
    assert got == {"x": ("one<SEP>two", 3.0, "a,b", "10.0"), "y": (None, None, None, "q")}
    kept = editing.merged_attributes(rows, ["k"], ["o"], {"d": "keep_first", "w": "keep_last"}, keep_empty=True)
    assert {r.k: (r.d, r.w) for r in kept.collect()} == {"x": ("", 1.0), "y": (None, None)}


def test_changes_of_an_empty_graph(spark):
    nodes = spark.createDataFrame([], "entity_id string, entity_type string, description string")
    edges = spark.createDataFrame([], "src string, tgt string, weight double")
    renamed = spark.createDataFrame([("a", "b")], "old string, new string")
    assert [t.count() for t in editing.rename_entities(nodes, edges, renamed)] == [0, 0]
    assert editing.create_relations(nodes, edges, spark.createDataFrame([("a", "b", 1.0)], edges.schema)).count() == 0
    twice = spark.createDataFrame([("n", "t", "d"), ("n", "t", "d")], nodes.schema)
    assert editing.create_entities(nodes, twice).count() == 1


def test_sources_past_the_cap(spark):
    schema = "entity_id string, entity_type string, description string, source_id string, time int, place int"
    first = spark.createDataFrame([("e", "t", "one", "c1", 1, 1), ("e", "t", "longer", "c1", 1, 2), ("e", "u", "late", "c2", 2, 1)], schema)
    second = spark.createDataFrame([("e", "u", "new", "c3", 3, 1), ("f", "u", "other", "c3", 3, 2)], schema)
    state = editing.merge_into(None, None, first, 0, cap=1)
    nodes, tracking = editing.merge_into(*state, second, 1, cap=1)
    assert {r.entity_id: (r.entity_type, r.description) for r in nodes.collect()} == {"e": ("t", "longer<SEP>one"), "f": ("u", "other")}
    assert tracking.filter("entity_id = 'e'").count() == 3
    last = editing.sources(tracking, 1, "FIFO").filter(F.col("entity_id") == "e").first().source_id
    assert last == "c3"
