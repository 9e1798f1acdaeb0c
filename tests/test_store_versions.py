"""Commits write new rows beside older ones, rewrite only buckets whose keys change, and leave nothing of a merge behind."""

import os

from graphloom.operators import state
from graphloom.sources import shared

SCHEMA = state.SCHEMAS["chunks"]


def store_of(spark, ids, buckets=1):
    store = state.graph_store(spark, shared.fresh_path(spark, "store"), buckets)
    row = lambda text, *ids: spark.createDataFrame([(i, text, "p") for i in ids], SCHEMA)
    assert store.commit(0, {"chunks": row("old", *ids)})
    return store, row


def test_new_keys_leave_older_files(spark):
    store, row = store_of(spark, "abcdef")
    first = set(store.read("chunks").inputFiles())
    assert store.commit(1, {"chunks": row("new", "g", "h")})
    second = set(store.read("chunks").inputFiles())
    assert first < second and store.read("chunks").count() == 8
    assert store.commit(2, {"chunks": row("new", "i")}, new=("chunks",))
    assert second < set(store.read("chunks").inputFiles()) and store.read("chunks").count() == 9
    assert store.commit(3, {"chunks": row("newer", "a", "j")}, {"chunks": row("", "b", "h")})
    assert not second & set(store.read("chunks").inputFiles())
    assert {r.chunk_id: r.doc_id for r in store.read("chunks").collect()} == dict.fromkeys("cdef", "old") | dict.fromkeys("gi", "new") | dict.fromkeys("aj", "newer")


def test_versions_of_a_bucket_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(shared, "VERSIONS", 2)
    store, row = store_of(spark, "a")
    for batch, name in enumerate("bcde", 1):
        assert store.commit(batch, {"chunks": row("new", name)}, new=("chunks",) * (batch % 2))
        assert len(store._state()[2]["chunks"][0]) <= 2
    assert sorted(r.chunk_id for r in store.read("chunks").collect()) == list("abcde")


def test_scratch_tables_go(spark):
    with shared.scratch(spark):
        paths = shared.in_threads(lambda x: shared.written(spark.range(x), "t").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0], [3, 4])
        assert all(os.path.isdir(p) and "/scratch-" in p for p in paths)
    assert not any(os.path.exists(os.path.dirname(p)) for p in paths)
    assert "/scratch-" not in shared.fresh_path(spark, "t")
