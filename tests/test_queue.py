"""The queue's states and the cache of calls, case by case."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import memo, queue

DOCS = "id string, file_path string, content string"


def states(store):
    return {r.id: (r.status, r.error, r.attempts, r.chunks) for r in store.read("status").collect()}


def test_states(spark, tmp_path):
    store = queue.queue_store(spark, f"file://{tmp_path}/q", 4)
    rows = [("a", "f", "x"), ("a", "f", "x"), ("b", "f", ""), ("c", None, "refuse"), ("n", "f", None), (None, "f", "x"), ("gone", "f", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    assert queue.arrive(store, docs) and not queue.arrive(store, docs)
    assert not queue.arrive(store, docs.limit(0))
    files = spark.createDataFrame([("p.pdf", "unreadable"), ("p.pdf", "unreadable"), ("p.pdf", "empty")], "file_path string, error string")
    assert queue.arrive_failed(store, files) and not queue.arrive_failed(store, files)
    seen = []

    def process(df):
        seen.append(sorted(r.id for r in df.collect()))
        assert {v[0] for k, v in states(store).items() if k in seen[-1]} == {"processing"}
        if len(seen) == 1:
            queue.arrive(store, spark.createDataFrame([("late", "f", "z")], DOCS))
        told = df.filter("id <> 'b'").select("id", F.lit(2).alias("chunks"), F.when(F.col("content") == "refuse", "refused").alias("error"))
        return told

    assert queue.work_off(store, process) == 2
    assert seen == [["a", "b", "c", "gone"], ["late"]]
    found = states(store)
    unread = {k: v for k, v in found.items() if k.startswith("error-")}
    assert sorted(v[:3] for v in unread.values()) == [("failed", "empty", 0), ("failed", "unreadable", 0)]
    assert {k: v for k, v in found.items() if k not in unread} == {
        "a": ("processed", None, 1, 2), "b": ("failed", "no result", 1, None), "c": ("failed", "refused", 1, None), "gone": ("processed", None, 1, 2), "late": ("processed", None, 1, 2)
    }
    assert queue.work_off(store, process) == 1 and seen[-1] == ["b", "c"]
    assert states(store)["c"] == ("failed", "refused", 2, None)


def test_run_that_dies(spark, tmp_path):
    store = queue.queue_store(spark, f"file://{tmp_path}/q", 4)
    queue.arrive(store, spark.createDataFrame([("a", "f", "x"), ("b", "f", "y")], DOCS))

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        queue.work_off(store, dies)
    assert {v[0] for v in states(store).values()} == {"processing"}
    store.commit(store.last_batch() + 1, {}, {"contents": spark.createDataFrame([("b",)], "id string")})
    assert queue.work_off(store, lambda df: df.select("id", F.lit(1).alias("chunks"), F.lit(None).cast("string").alias("error"))) == 1
    assert states(store) == {"a": ("processed", None, 1, 1)}
    assert queue.work_off(store, dies) == 0


def test_calls_are_made_once(spark, tmp_path):
    store = memo.answer_store(spark, f"file://{tmp_path}/m", 4)
    rows = [("mix:query:1", "one", "c1"), ("mix:query:1", "one", "c2"), ("mix:query:2", "two", "c1"), ("local:query:3", "three", None), ("mix:query:4", "fails", "c4"), (None, "none", "c5")]
    calls = spark.createDataFrame(rows, "call_key string, prompt string, chunk_id string").withColumn("hit", F.lit("clashes"))
    made = []

    def call(df):
        made.append(sorted(r.prompt for r in df.collect()))
        return df.select("call_key", F.when(F.col("prompt") != "fails", F.upper("prompt")).alias("output"))

    first = memo.answered(calls, store, call)
    assert made == [["fails", "one", "three", "two"]]
    assert sorted((r.prompt, r.output, r.hit) for r in first.collect() if r.output) == [("one", "ONE", False), ("one", "ONE", False), ("three", "THREE", False), ("two", "TWO", False)]
    assert sorted((r.prompt, r.hit) for r in first.collect() if not r.output) == [("fails", False), ("none", False)]
    again = memo.answered(calls.filter("prompt <> 'fails'"), store, call)
    assert len(made) == 1 and {r.hit for r in again.collect() if r.output} == {True}
    memo.answered(calls, store, call)
    assert made[1:] == [["fails"]]
    of_c1 = memo.calls_of_chunks(store, spark.createDataFrame([("c1",)], "chunk_id string"))
    assert sorted((r.call_key, r.output) for r in of_c1.collect()) == [("mix:query:1", "ONE"), ("mix:query:2", "TWO")]
    assert not memo.forget(store, ["naive"]) and memo.forget(store, ["mix"])
    assert [r.call_key for r in store.read("answers").collect()] == ["local:query:3"] and store.read("links").isEmpty()
    assert memo.answered(calls.limit(0), store, call).isEmpty()
    assert memo.forget(store) and store.read("answers").isEmpty()
