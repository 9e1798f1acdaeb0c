"""The stored graph fed by a stream, and faults that lost rows."""

import test_state as plain
from pyspark.sql import functions as F

from graphloom.operators import retrieval, scoring, state
from graphloom.sources.shared import fresh_path
from graphloom.streaming import graph


def test_stream_equals_batches(spark, tmp_path):
    chunks, cache = plain.outputs(6)
    of = {c[0]: c for c in chunks}
    rows = [(*of[c], o, t) for c, o, t in cache]
    schema = "chunk_id string, doc_id string, file_path string, output string, time long"
    for i, part in enumerate((rows[:25], rows[25:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = state.graph_store(spark, f"file://{tmp_path}/graph", 4)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        graph.merge_stream(stream, store, str(tmp_path / "cp"), plain.rules(300, 100, "KEEP")).awaitTermination()
        assert store.last_batch() == i
    want = state.empty_graph(spark)
    for i, part in enumerate((rows[:25], rows[25:])):
        df = spark.createDataFrame(part, schema)
        records = state.cached_records(df.select("chunk_id", "output", "time"), df.select("chunk_id", "file_path").distinct())
        want = state.applied(want, state.merge_batch(want, *records, i, plain.rules(300, 100, "KEEP")))
    for name in ("nodes", "edges", "relation_chunks", "entity_texts"):
        assert sorted(map(tuple, store.read(name).collect())) == sorted(map(tuple, want[name].collect())), name
    assert not graph.merge_outputs(df, store, 1) and store.read("chunks").count() == len({r[0] for r in rows})


def test_budget_keeps_rows_without_tokens(spark):
    def kept(tokens, budget):
        rows = spark.createDataFrame(list(enumerate(tokens)), "ord int, tokens int").repartition(3)
        return [(r.ord, r.used) for r in retrieval.within_budget(rows, F.col("tokens"), budget).orderBy("ord").collect()]

    assert kept([0, 0, 0, 0, 0, 1, 1, 1, 1], 3) == [(i, max(0, i - 4)) for i in range(8)]
    assert kept([2, 0, None, 2, 0], 3) == [(0, 2), (1, 2), (2, 2)]
    assert kept([0, 5], 0) == [(0, 0)] and kept([5], 3) == [] and kept([0], -1) == [] and kept([1, 1], 9) == [(0, 1), (1, 2)]


def test_empty_lists(spark):
    none = F.array().cast("array<string>")
    got = spark.range(1).select(scoring.answer_score(none, none, F.lit("List")), scoring.answer_score(none, F.array(F.lit("a")), F.lit("List"))).first()
    assert tuple(got) == (1.0, 0.0)
