"""Calls of a model remembered: a question asked before is answered from the cache, only the others are put to the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import TableStore, in_threads, written

TABLES = {
    "answers": ("call_key string, prompt string, output string, time long", ["call_key"]),
    "links": ("chunk_id string, call_key string", ["chunk_id", "call_key"]),
}


def answer_store(spark: SparkSession, root: str, buckets: int = 32) -> TableStore:
    return TableStore(spark, root, {t: (StructType.fromDDL(schema), key) for t, (schema, key) in TABLES.items()}, buckets)


def answered(calls: DataFrame, store: TableStore, call: Callable[[DataFrame], DataFrame], time: int = 0) -> DataFrame:
    """``calls(call_key, prompt, chunk_id, ...)`` with ``output`` and ``hit``; what the cache lacks is called for once, however often it is asked.

    ``call`` takes ``call_key, prompt`` and returns ``call_key, output``. Null outputs are failures: they aren't kept, so the next
    run asks again. Answers and the chunks that asked (null ``chunk_id``: none) are committed together. Of equal keys the least
    prompt is asked; a null key is never asked nor kept, its output is null. ``hit`` says that the answer was there before.
    """
    calls = written(calls.drop("output", "hit"), "calls")
    known = store.read("answers")
    wanted = calls.filter("call_key is not null").groupBy("call_key").agg(F.min("prompt").alias("prompt"))
    misses = written(wanted.join(known.select("call_key"), "call_key", "left_anti"), "misses")
    answers = known.select("call_key", "output", F.lit(True).alias("hit"))
    new = store.spark.createDataFrame([], TABLES["answers"][0])
    if not misses.isEmpty():
        made = call(misses).filter("output is not null").groupBy("call_key").agg(F.min("output").alias("output"))
        new = written(misses.join(made, "call_key").select("call_key", "prompt", "output", F.lit(time).cast("long").alias("time")), "answers")
        answers = answers.unionByName(new.select("call_key", "output", F.lit(False).alias("hit")))
    out = written(calls.join(answers, "call_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).select(*calls.columns, "output", "hit"), "answered")
    asked = out.filter("output is not null and chunk_id is not null").select("chunk_id", "call_key").distinct()
    links = written(asked.join(store.read("links"), ["chunk_id", "call_key"], "left_anti"), "links")
    if not (new.isEmpty() and links.isEmpty()):
        store.commit(store.last_batch() + 1, {"answers": new, "links": links})
    return out


def calls_of_chunks(store: TableStore, chunks: DataFrame) -> DataFrame:
    """``chunk_id, call_key, output, time`` of the calls that ``chunks(chunk_id)`` asked for, as a rebuild reads them."""
    links = store.read("links").join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return links.join(store.read("answers").drop("prompt"), "call_key").select("chunk_id", "call_key", "output", "time")


def forget(store: TableStore, modes: list[str] | None = None) -> bool:
    """Answers whose key begins with one of ``modes`` go with their links, or all of them; False where there were none."""
    kept = F.lit(True) if modes is None else F.split_part("call_key", F.lit(":"), F.lit(1)).isin(modes)
    gone = dict(zip(TABLES, in_threads(lambda t: written(store.read(t).filter(kept), "gone"), list(TABLES)), strict=True))
    if gone["answers"].isEmpty():
        return False
    return store.commit(store.last_batch() + 1, {}, gone)
