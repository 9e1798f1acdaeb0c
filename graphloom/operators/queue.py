"""The queue of documents as a stored status table: pending, processing, then processed or failed with its error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import hash_id
from ..sources.shared import TableStore, written

TABLES = {
    "status": ("id string, file_path string, status string, error string, attempts int, chunks int", ["id"]),
    "contents": ("id string, content string", ["id"]),
}
NO_RESULT = "no result"


def queue_store(spark: SparkSession, root: str, buckets: int = 32) -> TableStore:
    return TableStore(spark, root, {t: (StructType.fromDDL(schema), key) for t, (schema, key) in TABLES.items()}, buckets)


def _status(rows: DataFrame, status: str) -> DataFrame:
    return rows.select("id", "file_path", F.lit(status).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("chunks"))


def arrive(store: TableStore, documents: DataFrame) -> bool:
    """New ``documents(id, file_path, content)`` wait as pending; known ids, null ids and null contents change nothing, of equal ids the least row counts."""
    rows = documents.filter("id is not null and content is not null").groupBy("id").agg(F.min(F.struct("file_path", "content")).alias("d")).select("id", "d.*")
    new = written(rows.join(store.read("status").select("id"), "id", "left_anti"), "arrived")
    if new.isEmpty():
        return False
    return store.commit(store.last_batch() + 1, {"status": _status(new, "pending"), "contents": new.select("id", "content")})


def arrive_failed(store: TableStore, files: DataFrame) -> bool:
    """``files(file_path, error)`` that couldn't be read, as failed rows named by what happened; without content they aren't tried again."""
    named = files.select(hash_id("error-", F.concat_ws("-", "file_path", "error")).alias("id"), "file_path", "error").dropDuplicates(["id"])
    new = written(named.join(store.read("status").select("id"), "id", "left_anti"), "unread")
    if new.isEmpty():
        return False
    return store.commit(store.last_batch() + 1, {"status": _status(new, "failed").drop("error").join(new.select("id", "error"), "id")})


def recover(store: TableStore) -> None:
    """Before a run: failed documents and those that a run left in processing wait again; rows that lost their content go, failed ones excepted."""
    status, contents = store.read("status"), store.read("contents").select("id", F.lit(True).alias("has"))
    met = written(status.filter("status <> 'processed'").join(contents, "id", "left").withColumn("has", F.coalesce("has", F.lit(False))), "open")
    again = met.filter("has and status <> 'pending'").withColumn("status", F.lit("pending")).drop("has")
    gone = met.filter("not has and status <> 'failed'").select("id")
    if not (again.isEmpty() and gone.isEmpty()):
        store.commit(store.last_batch() + 1, {"status": again}, {"status": gone})


def work_off(store: TableStore, process: Callable[[DataFrame], DataFrame]) -> int:
    """Works until nothing is pending, whatever arrives meanwhile; the number of rounds.

    ``process`` takes ``id, file_path, content`` and returns ``id, chunks, error`` (null: done); a document that it says nothing of has
    failed. What failed keeps its error and is tried by the next run, not by this one, so a run ends. A run that dies leaves its
    documents in processing, from where ``recover`` takes them. One run at a time works on a store.
    """
    recover(store)
    rounds = 0
    while True:
        waiting = written(store.read("status").filter("status = 'pending'"), "waiting")
        if waiting.isEmpty():
            return rounds
        store.commit(store.last_batch() + 1, {"status": waiting.withColumn("status", F.lit("processing"))})
        results = process(waiting.select("id", "file_path").join(store.read("contents"), "id"))
        told = written(results.groupBy("id").agg(F.max("error").alias("said"), F.sum("chunks").cast("int").alias("made"), F.lit(True).alias("told")), "results")
        error = F.when(F.col("told").isNull(), NO_RESULT).otherwise(F.col("said")).alias("error")
        done = waiting.drop("error", "chunks").join(told, "id", "left").withColumn("error", error).withColumn("attempts", F.col("attempts") + 1)
        done = done.withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("failed")).withColumn("chunks", F.when(F.col("error").isNull(), F.coalesce("made", F.lit(0))))
        store.commit(store.last_batch() + 1, {"status": written(done.select(*store.tables["status"][0].names), "done")})
        rounds += 1
