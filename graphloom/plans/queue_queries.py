"""The queue and the cache of calls over whole tables, with the SQL of what is left in the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cache_key, tokens
from ..operators import memo, queue
from ..sources.shared import fresh_path
from ..sources.tables import read
from .catalog import query


@query(r"""WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL)
SELECT 'd' || doc_id AS id, source AS file_path, CASE WHEN doc_id % 21 = 0 OR n % 50 = 1 THEN 'failed' ELSE 'processed' END AS status,
 CASE WHEN n % 50 = 1 THEN 'no result' WHEN doc_id % 21 = 0 THEN 'refused' END AS error,
 CAST(CASE WHEN n % 50 = 1 OR doc_id % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
 CASE WHEN doc_id % 21 <> 0 AND n % 50 <> 1 THEN CAST(ceil(n / 100) AS INTEGER) END AS chunks FROM d
UNION ALL SELECT 'error-' || md5('p' || page_id || '-unreadable'), 'p' || page_id, 'failed', 'unreadable', 0, NULL FROM pages""")
def final_states_of_queue(spark, d):
    """Half the documents arrive while the others are worked on; every seventh is refused at first, every 21st for good; a second run tries again."""
    store = queue.queue_store(spark, fresh_path(spark, "queue"), 8)
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("file_path"), F.col("text").alias("content"))
    queue.arrive(store, docs.filter("doc_id % 2 = 0"))
    queue.arrive_failed(store, read(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("file_path"), F.lit("unreadable").alias("error")))

    def work(refused: int, more=None):
        def process(rows):
            if more is not None:
                queue.arrive(store, more)
            number = F.substring("id", 2, 20).cast("long")
            sized = rows.select("id", number.alias("n"), F.size(tokens(F.col("content"))).alias("words")).filter("words % 50 <> 1")
            return sized.select("id", F.ceil(F.col("words") / 100).cast("int").alias("chunks"), F.when(F.col("n") % refused == 0, "refused").alias("error"))

        return process

    queue.work_off(store, work(7, docs))
    queue.work_off(store, work(21))
    return store.read("status")


@query("""WITH c AS (SELECT *, coalesce(event_type, '') || ' ' || user_id AS prompt FROM events),
 first AS (SELECT DISTINCT prompt FROM c WHERE event_id % 3 = 0 AND user_id % 5 <> 0)
SELECT event_id, 'mix:query:' || md5(prompt) AS call_key, CASE WHEN user_id % 5 <> 0 THEN upper(prompt) END AS output,
 prompt IN (SELECT prompt FROM first) AS hit FROM c""")
def answers_remembered(spark, d):
    """A third of the events asks first; then all ask, and what was answered is read from the cache. Some calls always fail."""
    store = memo.answer_store(spark, fresh_path(spark, "answers"), 8)
    prompt = F.concat_ws(" ", F.coalesce("event_type", F.lit("")), "user_id")
    calls = read(spark, d, "events").select("event_id", cache_key(F.lit("mix"), F.lit("query"), prompt).alias("call_key"), prompt.alias("prompt"), F.col("user_id").cast("string").alias("chunk_id"))
    call = lambda rows: rows.select("call_key", F.when(~F.col("prompt").rlike("[05]$"), F.upper("prompt")).alias("output"))
    memo.answered(calls.filter("event_id % 3 = 0"), store, call)
    return memo.answered(calls, store, call).select("event_id", "call_key", "output", "hit")
