"""Documents and key-value tables: enqueueing, status, lookups, deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_id, sanitize, summary

# The states of a document.
STATES = ("pending", "processing", "preprocessed", "processed", "failed")


def enqueue(texts: DataFrame, order: str) -> DataFrame:
    """New documents from ``text, source``: cleaned, first of equal texts, content-addressed, pending."""
    clean = texts.withColumn("content", sanitize(F.col("text"))).filter("content <> ''")
    digest = clean.withColumn("id", hash_id("doc-", F.col("content")))
    firsts = digest.groupBy("id").agg(F.min_by(F.struct("content", F.coalesce("source", F.lit("unknown_source")).alias("file_path")), order).alias("d"))
    return firsts.select("id", F.col("d.file_path").alias("file_path"), F.length("d.content").alias("content_length"), summary(F.col("d.content")).alias("content_summary"), F.lit("pending").alias("status"))


def new_keys(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return rows.join(stored.select(key), key, "left_anti")


def by_ids(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows in the order of ``ids`` (``ord``), nulls for misses."""
    return ids.join(table, key, "left")


def last_write(rows: DataFrame, key: str, time: list[str]) -> DataFrame:
    """One row per key: the latest values, ``create_time`` of the first write and ``update_time`` of the last."""
    order = F.struct(*time)
    values = [c for c in rows.columns if c not in (key, *time)]
    return rows.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in values), F.min(time[0]).alias("create_time"), F.max(time[0]).alias("update_time"))


def status_counts(rows: DataFrame) -> DataFrame:
    """Counts of all states, zero where there are none, and of ``all``."""
    spark = rows.sparkSession
    states = spark.createDataFrame([(s,) for s in STATES], "status string")
    counts = states.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.unionByName(counts.agg(F.sum("n").alias("n")).select(F.lit("all").alias("status"), "n"))


def page(rows: DataFrame, sort: str, number: int, size: int, descending: bool = True, allowed: tuple[str, ...] = ("create_time", "update_time", "id")) -> DataFrame:
    """A page of rows with the total; sizes are held to 10 .. 200 and unknown sort fields to the first allowed."""
    size, field = min(200, max(10, size)), sort if sort in allowed else allowed[0]
    order = [F.desc(field) if descending else F.asc(field), F.asc("id")]
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def consistency(status: DataFrame, contents: DataFrame) -> DataFrame:
    """What becomes of each status row: without content it is kept if failed, else deleted; with content,
    interrupted and failed ones go back to pending."""
    met = status.join(contents.select("id").withColumn("has", F.lit(True)), "id", "left")
    action = F.when(F.col("has").isNull(), F.when(F.col("status") == "failed", "keep").otherwise("delete")).when(F.col("status").isin("processing", "failed"), "pending").otherwise("keep")
    return met.select("id", "status", action.alias("action"))


def deletion_impact(tracking: DataFrame, gone: DataFrame) -> DataFrame:
    """Per key of ``tracking(key, chunk_id)``: delete, rebuild or unchanged when the chunks in ``gone`` go."""
    met = tracking.join(gone.select("chunk_id").distinct().withColumn("hit", F.lit(1)), "chunk_id", "left")
    n = met.groupBy("key").agg(F.count("*").alias("chunks"), F.count("hit").alias("lost"))
    return n.select("key", "chunks", "lost", F.when(F.col("lost") == 0, "unchanged").when(F.col("lost") == F.col("chunks"), "delete").otherwise("rebuild").alias("action"))


def cached_for_chunks(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached extractions of chunks (a row of ``chunk_id, cache_id`` for each), in order of creation within a chunk."""
    found = chunks.join(cache.filter("cache_type = 'extract'"), "cache_id")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy("create_time", "cache_id"))).withColumn("earliest", F.min("create_time").over(Window.partitionBy("chunk_id")))


def derived_status(rows: DataFrame) -> DataFrame:
    """Processed documents whose multimodal part is known not to be done are ``preprocessed``."""
    waits = (F.col("status") == "processed") & ~F.coalesce("multimodal_processed", F.lit(True))
    return rows.withColumn("status", F.when(waits, "preprocessed").otherwise(F.col("status")))


def counts_by_document(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc, entities, relations``: distinct names and pairs of each document, through ``chunks(chunk_id, doc)``."""
    of = chunks.withColumnRenamed("chunk_id", "source_id")
    names = entities.join(of, "source_id").groupBy("doc").agg(F.count_distinct("entity_id").alias("entities"))
    pair = F.struct(F.least("src", "tgt"), F.greatest("src", "tgt"))
    pairs = relations.join(of, "source_id").groupBy("doc").agg(F.count_distinct(pair).alias("relations"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(pairs, "doc", "full").select("doc", none("entities"), none("relations"))
