"""Described blocks (images, tables, equations, others) as chunks, as main entities, and as what their documents list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_id, tokens
from .markers import numbered

# The texts of described blocks.
IMAGE_CHUNK = """
Image Content Analysis:
Image Path: %s
Captions: %s
Footnotes: %s

Visual Analysis: %s"""
TABLE_CHUNK = """Table Analysis:
Image Path: %s
Caption: %s
Structure: %s
Footnotes: %s

Analysis: %s"""
EQUATION_CHUNK = """Mathematical Equation Analysis:
Equation: %s
Format: %s

Mathematical Analysis: %s"""
OTHER_CHUNK = """%s Content Analysis:
Content: %s

Analysis: %s"""


def chunk_text(blocks: DataFrame) -> Column:
    """The chunk of a row ``type, img_path, captions, footnotes, body, text_format, description`` by its type; a null type is generic.

    ``captions`` and ``footnotes`` are arrays, told as ``None`` where null or empty; every other null is told as nothing.
    """
    told = lambda c: F.coalesce(blocks[c].cast("string"), F.lit(""))
    listed = lambda c: F.when(F.size(F.coalesce(blocks[c], F.array().cast("array<string>"))) > 0, F.array_join(blocks[c], ", ")).otherwise("None")
    kind = F.coalesce(blocks["type"], F.lit("generic"))
    return (
        F.when(kind == "image", F.format_string(IMAGE_CHUNK, told("img_path"), listed("captions"), listed("footnotes"), told("description")))
        .when(kind == "table", F.format_string(TABLE_CHUNK, told("img_path"), listed("captions"), told("body"), listed("footnotes"), told("description")))
        .when(kind == "equation", F.format_string(EQUATION_CHUNK, told("body"), told("text_format"), told("description")))
        .otherwise(F.format_string(OTHER_CHUNK, F.initcap(kind), told("body"), told("description")))
    )


def _last(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the one written last, by (document, order in it), nulls first."""
    order = F.struct(F.col("full_doc_id").isNotNull().alias("a"), "full_doc_id", F.col("chunk_order_index").isNotNull().alias("b"), "chunk_order_index", *(c for c in rows.columns if c not in (key, "full_doc_id", "chunk_order_index")))
    return rows.groupBy(key).agg(F.max(order).alias("m")).select(key, *(F.col("m")[c].alias(c) for c in rows.columns if c != key))


def _base(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def modal_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks of described blocks: ``chunk_id, content, tokens, full_doc_id, chunk_order_index, file_path, is_multimodal, modal_entity_name, original_type, page_idx``.

    ``blocks`` has what ``chunk_text`` reads, and ``full_doc_id, chunk_order_index, file_path, entity_name, page_idx``. Blocks with
    equal texts are one chunk, that of the last; copies are reduced before they are shuffled. A null page is 0. Other columns don't matter.
    """
    own = blocks.withColumn("_content", chunk_text(blocks)).select(
        hash_id("chunk-", F.col("_content")).alias("chunk_id"), F.col("_content").alias("content"), F.size(tokens(F.col("_content"))).alias("tokens"), "full_doc_id", "chunk_order_index",
        _base(F.col("file_path")).alias("file_path"), F.lit(True).alias("is_multimodal"), F.col("entity_name").alias("modal_entity_name"), F.coalesce("type", F.lit("generic")).alias("original_type"),
        F.coalesce("page_idx", F.lit(0)).alias("page_idx"),
    )
    return _last(own, "chunk_id")


def main_entities(blocks: DataFrame) -> DataFrame:
    """The entity that each described block stands for: ``entity_id, entity_name, entity_type, content, source_id, file_path``, the last one of a name.

    ``content`` is the summary, else the description; the type is the entity's, else the block's. Blocks without a name have none.
    """
    own = blocks.withColumn("_content", chunk_text(blocks)).filter("entity_name is not null").select(
        hash_id("ent-", F.col("entity_name")).alias("entity_id"), "entity_name", F.coalesce("entity_type", "type", F.lit("generic")).alias("entity_type"),
        F.coalesce("summary", "description").alias("content"), hash_id("chunk-", F.col("_content")).alias("source_id"), _base(F.col("file_path")).alias("file_path"), "full_doc_id", "chunk_order_index",
    )
    return _last(own, "entity_id").drop("full_doc_id", "chunk_order_index")


def appended_chunks(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The documents' lists of chunks as rows ``full_doc_id, chunk_id, place`` (from 1): those known, then new ones in their order.

    ``listed`` has such rows, ``chunks`` has ``full_doc_id, chunk_id, chunk_order_index``. A chunk that a document lists already isn't added
    again, one that comes twice has its first place. Lists are rows, numbered over ranges: no document's is gathered.
    """
    known = listed.select("full_doc_id", "chunk_id", "place")
    new = chunks.groupBy("full_doc_id", "chunk_id").agg(F.min("chunk_order_index").alias("at"))
    held = known.select(F.col("full_doc_id").alias("_doc"), F.col("chunk_id").alias("_chunk"))
    new = new.join(held, F.col("full_doc_id").eqNullSafe(F.col("_doc")) & (F.col("chunk_id") == F.col("_chunk")), "left_anti")
    own = numbered(new, ["full_doc_id"], ["at", "chunk_id"], "n")
    last = known.groupBy(F.col("full_doc_id").alias("_doc")).agg(F.max("place").alias("_last"))
    met = own.join(last, F.col("full_doc_id").eqNullSafe(F.col("_doc")), "left")
    return known.unionByName(met.select("full_doc_id", "chunk_id", (F.coalesce("_last", F.lit(0)) + F.col("n")).alias("place")))


def completion(status: DataFrame, listed: DataFrame, blocks: DataFrame, done: DataFrame) -> DataFrame:
    """``doc_id, status, chunks_count, multimodal_processed, fully_processed`` for each row ``doc_id, status``.

    ``done`` names the chunks (``full_doc_id, chunk_id``) of blocks that went through; a document whose blocks (``full_doc_id, chunk_id``)
    all did, or that has none, is ``multimodal_processed``, and ``fully_processed`` if its text is ``processed`` too.
    """
    counts = listed.groupBy(F.col("full_doc_id").alias("doc_id")).agg(F.count("*").alias("chunks_count"))
    left = blocks.join(done, ["full_doc_id", "chunk_id"], "left_anti").select(F.col("full_doc_id").alias("doc_id")).distinct().withColumn("_left", F.lit(True))
    both = status.select("doc_id", "status").join(counts, "doc_id", "left").join(left, "doc_id", "left")
    modal = F.col("_left").isNull()
    return both.select("doc_id", "status", F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"), modal.alias("multimodal_processed"), (modal & F.coalesce(F.col("status") == "processed", F.lit(False))).alias("fully_processed"))
