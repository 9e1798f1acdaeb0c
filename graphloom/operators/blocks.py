"""Typed content blocks: context windows, templates, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import block_text, hash_id


def separated_text(blocks: DataFrame) -> DataFrame:
    """Per document the text of its text blocks, in order, and how many other blocks it has."""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("ord", "text")))), lambda b: b["text"]), lambda t: F.trim(t) != "")
    return blocks.groupBy("doc").agg(F.array_join(texts, "\n\n").alias("text"), F.count_if(F.col("type") != "text").alias("others"))


def neighbours(blocks: DataFrame, width: int) -> DataFrame:
    """Each block with the text of the ``width`` blocks on either side."""
    doc = Window.partitionBy("doc").orderBy("ord")
    line = block_text(F.col("type"), F.col("text"), F.col("text_level"))
    before = F.collect_list(line).over(doc.rowsBetween(-width, -1))
    after = F.collect_list(line).over(doc.rowsBetween(1, width))
    return blocks.withColumn("context", F.array_join(F.concat(before, after), "\n"))


def page_context(blocks: DataFrame, width: int) -> DataFrame:
    """Each page with the number and size of the blocks on it and on ``width`` pages around."""
    near = Window.partitionBy("doc").orderBy("page_idx").rangeBetween(-width, width)
    pages = blocks.groupBy("doc", "page_idx").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return pages.select("doc", "page_idx", F.sum("n").over(near).alias("context_blocks"), F.sum("chars").over(near).alias("context_chars"))


def content_id(blocks: DataFrame) -> DataFrame:
    """Content-based document id: the MD5 of the blocks' signatures, one a line."""
    signature = F.concat(F.col("type"), F.lit(":"), F.trim("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", signature.alias("s")))), lambda b: b["s"])
    return blocks.groupBy("doc").agg(hash_id("doc-", F.array_join(lines, "\n")).alias("doc_id"))


def belongs_to(entities: DataFrame, mains: DataFrame) -> DataFrame:
    """Relations of weight 10 from the entities of a block's chunk to the block's main entity."""
    met = entities.join(mains, "chunk_id").filter("entity_id <> main_entity").distinct()
    return met.select(F.least("entity_id", "main_entity").alias("src"), F.greatest("entity_id", "main_entity").alias("tgt"), F.lit("belongs_to,part_of,contained_in").alias("keywords"), F.lit(10.0).alias("weight"), F.col("chunk_id").alias("source_id"))
