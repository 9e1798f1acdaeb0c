"""Evidence of relations: which chunks, documents and modalities they come from, and filters on that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def records(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """``src, tgt, evidence_total_count, evidence_doc_count, modality, by_modality`` from relations with a
    ``source_id`` and chunks with ``chunk_id, doc_id, modality``; each chunk counts once per pair.
    """
    met = relations.select("src", "tgt", F.col("source_id").alias("chunk_id")).distinct().join(chunks.select("chunk_id", "doc_id", "modality"), "chunk_id")
    # distinct documents are counted in two steps, so that no list of them is held; a pair has a row per modality then
    per = met.groupBy("src", "tgt", "doc_id", "modality").agg(F.count("*").alias("n"))
    first = F.min("modality").over(Window.partitionBy("src", "tgt", "doc_id")) == F.col("modality")
    per = per.withColumn("first", first).groupBy("src", "tgt", "modality").agg(F.sum("n").alias("n"), F.count_if("first").alias("docs"))
    return per.groupBy("src", "tgt").agg(
        F.sum("n").alias("evidence_total_count"), F.sum("docs").cast("int").alias("evidence_doc_count"),
        F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modality"), F.array_sort(F.collect_list(F.struct("modality", "n"))).alias("by_modality"),
    )


def has_modalities(modality: Column, wanted: list[str], operator: str) -> Column:
    """OR: any of them; AND: all of them; ONLY: exactly them. ``modality`` is comma-separated."""
    have, want = F.split(modality, ","), F.array(*map(F.lit, wanted))
    every = F.size(F.array_except(want, have)) == 0
    if operator == "OR":
        return F.arrays_overlap(have, want)
    if operator == "AND":
        return every
    if operator == "ONLY":
        return every & (F.size(F.array_except(have, want)) == 0)
    raise ValueError(f"unknown operator {operator}")


def any_keyword(text: Column, keywords: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(low, k))


def filtered(evidence: DataFrame, wanted: list[str], operator: str = "OR", least: int = 1, keywords: list[str] | None = None, top_k: int = 20) -> DataFrame:
    """Relations with that evidence, most evidence first."""
    rows = evidence.filter(has_modalities(F.col("modality"), wanted, operator) & (F.col("evidence_total_count") >= least))
    if keywords:
        rows = rows.filter(any_keyword(F.concat_ws(" ", "src", "tgt", "keywords"), keywords))
    return rows.orderBy(F.desc("evidence_total_count"), "src", "tgt").limit(top_k)


def modality_stats(evidence: DataFrame) -> DataFrame:
    """How many relations have each modality, and the share of all that have evidence, in per cent."""
    total = evidence.agg(F.count("*").alias("total"))
    per = evidence.select(F.explode(F.split("modality", ",")).alias("modality")).groupBy("modality").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(total)).select("modality", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percentage"))


def expanded(subset: list[str], groups: dict[str, list[str]]) -> list[str]:
    """Names with groups replaced by their members, each once."""
    return list(dict.fromkeys(m for name in subset for m in groups.get(name, [name])))
