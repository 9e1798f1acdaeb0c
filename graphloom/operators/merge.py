"""Merging what was extracted into nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FIELD_SEP


def _in_order(value: str, *order: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])


def merge_nodes(records: DataFrame, order: list[str], cap: int = 300, method: str = "FIFO") -> DataFrame:
    """``entity_id, entity_type, description, source_ids, n_sources`` from records of ``entity_id, entity_type,
    description, source_id`` in the order of ``order``: the commonest type, first seen on ties; distinct
    descriptions and sources in order, the latter capped.
    """
    types = records.groupBy("entity_id", "entity_type").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    kind = types.groupBy("entity_id").agg(F.min_by("entity_type", F.struct(-F.col("n"), F.col("first"))).alias("entity_type"))
    seen = lambda c: records.groupBy("entity_id", c).agg(F.min(F.struct(*order)).alias("first")).groupBy("entity_id").agg(_in_order(c, "first").alias(c))
    # sources are ranked within their entity from the end that the cap keeps, so that no more than the cap are gathered
    distinct = records.groupBy("entity_id", "source_id").agg(F.min(F.struct(*order)).alias("first"))
    keep_first = method == "KEEP"
    ends = [F.asc("first"), F.asc("source_id")] if keep_first else [F.desc("first"), F.desc("source_id")]
    ranked = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("entity_id").orderBy(*ends))).filter(F.col("nth") <= max(cap, 0))
    sources = ranked.groupBy("entity_id").agg(_in_order("source_id", "first").alias("source_ids"))
    counts = distinct.groupBy("entity_id").agg(F.count("*").cast("int").alias("n_sources"))
    merged = kind.join(seen("description"), "entity_id").join(counts, "entity_id").join(sources, "entity_id", "left")
    none = F.array().cast("array<string>")
    return merged.select("entity_id", "entity_type", F.array_join("description", FIELD_SEP).alias("description"), F.coalesce("source_ids", none).alias("source_ids"), "n_sources")


def merge_edges(records: DataFrame) -> DataFrame:
    """Edges from ``src, tgt, weight, keywords, source_id``: weights are summed, keywords sorted and distinct; self loops go."""
    ends = records.filter("src <> tgt").withColumns({"a": F.least("src", "tgt"), "b": F.greatest("src", "tgt")})
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("keywords", ",")))))
    return ends.groupBy(F.col("a").alias("src"), F.col("b").alias("tgt")).agg(F.sum("weight").alias("weight"), F.array_join(words, ",").alias("keywords"), F.count_distinct("source_id").alias("n_sources"))


def document_index(records: DataFrame) -> DataFrame:
    """Distinct entity names and their number per chunk or document."""
    return records.groupBy("source_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_names")).withColumn("count", F.size("entity_names"))


def longer_description(first: DataFrame, gleaned: DataFrame) -> DataFrame:
    """Per (source, entity) the variant with the longer description; a tie keeps the first pass."""
    both = first.withColumn("pass", F.lit(0)).unionByName(gleaned.withColumn("pass", F.lit(1)))
    best = F.struct(F.length("description").alias("n"), (-F.col("pass")).alias("p"))
    return both.groupBy("source_id", "entity_id").agg(F.max_by("description", best).alias("description"), F.max_by("pass", best).alias("pass"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Row by row, new values win and nulls in them keep the old."""
    columns = [c for c in old.columns if c not in keys]
    n = new.withColumnsRenamed({c: f"_{c}" for c in columns})
    return old.join(n, keys, "full").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in columns))
