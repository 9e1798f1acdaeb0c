"""Contexts of many questions at once: what ``context`` does for one, with ``question_id`` as a key of every step.

Hits are ``entity_hits(question_id, entity_id, ord)``, ``relation_hits(question_id, src, tgt, ord)`` and ``chunk_hits(question_id,
chunk_id, ord)``. What the budgets leave is written, the rest is one lazy plan: questions are put in order side by side, each in its own window, and what
a window sorts is bounded by the budgets and the hits of one question. Only edges at the hits are ranked, by the degrees of their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import linear_quota
from ..functions.text import FIELD_SEP, tokens
from ..sources.shared import in_threads, written
from .context import MODES, Budgets
from .graph import first_seen, incident

Q = "question_id"


def _numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(Q).orderBy(*order)))


def edges_of_hits(hits: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` edges of each question's entities, by the degrees of their ends, then weight and the entities' order."""
    ends = incident(edges)
    met = ends.join(hits.select(Q, F.col("entity_id").alias("node"), F.col("ord").alias("seed_ord")), "node")
    once = met.groupBy(Q, "src", "tgt").agg(F.min("seed_ord").alias("seed_ord"), *(F.first(c).alias(c) for c in edges.columns if c not in ("src", "tgt")))
    touched = once.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    degree = ends.join(touched, "node", "left_semi").groupBy("node").agg(F.count("*").alias("_degree"))
    for side in ("src", "tgt"):
        once = once.join(degree.withColumnsRenamed({"node": side, "_degree": f"_{side}"}), side)
    return _numbered(once, F.desc(F.col("_src") + F.col("_tgt")), F.desc("weight"), "seed_ord", "src", "tgt").filter(F.col("ord") <= limit).drop("_src", "_tgt", "seed_ord")


def edges_hit(hits: DataFrame, edges: DataFrame) -> DataFrame:
    ends = hits.select(Q, F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "ord").groupBy(Q, "src", "tgt").agg(F.min("ord").alias("ord"))
    return ends.join(edges, ["src", "tgt"]).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def ends_of_edges(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = ranked.select(Q, "ord", F.posexplode(F.array("src", "tgt")).alias("side", "entity_id"))
    return _numbered(first_seen(ends, [Q, "entity_id"], ["ord", "side"]).join(nodes, "entity_id"), "ord", "side").drop("side")


def interleaved(lists: list[DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """Round-robin union of each question's lists, each key where it is first seen."""
    if len(lists) == 1:
        return lists[0].select(Q, *columns, "ord")
    both = None
    for i, rows in enumerate(lists):
        own = rows.select(Q, *columns, "ord").withColumn("list", F.lit(i))
        both = own if both is None else both.unionByName(own)
    return _numbered(first_seen(both, [Q, *key], ["ord", "list"]), "ord", "list").drop("list")


def truncated(rows: DataFrame, fields: dict[str, str], budget: int) -> DataFrame:
    """Each question's first rows whose JSON of ``fields`` fits the budget, with ``tokens``."""
    line = F.to_json(F.struct(*(F.col(c).alias(name) for name, c in fields.items())))
    upto = Window.partitionBy(Q).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("tokens", F.size(tokens(line))).withColumn("_used", F.sum("tokens").over(upto)).filter(F.col("_used") <= budget).drop("_used")


def polled(rows: DataFrame, sources: DataFrame, key: list[str], most: int, without: DataFrame | None = None) -> DataFrame:
    """``question_id, chunk_id, ord``: chunks of ordered owners by weighted polling, those of ``without`` left out."""
    met = sources.join(rows.select(Q, *key, "ord"), key).select(Q, "ord", "chunk_id").distinct()
    owned = met.withColumn("pos", F.row_number().over(Window.partitionBy(Q, "ord").orderBy("chunk_id")))
    owned = owned if without is None else owned.join(without.select(Q, "chunk_id"), [Q, "chunk_id"], "left_anti")
    counted = first_seen(owned.withColumn("n_owners", F.count("*").over(Window.partitionBy(Q, "chunk_id"))), [Q, "chunk_id"], ["ord", "pos"])
    ranked = counted.withColumn("rank", F.dense_rank().over(Window.partitionBy(Q).orderBy("ord")) - 1).withColumn("n", F.max("rank").over(Window.partitionBy(Q)) + 1)
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy(Q, "ord").orderBy(F.desc("n_owners"), "pos", "chunk_id"))).withColumn("quota", linear_quota(F.col("rank"), F.col("n"), most, 1))
    has = Window.partitionBy(Q, "ord")
    placed = placed.withColumn("left", F.when(F.col("place") == 1, F.greatest(F.col("quota") - F.count("*").over(has), F.lit(0))).otherwise(0)).withColumn("spare", F.sum("left").over(Window.partitionBy(Q)))
    near = placed.filter(F.col("place") <= F.col("quota") + F.col("spare")).withColumn("late", F.col("place") > F.col("quota"))
    refill = F.sum(F.col("late").cast("int")).over(Window.partitionBy(Q).orderBy("rank", "place").rowsBetween(Window.unboundedPreceding, 0))
    kept = near.withColumn("refill", refill).filter(~F.col("late") | (F.col("refill") <= F.col("spare")))
    return kept.select(Q, "chunk_id", F.row_number().over(Window.partitionBy(Q).orderBy("late", "ord", "place")).alias("ord"))


def with_references(rows: DataFrame, budget: Column, top_k: int) -> DataFrame:
    """Each question's first chunks (``ord``, ``tokens``, ``file_path``) within ``budget``, numbered by file: the file that gives most is 1."""
    upto = Window.partitionBy(Q).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = _numbered(rows, "ord").filter(F.col("ord") <= top_k).withColumn("used", F.sum("tokens").over(upto)).filter(F.col("used") <= budget)
    known = F.col("file_path").isNotNull() & ~F.col("file_path").isin("", "unknown_source")
    of = Window.partitionBy(Q, "file_path")
    counted = kept.withColumns({"_n": F.count("*").over(of), "_first": F.min("ord").over(of)})
    rank = F.dense_rank().over(Window.partitionBy(Q).orderBy(F.desc(F.when(known, F.col("_n"))), "_first"))
    return counted.withColumn("reference_id", F.when(known, rank.cast("string"))).drop("_n", "_first", "used")


def retrieve_many(mode: str, *, nodes: DataFrame, edges: DataFrame, entity_sources: DataFrame, relation_sources: DataFrame, chunks: DataFrame, entity_hits: DataFrame, relation_hits: DataFrame, chunk_hits: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:  # noqa: B008
    """Rows ``question_id, part, ord, id, reference_id`` of every question's context, by the modes of ``context.retrieve``.

    A question without entities and relations gets no chunks in a mode with a graph; one without any hit has no rows.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    at, none = F.col("ord").cast("int").alias("ord"), F.lit(None).cast("string").alias("reference_id")
    listed = lambda rows: rows.select(Q, F.lit("chunk").alias("part"), at, F.col("chunk_id").alias("id"), "reference_id")
    room = budgets.total - budgets.reserve
    if mode == "naive":
        return listed(with_references(chunk_hits.join(chunks, "chunk_id"), F.lit(room), budgets.chunk_top_k))
    columns, pair = ["entity_id", "entity_type", "description"], ["src", "tgt", "weight", "description"]
    found, linked = [], []
    if mode != "global":
        found.append(entity_hits.join(nodes, "entity_id"))
        linked.append(edges_of_hits(entity_hits, edges, budgets.relations))
    if mode != "local":
        linked.append(edges_hit(relation_hits, edges))
        found.append(ends_of_edges(linked[-1], nodes))
    entities = truncated(interleaved(found, ["entity_id"], columns), {"entity": "entity_id", "type": "entity_type", "description": "description"}, budgets.entities)
    relations = truncated(interleaved(linked, ["src", "tgt"], pair), {"entity1": "src", "entity2": "tgt", "description": "description"}, budgets.relations)
    # what the budgets leave is small and read by polling, the room for chunks and the rows
    entities, relations = in_threads(lambda x: written(*x), [(entities, "entities"), (relations, "relations")])
    of_entities = polled(entities, entity_sources, ["entity_id"], budgets.related_chunks)
    of_entities = written(of_entities, "polled")
    of_relations = polled(relations, relation_sources, ["src", "tgt"], budgets.related_chunks, without=of_entities)
    lists = [*([chunk_hits] if mode == "mix" else []), of_entities, of_relations]
    used = entities.select(Q, "tokens").unionByName(relations.select(Q, "tokens")).groupBy(Q).agg((F.lit(room) - F.sum("tokens")).alias("_left"))
    picked = interleaved(lists, ["chunk_id"], ["chunk_id"]).join(chunks, "chunk_id").join(used, Q)
    rows = listed(with_references(picked, F.col("_left"), budgets.chunk_top_k))
    rows = rows.unionByName(entities.select(Q, F.lit("entity").alias("part"), at, F.col("entity_id").alias("id"), none))
    return rows.unionByName(relations.select(Q, F.lit("relation").alias("part"), at, F.concat_ws(FIELD_SEP, "src", "tgt").alias("id"), none))
