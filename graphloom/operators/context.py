"""What a question gets to read: entities, relations and chunks by mode, cut to token budgets, with references.

Hits come from vector search: ``entity_hits(entity_id, ord)``, ``relation_hits(src, tgt, ord)`` and ``chunk_hits(chunk_id, ord)``.
What is put in order in one task is bounded by the token budgets and the numbers of hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .retrieval import interleaved, processed_chunks, references, related_chunks, related_edges, related_entities, weighted_polling, within_budget

MODES = ("local", "global", "hybrid", "mix", "naive")


@dataclass
class Context:
    """``entities(entity_id, ord, ...)``, ``relations(src, tgt, ord, ...)``, ``chunks(chunk_id, ord, reference_id, ...)``, ``references``;
    the first two are None without a graph (naive).
    """

    entities: DataFrame | None
    relations: DataFrame | None
    chunks: DataFrame
    references: DataFrame


@dataclass(frozen=True)
class Budgets:
    """In tokens; ``reserve`` is kept for the prompt around the context."""

    entities: int = 6000
    relations: int = 8000
    total: int = 30000
    reserve: int = 200
    chunk_top_k: int = 20
    related_chunks: int = 5


def edge_data(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits with their edges' fields, in the hits' order; either direction counts, weight 1 where it is missing, misses go."""
    ends = hits.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "ord").groupBy("src", "tgt").agg(F.min("ord").alias("ord"))
    return ends.join(edges, ["src", "tgt"]).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def edges_by_chunks(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs with a record in one of the chunks, each once."""
    met = records.join(chunks.select(F.col("chunk_id").alias("source_id")), "source_id", "left_semi")
    return met.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()


def chunks_of_modalities(records: DataFrame, chunks: DataFrame, wanted: list[str]) -> DataFrame:
    """``chunk_id, modality, n``: chunks of these modalities that relations come from, and of how many each."""
    kept = chunks.filter(F.lower("modality").isin(*(m.lower() for m in wanted))).select("chunk_id", F.lower("modality").alias("modality"))
    return records.withColumnRenamed("source_id", "chunk_id").join(kept, "chunk_id").groupBy("chunk_id", "modality").agg(F.count_distinct("src", "tgt").alias("n"))


def reference_counts(relations: DataFrame, records: DataFrame, limit: int = 100) -> DataFrame:
    """``chunk_id, n``: how many of the relations come from a chunk, most first."""
    met = records.join(relations.select("src", "tgt"), ["src", "tgt"], "left_semi")
    return met.groupBy(F.col("source_id").alias("chunk_id")).agg(F.count_distinct("src", "tgt").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(limit)


def reranked(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (``ord`` from 1) with the score of their place (``index`` from 0, its best), best first; places without a row go."""
    best = scores.groupBy((F.col("index") + 1).alias("ord")).agg(F.max("score").alias("rerank_score"))
    met = rows.join(best, "ord")
    return met.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "ord")))


def entities_of_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that are an end of a relation, whatever the case of their letters."""
    ends = relations.select(F.explode(F.array(F.lower("src"), F.lower("tgt"))).alias("_name")).distinct()
    return entities.withColumn("_name", F.lower("entity_id")).join(ends, "_name", "left_semi").drop("_name")


def similar_chunks(owned: DataFrame, vectors: DataFrame, query: list[float], most: int = 5) -> DataFrame:
    """``chunk_id, ord`` of the owners' chunks most like the query, half of ``most`` for each owner; by weighted polling
    instead where a chunk has no vector. ``owned`` is as ``related_chunks`` gives it.
    """
    from ..functions.numbers import cosine

    ids = owned.select("chunk_id").distinct()
    lacking, owners = ids.join(vectors, "chunk_id", "left_anti").isEmpty(), owned.select("ord").distinct().count()
    if not lacking:
        return polled(owned, most)
    near = ids.join(vectors, "chunk_id").withColumn("similarity", cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))))
    order = [F.desc("similarity"), "chunk_id"]
    return near.orderBy(*order).limit(max(1, most * owners // 2)).select("chunk_id", F.row_number().over(Window.orderBy(*order)).alias("ord"))


def polled(owned: DataFrame, most: int) -> DataFrame:
    """``chunk_id, ord`` by weighted polling: quotas in the owners' order, then what fills them up."""
    chosen = weighted_polling(owned, most)
    return chosen.select("chunk_id", F.row_number().over(Window.orderBy("round", "ord", "place")).alias("ord"))


def truncated(rows: DataFrame, fields: dict[str, str], budget: int) -> DataFrame:
    """The first rows whose JSON of ``fields`` (name there: column) fits the budget, with ``tokens``."""
    line = F.to_json(F.struct(*(F.col(c).alias(name) for name, c in fields.items())))
    return within_budget(rows.withColumn("tokens", F.size(tokens(line))), F.col("tokens"), budget).drop("used")


def _held(rows: DataFrame) -> DataFrame:
    """Rows whose number the budgets bound, worked out once, as several steps need them."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def _owned(rows: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """``owner, ord, pos, chunk_id`` of ordered rows; places are counted within an owner."""
    met = sources.join(F.broadcast(rows.select(*key, "ord")), key).select(F.col("ord").alias("owner"), "ord", "chunk_id").distinct()
    return met.withColumn("pos", F.row_number().over(Window.partitionBy("owner").orderBy("chunk_id")) - 1)


def retrieve(mode: str, *, nodes: DataFrame, edges: DataFrame, entity_sources: DataFrame, relation_sources: DataFrame, chunks: DataFrame, entity_hits: DataFrame, relation_hits: DataFrame, chunk_hits: DataFrame, budgets: Budgets = Budgets()) -> Context:  # noqa: B008
    """The context of a question.

    local: the entities hit and their relations; global: the relations hit and their ends; hybrid: both, interleaved;
    mix: hybrid and the chunks hit; naive: these alone. Entities and relations are cut to their budgets, chunks of
    what is left of them are polled, and chunks get the tokens that remain. Without entities and relations, a mode with
    a graph gives no chunks either. ``entity_sources(entity_id, chunk_id)``, ``relation_sources(src, tgt, chunk_id)``,
    ``chunks(chunk_id, file_path, tokens)``; ``edges`` and ``nodes`` have a ``description``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "naive":
        return _with_references(None, None, chunk_hits.join(chunks, "chunk_id"), budgets.total - budgets.reserve, budgets)
    local = mode != "global"
    glob = mode != "local"
    found, linked = [], []
    columns, pair = ["entity_id", "entity_type", "description"], ["src", "tgt", "weight", "description"]
    if local:
        found.append(entity_hits.join(nodes, "entity_id").select(*columns, "ord"))
        linked.append(related_edges(entity_hits, edges, limit=budgets.relations).select(*pair, "ord"))
    if glob:
        linked.append(_held(edge_data(relation_hits, edges).select(*pair, "ord")))
        found.append(related_entities(linked[-1], nodes).select(*columns, "ord"))
    entities = interleaved(found, ["entity_id"], columns) if len(found) > 1 else found[0]
    relations = interleaved(linked, ["src", "tgt"], pair) if len(linked) > 1 else linked[0]
    entities = _held(truncated(entities, {"entity": "entity_id", "type": "entity_type", "description": "description"}, budgets.entities))
    relations = _held(truncated(relations, {"entity1": "src", "entity2": "tgt", "description": "description"}, budgets.relations))
    from_entities = _held(polled(related_chunks(_owned(entities, entity_sources, ["entity_id"])), budgets.related_chunks))
    rest = _owned(relations, relation_sources, ["src", "tgt"]).join(from_entities.select("chunk_id"), "chunk_id", "left_anti")
    lists = [from_entities, polled(related_chunks(rest), budgets.related_chunks)]
    lists = [chunk_hits.select("chunk_id", "ord"), *lists] if mode == "mix" else lists
    used = entities.agg(F.sum("tokens")).first()[0], relations.agg(F.sum("tokens")).first()[0]
    left = budgets.total - budgets.reserve - sum(u or 0 for u in used) if any(used) else 0
    return _with_references(entities, relations, interleaved(lists, ["chunk_id"], ["chunk_id"]).join(chunks, "chunk_id"), left, budgets)


def _with_references(entities: DataFrame | None, relations: DataFrame | None, chunks: DataFrame, budget: int, budgets: Budgets) -> Context:
    kept = _held(processed_chunks(chunks.withColumn("rerank_score", F.lit(None).cast("double")), top_k=budgets.chunk_top_k, budget=max(0, budget)))
    listed = references(kept)
    return Context(entities, relations, kept.join(listed.select("file_path", "reference_id"), "file_path", "left"), listed)


def assembled(context: Context) -> DataFrame:
    """The context as rows ``part, ord, id, reference_id``: entities, relations, then chunks."""
    none, at = F.lit(None).cast("string").alias("reference_id"), F.col("ord").cast("int").alias("ord")
    rows = context.chunks.select(F.lit("chunk").alias("part"), at, F.col("chunk_id").alias("id"), "reference_id")
    if context.entities is not None and context.relations is not None:
        rows = rows.unionByName(context.entities.select(F.lit("entity").alias("part"), at, F.col("entity_id").alias("id"), none))
        rows = rows.unionByName(context.relations.select(F.lit("relation").alias("part"), at, F.concat_ws("<SEP>", "src", "tgt").alias("id"), none))
    return rows
