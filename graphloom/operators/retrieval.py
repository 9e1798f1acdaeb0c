"""Retrieval: hits to nodes, edges, chunks and context, as joins and windows with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine, linear_quota
from .graph import first_seen, incident


def vector_hits(vectors: DataFrame, query: list[float], k: int, threshold: float = 0.2, digits: int = 6) -> DataFrame:
    """``vec_id, similarity, ord``: the k most similar at or over the threshold."""
    q = F.array(*(F.lit(float(x)) for x in query))
    sim = vectors.withColumn("similarity", F.round(cosine(F.col("embedding"), q), digits)).filter(F.col("similarity") >= threshold)
    top = sim.orderBy(F.desc("similarity"), "vec_id").limit(k)
    return top.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id"))).drop("embedding")


def _degrees_of(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree`` of the nodes in ``ends(node)``: only their edges are counted."""
    return incident(edges).join(ends.distinct(), "node", "left_semi").groupBy("node").agg(F.count("*").alias("degree"))


def node_data(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits with their nodes and degree (rank), in the hits' order; hits without a node go."""
    rank = _degrees_of(hits.select(F.col("entity_id").alias("node")), edges).withColumnsRenamed({"node": "entity_id", "degree": "rank"})
    return hits.join(nodes, "entity_id").join(rank, "entity_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def related_edges(seeds: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges of the seeds (``entity_id, ord``), each once, ranked by degrees and weight; ``ord`` is the place.

    With ``limit`` only the first are kept, so that the edges of a hub aren't numbered all in one task.
    """
    hit = incident(edges).join(seeds.select(F.col("entity_id").alias("node"), "ord"), "node")
    once = first_seen(hit, ["src", "tgt"], ["ord", "src", "tgt"]).select(*edges.columns, F.col("ord").alias("seed_ord"))
    degree = _degrees_of(once.select(F.explode(F.array("src", "tgt")).alias("node")), edges)
    for side in ("src", "tgt"):
        once = once.join(degree.withColumnsRenamed({"node": side, "degree": f"_{side}"}), side)
    once = once.select(*edges.columns, (F.col("_src") + F.col("_tgt")).alias("rank"), "seed_ord")
    order = [F.desc("rank"), F.desc("weight"), "seed_ord", "src", "tgt"]
    once = once if limit is None else once.orderBy(*order).limit(limit)
    return once.withColumn("ord", F.row_number().over(Window.orderBy(*order)))


def related_entities(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints of ranked edges, source before target, each once, with their nodes."""
    ends = ranked.select("ord", F.posexplode(F.array("src", "tgt")).alias("side", "entity_id"))
    return first_seen(ends, ["entity_id"], ["ord", "side"]).join(nodes, "entity_id").withColumn("ord", F.row_number().over(Window.orderBy("ord", "side"))).drop("side")


def interleaved(lists: list[DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """Round-robin union of ordered tables (``ord`` from 1), each key where it is first seen."""
    both = None
    for i, rows in enumerate(lists):
        own = rows.select(*columns, "ord").withColumn("list", F.lit(i))
        both = own if both is None else both.unionByName(own)
    once = first_seen(both, key, ["ord", "list"])
    return once.withColumn("ord", F.row_number().over(Window.orderBy("ord", "list"))).drop("list")


def within_budget(rows: DataFrame, tokens: Column, budget: int, order: str = "ord") -> DataFrame:
    """The longest beginning whose tokens sum to at most the budget, with the sum so far as ``used``; ``order`` is distinct.

    Rows without tokens (null counts as none) belong to it as long as nothing before them is over. At most ``budget`` + 1 of the others
    say where it ends; only what is before that is put in order in one task.
    """
    rows, upto = rows.withColumn("_tokens", F.coalesce(tokens, F.lit(0))), Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heavy = rows.filter("_tokens > 0").select(order, "_tokens").orderBy(order).limit(max(0, budget) + 1)
    end = heavy.withColumn("used", F.sum("_tokens").over(upto)).filter(F.col("used") > budget).agg(F.min(order).alias("_end"))
    kept = rows.crossJoin(F.broadcast(end)).filter(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    return (kept if budget >= 0 else kept.limit(0)).withColumn("used", F.sum("_tokens").over(upto)).drop("_tokens", "_end")


def related_chunks(owners: DataFrame) -> DataFrame:
    """``chunk_id, owner, ord, pos, occurrences`` from owners' chunks (``owner, ord, pos, chunk_id``): the earliest owner keeps a chunk."""
    counted = owners.withColumn("occurrences", F.count("*").over(Window.partitionBy("chunk_id")))
    return first_seen(counted, ["chunk_id"], ["ord", "pos"])


def weighted_polling(chunks: DataFrame, most: int = 5, least: int = 1) -> DataFrame:
    """Chunks by owner (``ord``): as many from each as its quota, which falls with its place; what owners leave
    unused goes to the first chunks not chosen, in order. ``pos`` orders within an owner.
    """
    owners = chunks.select("ord").distinct()
    rank = owners.withColumn("rank", F.row_number().over(Window.orderBy("ord")) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    by_owner = Window.partitionBy("ord").orderBy(F.desc("occurrences"), "pos", "chunk_id")
    own = chunks.join(rank, "ord").withColumn("place", F.row_number().over(by_owner)).withColumn("quota", linear_quota(F.col("rank"), F.col("n"), most, least))
    chosen = own.withColumn("first", F.col("place") <= F.col("quota"))
    have = chosen.groupBy("ord").agg(F.max("quota").alias("quota"), F.count("*").alias("has"))
    spare = have.agg(F.coalesce(F.sum(F.greatest(F.col("quota") - F.col("has"), F.lit(0))), F.lit(0)).alias("spare"))
    # no owner gives more than its quota and all that is left over, which bounds what the next window sorts
    near = chosen.crossJoin(F.broadcast(spare)).filter(F.col("place") <= F.col("quota") + F.col("spare"))
    filled = near.withColumn("refill", F.sum((~F.col("first")).cast("int")).over(Window.orderBy("rank", "place").rowsBetween(Window.unboundedPreceding, 0)))
    kept = filled.filter(F.col("first") | (F.col("refill") <= F.col("spare")))
    return kept.select("chunk_id", "ord", "place", F.when(F.col("first"), 0).otherwise(1).alias("round"))


def references(chunks: DataFrame) -> DataFrame:
    """``reference_id, file_path, n``: files by how many chunks they give, then by first place; unknown files aren't listed."""
    known = chunks.filter("file_path is not null and file_path not in ('', 'unknown_source')")
    per = known.groupBy("file_path").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return per.select(F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("string").alias("reference_id"), "file_path", "n")


def processed_chunks(chunks: DataFrame, *, min_score: float = 0.0, top_k: int = 20, budget: int = 2000) -> DataFrame:
    """Chunks (``ord, rerank_score, tokens``) after the score bound, the head and the token budget, with ids DC1, DC2, ..."""
    good = chunks.filter(F.coalesce("rerank_score", F.lit(1.0)) >= min_score) if min_score > 0 else chunks
    best = F.desc(F.coalesce("rerank_score", F.lit(1.0)))
    head = good.orderBy(best, "ord").limit(top_k).withColumn("ord", F.row_number().over(Window.orderBy(best, "ord")))
    return within_budget(head, F.col("tokens"), budget).withColumn("id", F.concat(F.lit("DC"), F.col("ord").cast("string"))).drop("used")
