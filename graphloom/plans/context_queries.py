"""Queries that retrieve a question's context by mode, and what they are made of, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context, evidence
from ..sources import tables
from ..sources.tables import read
from .catalog import EDGES, EVIDENCE, NODES, RELATED, _evidence, query, seeds

BUDGETS = context.Budgets(entities=60, relations=90, total=1000)


def _polled_sql(own: str, out: str, most: int) -> str:
    return f"""{out}c AS (SELECT *, count(*) OVER (PARTITION BY c) AS occurrences FROM {own}),
 {out}f AS (SELECT * FROM {out}c QUALIFY row_number() OVER (PARTITION BY c ORDER BY ord, pos) = 1),
 {out}o AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT ord FROM {out}f)),
 {out}p AS (SELECT c, ord, rank, row_number() OVER (PARTITION BY ord ORDER BY occurrences DESC, pos, c) AS place, CAST(CASE WHEN n <= 1 THEN {most} ELSE round_even({most} - rank / (n - 1) * ({most} - 1.0), 0) END AS INTEGER) AS quota FROM {out}f JOIN {out}o USING (ord)),
 {out}h AS (SELECT sum(greatest(q - has, 0)) AS spare FROM (SELECT ord, max(quota) AS q, count(*) AS has FROM {out}p GROUP BY 1)),
 {out}z AS (SELECT *, sum(CASE WHEN place > quota THEN 1 ELSE 0 END) OVER (ORDER BY rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS refill FROM {out}p),
 {out} AS (SELECT c, row_number() OVER (ORDER BY CASE WHEN place <= quota THEN 0 ELSE 1 END, ord, place) AS ord FROM {out}z, {out}h WHERE place <= quota OR refill <= spare)"""


def _mode_sql(mode: str) -> str:
    hits = "ch AS (SELECT o_orderkey AS c, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ord FROM orders QUALIFY ord <= 10)"
    words = r"greatest(1, len(list_filter(string_split_regex(description, '\s+'), lambda x: x <> '')))"
    end = """h AS (SELECT 'c' || m.c AS id, o_orderpriority AS file, 1 + m.c % 50 AS tokens, row_number() OVER (ORDER BY m.ord) AS ord FROM m JOIN orders ON o_orderkey = m.c QUALIFY ord <= 20),
 u AS (SELECT *, sum(tokens) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM h), k2 AS (SELECT * FROM u WHERE used <= (SELECT b FROM budget)),
 rf AS (SELECT file, CAST(row_number() OVER (ORDER BY n DESC, f) AS VARCHAR) AS reference_id FROM (SELECT file, count(*) AS n, min(ord) AS f FROM k2 GROUP BY 1))"""
    chunk = "SELECT 'chunk' AS part, CAST(ord AS INTEGER) AS ord, id, reference_id FROM k2 LEFT JOIN rf USING (file)"
    if mode == "naive":
        return f"WITH {hits}, m AS (SELECT c, ord FROM ch), budget AS (SELECT {BUDGETS.total - BUDGETS.reserve} AS b), {end} {chunk}"
    ends = """lr AS (SELECT src, tgt, n, ord FROM ro), gr AS (SELECT src, tgt, n, row_number() OVER (ORDER BY weight DESC, src, tgt) AS ord FROM e QUALIFY ord <= 6),
 le AS (SELECT entity_id, seed.ord FROM seed),
 ge AS (SELECT entity_id, row_number() OVER (ORDER BY o) AS ord FROM (SELECT entity_id, min((ord, side)) AS o FROM (SELECT ord, 0 AS side, src AS entity_id FROM gr UNION ALL SELECT ord, 1, tgt FROM gr) GROUP BY 1))"""
    both = lambda key, a, b: f"(SELECT {key}, row_number() OVER (ORDER BY f) AS ord FROM (SELECT {key}, min((ord, list)) AS f FROM (SELECT {key}, ord, 0 AS list FROM {a} UNION ALL SELECT {key}, ord, 1 FROM {b}) GROUP BY ALL))"
    ents, rels = {"local": ("le", "lr"), "global": ("ge", "gr")}.get(mode, (both("entity_id", "le", "ge"), both("src, tgt, n", "lr", "gr")))
    merged = "SELECT c, ord, 1 AS list FROM pe UNION ALL SELECT c, ord, 2 FROM pr" + (" UNION ALL SELECT c, ord, 0 FROM ch" if mode == "mix" else "")
    return f"""WITH {RELATED}, {NODES}, {hits}, {ends},
 te AS (SELECT *, sum({words}) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {ents} x JOIN v USING (entity_id) QUALIFY used <= {BUDGETS.entities}),
 tr AS (SELECT *, 3 * row_number() OVER (ORDER BY ord) AS used FROM {rels} y QUALIFY used <= {BUDGETS.relations}),
 l AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p, l_orderkey AS c FROM lineitem),
 oe AS (SELECT ord, c, row_number() OVER (PARTITION BY ord ORDER BY 'c' || c) - 1 AS pos FROM (SELECT te.ord, c FROM te JOIN l ON entity_id = s UNION SELECT te.ord, c FROM te JOIN l ON entity_id = p)),
 {_polled_sql("oe", "pe", BUDGETS.related_chunks).replace("pos, c)", "pos, 'c' || c)")},
 og AS (SELECT ord, c, row_number() OVER (PARTITION BY ord ORDER BY 'c' || c) - 1 AS pos FROM (SELECT DISTINCT tr.ord, c FROM tr JOIN l ON src = p AND tgt = s)),
 oh AS (SELECT * FROM og WHERE c NOT IN (SELECT c FROM pe)),
 {_polled_sql("oh", "pr", BUDGETS.related_chunks).replace("pos, c)", "pos, 'c' || c)")},
 m AS (SELECT c, row_number() OVER (ORDER BY f) AS ord FROM (SELECT c, min((ord, list)) AS f FROM ({merged}) GROUP BY 1)),
 budget AS (SELECT {BUDGETS.total - BUDGETS.reserve} - coalesce((SELECT max(used) FROM te), 0) - coalesce((SELECT max(used) FROM tr), 0) AS b), {end}
 {chunk} UNION ALL SELECT 'entity', CAST(ord AS INTEGER), entity_id, NULL FROM te UNION ALL SELECT 'relation', CAST(ord AS INTEGER), src || '<SEP>' || tgt, NULL FROM tr"""


def _context(spark, d, mode: str):
    """Suppliers with the most on account, the heaviest relations and the dearest orders are hit; orders are chunks, their priority the file."""
    r = tables.relations(spark, d)
    edges = tables.edges(spark, d).withColumn("description", F.concat(F.lit("supplied "), "n", F.lit(" times")))
    chunk_id = F.concat(F.lit("c"), "o_orderkey").alias("chunk_id")
    orders = read(spark, d, "orders")
    dear, heavy = [F.desc("o_totalprice"), "o_orderkey"], [F.desc("weight"), "src", "tgt"]
    return context.assembled(
        context.retrieve(
            mode,
            nodes=tables.nodes(spark, d),
            edges=edges,
            entity_sources=r.select(F.explode(F.array("src", "tgt")).alias("entity_id"), F.col("source_id").alias("chunk_id")),
            relation_sources=r.select("src", "tgt", F.col("source_id").alias("chunk_id")),
            chunks=orders.select(chunk_id, F.col("o_orderpriority").alias("file_path"), (1 + F.col("o_orderkey") % 50).alias("tokens")),
            entity_hits=seeds(spark, d),
            relation_hits=edges.orderBy(*heavy).limit(6).select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.row_number().over(Window.orderBy(*heavy)).alias("ord")),
            chunk_hits=orders.orderBy(*dear).limit(10).select(chunk_id, F.row_number().over(Window.orderBy(*dear)).alias("ord")),
            budgets=BUDGETS,
        )
    )


@query(_mode_sql("local"))
def local_context(spark, d):
    return _context(spark, d, "local")


@query(_mode_sql("global"))
def global_context(spark, d):
    return _context(spark, d, "global")


@query(_mode_sql("hybrid"))
def hybrid_context(spark, d):
    return _context(spark, d, "hybrid")


@query(_mode_sql("mix"))
def mix_context(spark, d):
    return _context(spark, d, "mix")


@query(_mode_sql("naive"))
def naive_context(spark, d):
    return _context(spark, d, "naive")


@query(f"WITH {EDGES}, g AS (SELECT 's' || l_suppkey AS x, 'p' || l_partkey AS y, min(l_orderkey) AS ord FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2) SELECT src, tgt, ord, weight, n FROM g JOIN e ON src = y AND tgt = x")
def edge_hits_with_fields(spark, d):
    """Every first line's pair is looked up, ends the other way round, with one that doesn't exist."""
    first = read(spark, d, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("tgt"), F.col("l_orderkey").alias("ord"))
    return context.edge_data(first.union(spark.createDataFrame([("nobody", "p1", 0)], "src string, tgt string, ord long")), tables.edges(spark, d))


@query("SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def edges_by_chunks(spark, d):
    o = read(spark, d, "orders")
    least = o.agg(F.min("o_orderpriority").alias("o_orderpriority"))
    urgent = o.join(F.broadcast(least), "o_orderpriority", "left_semi").select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"))
    return context.edges_by_chunks(tables.relations(spark, d), urgent)


def _chunk_modalities(spark, d):
    kinds = F.array(*(F.lit(m) for m in ("Text", "Image", "Table", "Equation")))
    return read(spark, d, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("modality"))


MODAL = "mc AS (SELECT 'c' || l_orderkey AS chunk_id, ['text', 'image', 'table', 'equation'][1 + l_orderkey % 4] AS modality, count(DISTINCT (l_partkey, l_suppkey)) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)"


@query(f"WITH {MODAL} SELECT * FROM mc WHERE modality IN ('image', 'table')")
def chunks_of_modalities(spark, d):
    return context.chunks_of_modalities(tables.relations(spark, d), _chunk_modalities(spark, d), ["Image", "table"])


@query(f"WITH {MODAL} SELECT modality, count(*) AS n FROM mc WHERE modality <> 'text' GROUP BY 1")
def modality_histogram(spark, d):
    found = context.chunks_of_modalities(tables.relations(spark, d), _chunk_modalities(spark, d), ["image", "table", "equation"])
    return found.groupBy("modality").agg(F.count("*").alias("n"))


@query(f"WITH {EVIDENCE}, h AS (SELECT *, string_split(modality, ',') AS m FROM ev), t AS (SELECT src, tgt FROM h WHERE list_has_any(m, ['image', 'table']) AND evidence_total_count >= 1 ORDER BY evidence_total_count DESC, src, tgt LIMIT 200) SELECT 'c' || l_orderkey AS chunk_id, count(DISTINCT (src, tgt)) AS n FROM lineitem JOIN t ON src = 'p' || l_partkey AND tgt = 's' || l_suppkey GROUP BY 1 ORDER BY n DESC, chunk_id LIMIT 100")
def chunk_reference_counts(spark, d):
    kept = evidence.filtered(_evidence(spark, d), ["image", "table"], "OR", top_k=200)
    return context.reference_counts(kept, tables.relations(spark, d))


@query("WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ord FROM orders QUALIFY ord <= 50), s AS (SELECT c_custkey - 1 AS ord, max(c_acctbal) AS score FROM customer WHERE c_custkey BETWEEN 2 AND 81 GROUP BY 1) SELECT o_orderkey, score AS rerank_score, CAST(row_number() OVER (ORDER BY score DESC, ord) AS INTEGER) AS ord FROM t JOIN s USING (ord)")
def reranked_chunks(spark, d):
    """The 50 dearest orders by scores for 80 places."""
    dear = [F.desc("o_totalprice"), "o_orderkey"]
    rows = read(spark, d, "orders").orderBy(*dear).limit(50).select("o_orderkey", F.row_number().over(Window.orderBy(*dear)).alias("ord"))
    scores = read(spark, d, "customer").filter("c_custkey between 2 and 81").select((F.col("c_custkey") - 2).alias("index"), F.col("c_acctbal").alias("score"))
    return context.reranked(rows, scores)


@query(f"WITH {NODES}, {EDGES}, t AS (SELECT src, tgt FROM e WHERE n >= 2) SELECT v.* FROM v WHERE entity_id IN (SELECT src FROM t) OR entity_id IN (SELECT tgt FROM t)")
def entities_of_relations(spark, d):
    often = tables.edges(spark, d).filter("n >= 2").select(F.upper("src").alias("src"), F.upper("tgt").alias("tgt"))
    return context.entities_of_relations(tables.nodes(spark, d), often)


@query(f"WITH {NODES} SELECT DISTINCT entity_id FROM v")
def all_labels(spark, d):
    return tables.nodes(spark, d).select("entity_id").distinct().orderBy("entity_id")
