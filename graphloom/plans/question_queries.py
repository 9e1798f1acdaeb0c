"""Contexts of many questions in one plan, a question for each nation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context, questions
from ..sources import tables
from ..sources.shared import written
from ..sources.tables import read
from .catalog import DEGREE, EDGES, NODES, RANKED, query

BUDGETS = context.Budgets(entities=24, relations=45, total=700)


def _polled_sql(rows: str, out: str) -> str:
    most = BUDGETS.related_chunks
    return f"""{out}c AS (SELECT *, count(*) OVER (PARTITION BY q, c) AS owners FROM {rows}),
 {out}f AS (SELECT * FROM {out}c QUALIFY row_number() OVER (PARTITION BY q, c ORDER BY ord, pos) = 1),
 {out}r AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY ord) - 1 AS rank FROM {out}f),
 {out}n AS (SELECT q, max(rank) + 1 AS n FROM {out}r GROUP BY 1),
 {out}p AS (SELECT q, c, ord, rank, row_number() OVER (PARTITION BY q, ord ORDER BY owners DESC, pos, c) AS place,
   CAST(CASE WHEN n <= 1 THEN {most} ELSE round_even({most} - rank / (n - 1) * ({most} - 1.0), 0) END AS INTEGER) AS quota FROM {out}r JOIN {out}n USING (q)),
 {out}h AS (SELECT q, sum(greatest(quota - has, 0)) AS spare FROM (SELECT q, ord, max(quota) AS quota, count(*) AS has FROM {out}p GROUP BY 1, 2) GROUP BY 1),
 {out}z AS (SELECT *, sum(CASE WHEN place > quota THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS refill FROM {out}p),
 {out} AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY place > quota, ord, place) AS ord FROM {out}z JOIN {out}h USING (q) WHERE place <= quota OR refill <= spare)"""


def _sql(mode: str) -> str:
    words = r"greatest(1, len(list_filter(string_split_regex(description, '\s+'), lambda x: x <> '')))"
    upto = "OVER (PARTITION BY q ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    hits = """eh AS (SELECT s_nationkey AS q, 's' || s_suppkey AS entity_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS ord FROM supplier QUALIFY ord <= 4),
 rh AS (SELECT s_nationkey AS q, src, tgt, e.n, row_number() OVER (PARTITION BY s_nationkey ORDER BY weight DESC, src, tgt) AS ord FROM e JOIN supplier ON tgt = 's' || s_suppkey QUALIFY ord <= 5),
 ch AS (SELECT c_nationkey AS q, 'c' || o_orderkey AS c, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS ord FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY ord <= 10)"""
    end = f"""h AS (SELECT q, m.c AS id, o_orderpriority AS file, 1 + o_orderkey % 50 AS tokens, row_number() OVER (PARTITION BY q ORDER BY m.ord) AS ord FROM m JOIN orders ON 'c' || o_orderkey = m.c QUALIFY ord <= {BUDGETS.chunk_top_k}),
 u AS (SELECT *, sum(tokens) {upto} AS used FROM h), k2 AS (SELECT u.* FROM u JOIN budget USING (q) WHERE used <= b),
 rf AS (SELECT q, file, CAST(row_number() OVER (PARTITION BY q ORDER BY n DESC, f) AS VARCHAR) AS reference_id FROM (SELECT q, file, count(*) AS n, min(ord) AS f FROM k2 GROUP BY 1, 2))"""
    chunk = "SELECT q AS question_id, 'chunk' AS part, CAST(ord AS INTEGER) AS ord, id, reference_id FROM k2 LEFT JOIN rf USING (q, file)"
    room = BUDGETS.total - BUDGETS.reserve
    if mode == "naive":
        return f"WITH {EDGES}, {hits}, m AS (SELECT * FROM ch), budget AS (SELECT DISTINCT q, {room} AS b FROM ch), {end} {chunk}"
    both = lambda key, a, b: f"(SELECT q, {key}, row_number() OVER (PARTITION BY q ORDER BY f) AS ord FROM (SELECT q, {key}, min((ord, list)) AS f FROM (SELECT q, {key}, ord, 0 AS list FROM {a} UNION ALL SELECT q, {key}, ord, 1 FROM {b}) GROUP BY ALL))"
    ents, rels = {"local": ("eh", "lr"), "global": ("ge", "rh")}.get(mode, (both("entity_id", "eh", "ge"), both("src, tgt, n", "lr", "rh")))
    merged = "SELECT q, c, ord, 1 AS list FROM pe UNION ALL SELECT q, c, ord, 2 FROM pr" + (" UNION ALL SELECT q, c, ord, 0 FROM ch" if mode == "mix" else "")
    return f"""WITH {EDGES}, {NODES}, {DEGREE}, {RANKED}, {hits},
 lr AS (SELECT q, src, tgt, n, row_number() OVER (PARTITION BY q ORDER BY rank DESC, weight DESC, o, src, tgt) AS ord FROM (SELECT q, src, tgt, n, rank, weight, eh.ord AS o FROM k JOIN eh ON k.tgt = entity_id) QUALIFY ord <= {BUDGETS.relations}),
 ge AS (SELECT q, entity_id, row_number() OVER (PARTITION BY q ORDER BY o) AS ord FROM (SELECT q, entity_id, min((ord, side)) AS o FROM (SELECT q, ord, 0 AS side, src AS entity_id FROM rh UNION ALL SELECT q, ord, 1, tgt FROM rh) GROUP BY 1, 2)),
 te AS (SELECT x.q, entity_id, ord, sum({words}) {upto} AS used FROM {ents} x JOIN v USING (entity_id) QUALIFY used <= {BUDGETS.entities}),
 tr AS (SELECT *, 3 * row_number() OVER (PARTITION BY q ORDER BY ord) AS used FROM {rels} y QUALIFY used <= {BUDGETS.relations}),
 l AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS p, 'c' || l_orderkey AS c FROM lineitem),
 oe AS (SELECT *, row_number() OVER (PARTITION BY q, ord ORDER BY c) AS pos FROM (SELECT q, ord, c FROM te JOIN l ON entity_id = s UNION SELECT q, ord, c FROM te JOIN l ON entity_id = p)),
 {_polled_sql("oe", "pe")},
 og AS (SELECT *, row_number() OVER (PARTITION BY q, ord ORDER BY c) AS pos FROM (SELECT DISTINCT q, ord, c FROM tr JOIN l ON src = p AND tgt = s)),
 oh AS (SELECT * FROM og WHERE (q, c) NOT IN (SELECT (q, c) FROM pe)),
 {_polled_sql("oh", "pr")},
 m AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY f) AS ord FROM (SELECT q, c, min((ord, list)) AS f FROM ({merged}) GROUP BY 1, 2)),
 budget AS (SELECT q, {room} - sum(used) AS b FROM (SELECT q, max(used) AS used FROM te GROUP BY 1 UNION ALL SELECT q, max(used) FROM tr GROUP BY 1) GROUP BY 1), {end}
 {chunk} UNION ALL SELECT q, 'entity', CAST(ord AS INTEGER), entity_id, NULL FROM te UNION ALL SELECT q, 'relation', CAST(ord AS INTEGER), src || '<SEP>' || tgt, NULL FROM tr"""


def _contexts(spark, d, mode: str):
    """A question for each nation: its suppliers with the most on account, their heaviest relations, its customers' dearest orders."""
    r = tables.relations(spark, d)
    edges = tables.edges(spark, d)
    # hits, their neighbours and degrees read the edges, so they are put together once, as a stored graph has them
    edges = (edges if mode == "naive" else written(edges, "edges")).withColumn("description", F.concat(F.lit("supplied "), "n", F.lit(" times")))
    s, orders = read(spark, d, "supplier"), read(spark, d, "orders")
    chunk_id, supplier = F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), F.concat(F.lit("s"), "s_suppkey")
    nth = lambda *order: F.row_number().over(Window.partitionBy("question_id").orderBy(*order)).alias("ord")
    rich = s.select(F.col("s_nationkey").alias("question_id"), supplier.alias("entity_id"), "s_acctbal", "s_suppkey").select("question_id", "entity_id", nth(F.desc("s_acctbal"), "s_suppkey"))
    heavy = edges.join(s.select(supplier.alias("tgt"), F.col("s_nationkey").alias("question_id")), "tgt").select("question_id", F.col("tgt").alias("src"), F.col("src").alias("tgt"), nth(F.desc("weight"), "src", "tgt"))
    dear = orders.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("question_id", F.col("c_nationkey")).select("question_id", chunk_id, nth(F.desc("o_totalprice"), "o_orderkey"))
    return questions.retrieve_many(
        mode,
        nodes=tables.nodes(spark, d),
        edges=edges,
        entity_sources=r.select(F.explode(F.array("src", "tgt")).alias("entity_id"), F.col("source_id").alias("chunk_id")),
        relation_sources=r.select("src", "tgt", F.col("source_id").alias("chunk_id")),
        chunks=orders.select(chunk_id, F.col("o_orderpriority").alias("file_path"), (1 + F.col("o_orderkey") % 50).alias("tokens")),
        entity_hits=rich.filter("ord <= 4"),
        relation_hits=heavy.filter("ord <= 5"),
        chunk_hits=dear.filter("ord <= 10"),
        budgets=BUDGETS,
    )


@query(_sql("local"))
def local_contexts(spark, d):
    return _contexts(spark, d, "local")


@query(_sql("global"))
def global_contexts(spark, d):
    return _contexts(spark, d, "global")


@query(_sql("hybrid"))
def hybrid_contexts(spark, d):
    return _contexts(spark, d, "hybrid")


@query(_sql("mix"))
def mix_contexts(spark, d):
    return _contexts(spark, d, "mix")


@query(_sql("naive"))
def naive_contexts(spark, d):
    return _contexts(spark, d, "naive")
