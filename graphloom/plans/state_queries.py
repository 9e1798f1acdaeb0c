"""Queries that change a stored graph, and the scores of long documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, editing, merge, scoring
from ..sources import tables
from ..sources.tables import read
from .catalog import EDGES, NODES, query

# editing


@query("""WITH r AS (SELECT 's' || l_suppkey AS entity_id, l_returnflag AS kind, 'line ' || l_linenumber AS description, l_quantity AS weight,
   CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || ', ' || l_linestatus ELSE l_linestatus || ',' END AS keywords, 'c' || (l_orderkey % 7) || '<SEP>c' || (l_orderkey % 5) AS source_id,
   (l_orderkey, l_linenumber) AS o FROM lineitem),
 k AS (SELECT entity_id, list_sort(list(DISTINCT trim(x))) AS keywords FROM (SELECT entity_id, unnest(string_split(keywords, ',')) AS x FROM r) WHERE trim(x) <> '' GROUP BY 1),
 s AS (SELECT entity_id, list_sort(list(DISTINCT x)) AS ids FROM (SELECT entity_id, unnest(string_split(source_id, '<SEP>')) AS x FROM r) GROUP BY 1),
 m AS (SELECT entity_id, arg_min(kind, o) AS kind, arg_max(description, o) AS description, max(weight) AS weight FROM r GROUP BY 1)
SELECT entity_id, kind, description, weight, array_to_string(keywords, ',') AS keywords, array_to_string(ids, '<SEP>') AS source_id FROM m JOIN k USING (entity_id) JOIN s USING (entity_id)""")
def merged_attributes(spark, d):
    li = read(spark, d, "lineitem")
    words = F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", F.lit(", "), "l_linestatus")).otherwise(F.concat("l_linestatus", F.lit(",")))
    source = F.concat(F.lit("c"), F.col("l_orderkey") % 7, F.lit("<SEP>c"), F.col("l_orderkey") % 5)
    rows = li.select(
        F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("line "), "l_linenumber").alias("description"),
        F.col("l_quantity").alias("weight"), words.alias("keywords"), source.alias("source_id"), "l_orderkey", "l_linenumber",
    )
    how = {"description": "keep_last", "weight": "max", "keywords": "join_unique_comma", "source_id": "join_unique"}
    return editing.merged_attributes(rows, ["entity_id"], ["l_orderkey", "l_linenumber"], how)


@query(f"WITH {NODES} SELECT * FROM v UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation")
def created_entities(spark, d):
    """Nations are new; every supplier is offered too and refused."""
    nodes = tables.nodes(spark, d)
    nations = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("description"))
    return editing.create_entities(nodes, nations.unionByName(nodes.filter("entity_type = 'supplier'").withColumn("description", F.lit("offered"))))


@query(f"""WITH {NODES}, {EDGES}, x AS (SELECT 's' || (1 + p_partkey % 20) AS a, 'p' || p_partkey AS b FROM part UNION ALL SELECT 'p1', 'nobody')
SELECT * FROM e UNION ALL SELECT DISTINCT b, a, 1.0::DOUBLE, NULL FROM x WHERE a IN (SELECT entity_id FROM v) AND b IN (SELECT entity_id FROM v) AND (b, a) NOT IN (SELECT (src, tgt) FROM e)""")
def created_relations(spark, d):
    """Each part to a supplier, ends the other way round; one end doesn't exist."""
    new = read(spark, d, "part").select(F.concat(F.lit("s"), 1 + F.col("p_partkey") % 20).alias("src"), F.concat(F.lit("p"), "p_partkey").alias("tgt"))
    new = new.union(spark.createDataFrame([("p1", "nobody")], "src string, tgt string")).withColumn("weight", F.lit(1.0))
    return editing.create_relations(tables.nodes(spark, d), tables.edges(spark, d), new)


@query(f"WITH {NODES} SELECT entity_id, CASE WHEN entity_type = 'supplier' THEN 'vendor' ELSE entity_type END AS entity_type, CASE WHEN entity_type = 'supplier' AND CAST(substr(entity_id, 2) AS INT) % 2 = 0 THEN 'changed' ELSE description END AS description FROM v")
def edited_entities(spark, d):
    nodes = tables.nodes(spark, d)
    even = F.when(F.substring("entity_id", 2, 20).cast("int") % 2 == 0, "changed")
    return editing.edit(nodes, nodes.filter("entity_type = 'supplier'").select("entity_id", F.lit("vendor").alias("entity_type"), even.alias("description")), ["entity_id"])


RENAMED = "m AS (SELECT *, CASE WHEN entity_type = 'supplier' AND CAST(substr(entity_id, 2) AS INT) % 2 = 1 THEN 's' || (1 + CAST(substr(entity_id, 2) AS INT)) END AS n FROM v)"


def _renamed(spark, d):
    """Odd suppliers take the next one's name: some are merged with it, and the last may get a free name."""
    return read(spark, d, "supplier").filter("s_suppkey % 2 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("old"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("new"))


@query(f"WITH {NODES}, {RENAMED} SELECT coalesce(n, entity_id) AS entity_id, arg_min(entity_type, (n IS NOT NULL, entity_id)) AS entity_type, string_agg(description, '<SEP>' ORDER BY (n IS NOT NULL), entity_id) AS description FROM m GROUP BY 1")
def renamed_entities(spark, d):
    return editing.rename_entities(tables.nodes(spark, d), tables.edges(spark, d), _renamed(spark, d))[0]


@query(f"WITH {NODES}, {EDGES}, {RENAMED} SELECT src, coalesce(n, tgt) AS tgt, max(weight) AS weight, arg_min(e.n_, tgt) AS n FROM (SELECT src, tgt, weight, n AS n_ FROM e) e JOIN m ON tgt = entity_id GROUP BY 1, 2")
def renamed_relations(spark, d):
    return editing.rename_entities(tables.nodes(spark, d), tables.edges(spark, d), _renamed(spark, d))[1]


@query(f"WITH {EDGES} SELECT e.* FROM e WHERE CAST(substr(src, 2) AS BIGINT) % 3 <> 0")
def deleted_relations(spark, d):
    """Every pair of each third part goes, named from the supplier."""
    e = tables.edges(spark, d)
    return editing.delete_relations(e, e.filter("cast(substr(src, 2) as bigint) % 3 = 0").select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))


@query("SELECT 'c' || l_orderkey AS source_id, 's' || l_suppkey AS entity_id, count(*) AS n FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1, 2")
def deleted_entities_tracking(spark, d):
    """What tracking holds once every fourth supplier is deleted."""
    r = tables.relations(spark, d)
    tracking = r.groupBy("source_id", F.col("tgt").alias("entity_id")).agg(F.count("*").alias("n"))
    gone = read(spark, d, "supplier").filter("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"))
    return editing.delete_keys({"edges": r, "tracking": tracking}, gone)["tracking"]


@query("""SELECT src, tgt, sum(q) AS weight, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT unnest(flatten(list(k))) AS w)) AS keywords, count(DISTINCT c) AS n_sources
FROM (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, l_quantity AS q, [l_returnflag, l_linestatus] AS k, l_orderkey AS c FROM lineitem WHERE l_orderkey % 3 <> 0) GROUP BY 1, 2""")
def relations_after_deletion(spark, d):
    """A third of the orders goes; relations that they touch are rebuilt, others are kept as they were."""
    records = tables.relations(spark, d)
    gone = records.filter("ord1 % 3 = 0").select(F.col("source_id").alias("chunk_id")).distinct()
    return editing.relations_after_deletion(merge.merge_edges(records), records, gone)


CUSTOM = """c AS (SELECT 'o' || o_orderkey AS source_id, 'chunk-' || md5('order ' || o_orderkey) AS chunk_id FROM orders),
 n AS (SELECT 's' || l_suppkey AS entity_id, l_returnflag AS entity_type, arg_max(source, o) AS source, arg_max(l_returnflag, o) AS t FROM (SELECT *, 'o' || l_orderkey AS source, (l_orderkey, l_linenumber) AS o FROM lineitem) GROUP BY 1, 2),
 l AS (SELECT 's' || l_suppkey AS entity_id, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS entity_type, arg_max('o' || l_orderkey, (l_orderkey, l_linenumber)) AS s FROM lineitem GROUP BY 1),
 g AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, arg_max('o' || l_orderkey, (l_orderkey, l_linenumber)) AS s FROM lineitem GROUP BY 1, 2),
 h AS (SELECT src, tgt, coalesce(chunk_id, 'UNKNOWN') AS source_id FROM g LEFT JOIN c ON c.source_id = g.s)"""


@query(f"WITH {CUSTOM} SELECT entity_id, entity_type, coalesce(chunk_id, 'UNKNOWN') AS source_id FROM l LEFT JOIN c ON c.source_id = l.s UNION ALL SELECT src, 'UNKNOWN', min(source_id) FROM h GROUP BY 1")
def custom_graph_nodes(spark, d):
    """Orders are chunks, suppliers entities of order lines; parts are named by relations only."""
    chunks = read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source_id"), text.hash_id("chunk-", F.lit("order "), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    rows = read(spark, d, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("tgt"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("l_returnflag").alias("entity_type"),
        F.concat(F.lit("o"), "l_orderkey").alias("source_id"), "l_orderkey", "l_linenumber",
    )
    order = ["l_orderkey", "l_linenumber"]
    entities = rows.select(F.col("src").alias("entity_id"), "entity_type", "source_id", *order)
    return editing.custom_graph(chunks, entities, rows.select("src", "tgt", "source_id", *order), order)[0]


def _state_sql(cap: int) -> str:
    """Both batches in one statement: batch 0 into nothing, batch 1 into what that left."""
    return f"""WITH r AS (SELECT 's' || l_suppkey AS entity_id, l_returnflag AS entity_type, 'line ' || repeat('x', CAST(l_linenumber % 4 AS INT)) || l_orderkey % 50 AS description, 'c' || l_orderkey AS source_id, l_orderkey // 100 AS time, l_orderkey * 10 + l_linenumber AS place, l_orderkey % 2 AS batch FROM lineitem),
 s AS (SELECT entity_id, source_id, min((batch, time, place)) AS seen FROM r GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seen, source_id) AS nth FROM s),
 k AS (SELECT r.* FROM r JOIN n USING (entity_id, source_id) WHERE nth <= {cap}),
 v AS (SELECT batch, entity_id, entity_type, count(*) AS n, min((0, time, place)) AS f FROM k GROUP BY 1, 2, 3),
 t0 AS (SELECT entity_id, entity_type FROM v WHERE batch = 0 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, f) = 1),
 w AS (SELECT entity_id, entity_type, n, f FROM v WHERE batch = 1 UNION ALL SELECT entity_id, entity_type, 1, (1, 0, 0) FROM t0),
 x AS (SELECT entity_id, entity_type, sum(n) AS n, min(f) AS f FROM w GROUP BY 1, 2),
 t AS (SELECT entity_id, entity_type FROM x QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, f) = 1),
 d AS (SELECT entity_id, batch, description, min((time, place)) AS f FROM k GROUP BY 1, 2, 3),
 j AS (SELECT entity_id, string_agg(description, '<SEP>' ORDER BY batch, f[1], length(description) DESC, f[2]) AS description FROM d GROUP BY 1),
 i AS (SELECT entity_id, string_agg(source_id, '<SEP>' ORDER BY seen, source_id) FILTER (WHERE nth <= {cap}) AS source_id, count(*) AS n_sources FROM n GROUP BY 1)
SELECT entity_id, entity_type, description, source_id, n_sources FROM t JOIN j USING (entity_id) JOIN i USING (entity_id)"""


@query(_state_sql(20).replace("f[1]", "struct_extract(f, 1)").replace("f[2]", "struct_extract(f, 2)"))
def merged_into_state(spark, d):
    """Records of even orders are merged into an empty graph, those of odd orders into what that gives."""
    li = read(spark, d, "lineitem")
    label = F.concat(F.lit("line "), F.repeat(F.lit("x"), (F.col("l_linenumber") % 4).cast("int")), F.col("l_orderkey") % 50)
    rows = li.select(
        F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("entity_type"), label.alias("description"), F.concat(F.lit("c"), "l_orderkey").alias("source_id"),
        F.floor(F.col("l_orderkey") / 100).alias("time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), (F.col("l_orderkey") % 2).alias("batch"),
    )
    nodes = tracking = None
    for batch in (0, 1):
        nodes, tracking = editing.merge_into(nodes, tracking, rows.filter(F.col("batch") == batch).drop("batch"), batch, cap=20)
    order = F.array_sort(F.collect_list(F.struct("seen", "source_id")))
    kept = editing.sources(tracking, 20).groupBy("entity_id").agg(F.array_join(F.transform(order, lambda x: x["source_id"]), "<SEP>").alias("source_id"))
    return nodes.join(kept, "entity_id").join(tracking.groupBy("entity_id").agg(F.count("*").alias("n_sources")), "entity_id")


# keys


@query("SELECT doc_id, 'mix:' || source || ':' || md5(lang || source) AS key, 'mix' AS mode, source AS cache_type, md5(lang || source) AS hash FROM documents")
def cache_keys(spark, d):
    key = read(spark, d, "documents").select("doc_id", text.cache_key(F.lit("mix"), F.col("source"), F.col("lang"), F.col("source")).alias("key"))
    return key.withColumn("p", text.parsed_cache_key(F.col("key"))).select("doc_id", "key", "p.mode", "p.cache_type", "p.hash")


@query("SELECT item_id, h[1:12] || '4' || h[14:16] || ['8', '9', 'a', 'b'][1 + (strpos('0123456789abcdef', h[17]) - 1) % 4] || h[18:32] AS uuid FROM (SELECT item_id, sha256(text) AS h FROM benchmark)")
def uuids_of_texts(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.uuid_of(F.col("text")).alias("uuid"))


# scores of long documents


LONG = """w AS (SELECT l_orderkey, l_linenumber, ['Integer', 'Float', 'String', 'List', 'None'][1 + CAST((l_orderkey + l_linenumber) % 5 AS INTEGER)] AS format, l_linenumber AS i, l_suppkey % 7 AS j, l_discount AS a, l_tax AS b, l_returnflag AS r, ['A', 'N', 'R'][1 + CAST(l_suppkey % 3 AS INTEGER)] AS s FROM lineitem),
 z AS (SELECT l_orderkey, l_linenumber, format, CASE format
   WHEN 'Integer' THEN CASE WHEN i = j THEN 1.0 ELSE 0.0 END
   WHEN 'Float' THEN CASE WHEN """ + " OR ".join(f"abs({r} - b) <= 0.01 * greatest(abs({r}), abs(b)) OR round({r}, 2) = round(b, 2)" for r in ("a / 100", "a", "a * 100")) + """ THEN 1.0 ELSE 0.0 END
   WHEN 'List' THEN ((CASE WHEN r = s THEN 1.0 ELSE 0.0 END) + 1.0) / 2 * sqrt(2.0 / 3)
   ELSE CASE WHEN r = s THEN 1.0 ELSE 0.0 END END::DOUBLE AS score FROM w)"""


@query(f"WITH {LONG} SELECT l_orderkey, l_linenumber, format, round(score, 6) AS score FROM z")
def document_answer_scores(spark, d):
    """Answers with commas, units and currency, put together from order lines."""
    li = read(spark, d, "lineitem")
    kind = F.get(F.array(*(F.lit(f) for f in ("Integer", "Float", "String", "List", "None"))), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int"))
    other = F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("l_suppkey") % 3).cast("int"))
    answer = F.when(kind == "Integer", F.concat(F.lit("$1,00"), "l_linenumber")).when(kind == "Float", F.concat(F.col("l_discount").cast("string"), F.lit(" kg"))).otherwise(F.col("l_returnflag"))
    pred = F.when(kind == "Integer", F.concat((1000 + F.col("l_suppkey") % 7).cast("string"), F.lit(" Miles"))).when(kind == "Float", F.concat(F.col("l_tax").cast("string"), F.lit("%"))).otherwise(other)
    listed = kind == "List"
    rows = li.select("l_orderkey", "l_linenumber", kind.alias("format"), F.when(listed, F.array(answer, F.lit("alpha"))).otherwise(F.array(answer)).alias("answer"), F.when(listed, F.array(pred, F.lit("Alpha"), F.lit("other"))).otherwise(F.array(pred)).alias("pred"))
    return rows.select("l_orderkey", "l_linenumber", "format", F.round(scoring.document_answer_score(F.col("answer"), F.col("pred"), F.col("format")), 6).alias("score"))


FINE = """q AS (SELECT ['Understanding', 'Reasoning', 'Locating'][1 + doc_id % 3] AS task, ['topic2title', 'summary2title', 'summary2tab', 'extract_fig2tab', 'other'][1 + doc_id % 5] AS kind,
   list_filter(['Text', 'Layout', 'Figure', 'Table', 'Chart'], lambda x, i: (doc_id >> (i - 1)) & 1 = 1) AS e, doc_id % 4 AS pages, CAST(quality AS DOUBLE) AS score FROM labels),
 p AS (SELECT *, CASE WHEN pages > 1 THEN 'Multi_Page' WHEN pages = 1 THEN 'Single_Page' END AS pg FROM q),
 u AS (SELECT *, unnest(e) AS el FROM p),
 a AS (SELECT 'Main_Task' AS dimension, task AS value, score FROM p UNION ALL SELECT 'Evidence_Pages', pg, score FROM p UNION ALL SELECT 'Num_of_Element_Types', 'Cross_Element', score FROM p WHERE len(e) > 1
   UNION ALL SELECT 'Element_Type', el, score FROM u WHERE el <> 'Chart' UNION ALL SELECT 'Fine_Grained', '/' || task || '/' || pg || '/' || el, score FROM u WHERE el <> 'Chart' AND task <> 'Locating'
   UNION ALL SELECT 'Fine_Grained', '/Locating/Cross_Element/' || CASE kind WHEN 'topic2title' THEN 'Cross_Title' WHEN 'summary2title' THEN 'Para_Title' WHEN 'summary2tab' THEN 'Cross_Table' WHEN 'extract_fig2tab' THEN 'Figure_Table' END, score FROM p WHERE task = 'Locating')"""


@query(f"WITH {FINE} SELECT dimension, value, count(*) AS n, round(sum(score), 6) AS total, round(avg(score), 6) AS score FROM a WHERE value IS NOT NULL GROUP BY 1, 2")
def fine_grained_scores(spark, d):
    q, pick = read(spark, d, "labels"), lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % n).cast("int"))
    elements = F.filter(F.array(*map(F.lit, ("Text", "Layout", "Figure", "Table", "Chart"))), lambda x, i: F.getbit("doc_id", i) == 1)
    rows = q.select(
        pick(("Understanding", "Reasoning", "Locating"), 3).alias("task_tag"), pick(("topic2title", "summary2title", "summary2tab", "extract_fig2tab", "other"), 5).alias("question_type"),
        elements.alias("evidence_sources"), (F.col("doc_id") % 4).alias("pages"), F.col("quality").cast("double").alias("score"),
    )
    return scoring.fine_grained(rows)


# document tables


@query("SELECT doc_id AS id, CASE WHEN s = 'processed' AND doc_id % 3 = 0 THEN 'preprocessed' ELSE s END AS status FROM (SELECT doc_id, ['pending', 'processing', 'processed', 'failed'][1 + doc_id % 4] AS s FROM documents)")
def derived_status(spark, d):
    states = F.array(*(F.lit(s) for s in ("pending", "processing", "processed", "failed")))
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(states, (F.col("doc_id") % 4).cast("int")).alias("status"), (F.col("doc_id") % 3 != 0).alias("multimodal_processed"))
    return documents.derived_status(rows).select("id", "status")


@query("SELECT l_orderkey AS doc, count(DISTINCT l_suppkey) AS entities, count(DISTINCT (l_partkey, l_suppkey)) AS relations FROM lineitem GROUP BY 1")
def document_counts(spark, d):
    """Entities and relations of each document by the chunks that its records come from."""
    r = tables.relations(spark, d)
    chunks = r.select(F.col("source_id").alias("chunk_id"), F.col("ord1").alias("doc")).distinct()
    return documents.counts_by_document(r.select("source_id", F.col("tgt").alias("entity_id")), r.select("source_id", "src", "tgt"), chunks)
