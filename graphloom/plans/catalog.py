"""All queries of the knowledge-graph engine by name, with the SQL that they are held against.

The test tables stand in for the engine's: documents for documents, order lines for relations between
parts and suppliers, conversations for content blocks, events for status and cache logs, labels for scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lists, numbers, text
from ..operators import blocks, documents, evidence, extraction, graph, merge, retrieval, scoring
from ..sources import tables
from ..sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _clean_sql(column: str) -> str:
    """What ``text.sanitize`` does."""
    t = rf"regexp_replace({column}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    for name, char in text.ESCAPES:
        t = f"replace({t}, '{name}', chr({ord(char)}))"
    return rf"trim(regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'))"


EDGES = "e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, sum(l_quantity) AS weight, count(*) AS n FROM lineitem GROUP BY 1, 2)"
NODES = "v AS (SELECT 'p' || p_partkey AS entity_id, p_brand AS entity_type, p_name AS description FROM part UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name FROM supplier)"
DEGREE = "d AS (SELECT entity_id, count(*) AS degree FROM (SELECT src AS entity_id FROM e UNION ALL SELECT tgt FROM e) GROUP BY 1)"
RANKED = "k AS (SELECT e.*, a.degree + b.degree AS rank FROM e JOIN d a ON a.entity_id = e.src JOIN d b ON b.entity_id = e.tgt)"
COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
CHUNKS = r"""t AS (SELECT doc_id, source, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents),
 s AS (SELECT doc_id, source, t, unnest(range(0, len(t), 100)) AS start FROM t),
 c AS (SELECT doc_id AS full_doc_id, CAST(start // 100 AS INTEGER) AS chunk_order_index, CAST(least(120, len(t) - start) AS INTEGER) AS tokens,
       array_to_string(t[start + 1 : start + 120], ' ') AS content, source AS file_path FROM s)"""
SEEDS = "seed AS (SELECT 's' || s_suppkey AS entity_id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS ord FROM supplier QUALIFY ord <= 5)"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    top = read(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5)
    return top.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("ord"))


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return read(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


# vectors


@query(f"WITH q AS (SELECT embedding AS b FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id, {COS.format(a='embedding', b='b')} AS similarity FROM embeddings, q) SELECT vec_id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INTEGER) AS ord, label FROM (SELECT h.*, label FROM h JOIN embeddings USING (vec_id) WHERE similarity >= 0.2 ORDER BY similarity DESC, vec_id LIMIT 20)")
def vector_top_k(spark, d):
    return retrieval.vector_hits(read(spark, d, "embeddings"), first_vector(spark, d), 20)


@query(f"WITH q AS (SELECT embedding AS b FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id, label, {COS.format(a='embedding', b='b')} AS similarity FROM embeddings, q WHERE label % 2 = 0) SELECT vec_id, label, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INTEGER) AS ord FROM h WHERE similarity >= 0.0 ORDER BY similarity DESC, vec_id LIMIT 20")
def modality_vector_top_k(spark, d):
    return retrieval.vector_hits(read(spark, d, "embeddings").filter("label % 2 = 0"), first_vector(spark, d), 20, threshold=0.0)


@query("WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.u, b.u), 6) AS score FROM u a, u b WHERE b.vec_id = 1 ORDER BY score DESC, a.vec_id LIMIT 15")
def inner_product_of_unit_vectors(spark, d):
    v = read(spark, d, "embeddings")
    q = v.filter("vec_id = 1").select(numbers.unit(F.col("embedding")).alias("q"))
    scored = v.crossJoin(F.broadcast(q)).select("vec_id", F.round(numbers.dot(numbers.unit(F.col("embedding")), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(15)


# documents


@query(f"WITH c AS (SELECT doc_id, source, {_clean_sql('text')} AS t FROM documents), f AS (SELECT 'doc-' || md5(t) AS id, arg_min(t, doc_id) AS t, arg_min(coalesce(source, 'unknown_source'), doc_id) AS file_path FROM c WHERE t <> '' GROUP BY 1) SELECT id, file_path, CAST(length(t) AS INTEGER) AS content_length, CASE WHEN length(trim(t)) <= 250 THEN trim(t) ELSE left(trim(t), 250) || '...' END AS content_summary, 'pending' AS status FROM f")
def enqueue_documents(spark, d):
    return documents.enqueue(read(spark, d, "documents"), "doc_id")


@query(f"WITH {CHUNKS} SELECT *, 'chunk-' || md5(content) AS chunk_id FROM c")
def chunk_documents(spark, d):
    return tables.chunks(read(spark, d, "documents"))


@query("SELECT s.status, coalesce(n, 0) AS n FROM (VALUES ('pending'), ('processing'), ('preprocessed'), ('processed'), ('failed')) s(status) LEFT JOIN (SELECT ['pending', 'processing', 'processed', 'failed'][1 + user_id % 4] AS status, count(*) AS n FROM events GROUP BY 1) USING (status) UNION ALL SELECT 'all', count(*) FROM events")
def status_counts(spark, d):
    states = F.array(*(F.lit(s) for s in ("pending", "processing", "processed", "failed")))
    return documents.status_counts(read(spark, d, "events").select(F.get(states, (F.col("user_id") % 4).cast("int")).alias("status")))


@query("SELECT doc_id AS id, n_chars AS create_time, source, count(*) OVER () AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25")
def paginated_documents(spark, d):
    rows = read(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("create_time"), "source")
    return documents.page(rows, "create_time", 2, 25)


@query("SELECT 2 * l.doc_id AS doc_id, l.doc_id AS ord, lang, n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = 2 * l.doc_id")
def documents_by_ids(spark, d):
    """Twice every labelled id is looked up, so that about half are misses."""
    ids = read(spark, d, "labels").select((2 * F.col("doc_id")).alias("doc_id"), F.col("doc_id").alias("ord"))
    return documents.by_ids(ids, read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_document_keys(spark, d):
    return documents.new_keys(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, min(ts) AS create_time, max(ts) AS update_time FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    return documents.last_write(read(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id"), "user_id", ["ts", "event_id"])


@query("SELECT d.doc_id AS id, s.status, CASE WHEN l.doc_id IS NULL THEN CASE WHEN s.status = 'failed' THEN 'keep' ELSE 'delete' END WHEN s.status IN ('processing', 'failed') THEN 'pending' ELSE 'keep' END AS action FROM documents d JOIN (SELECT doc_id, ['pending', 'processing', 'processed', 'failed'][1 + doc_id % 4] AS status FROM documents) s USING (doc_id) LEFT JOIN labels l USING (doc_id)")
def consistency_actions(spark, d):
    states = F.array(*(F.lit(s) for s in ("pending", "processing", "processed", "failed")))
    status = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(states, (F.col("doc_id") % 4).cast("int")).alias("status"))
    return documents.consistency(status, read(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("WITH t AS (SELECT DISTINCT 's' || l_suppkey AS key, 'c' || l_orderkey AS chunk_id, l_orderkey % 3 = 0 AS hit FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'c' || l_orderkey, l_orderkey % 3 = 0 FROM lineitem), n AS (SELECT key, count(*) AS chunks, count(*) FILTER (WHERE hit) AS lost FROM t GROUP BY 1) SELECT *, CASE WHEN lost = 0 THEN 'unchanged' WHEN lost = chunks THEN 'delete' ELSE 'rebuild' END AS action FROM n")
def deletion_impact(spark, d):
    r = tables.relations(spark, d)
    tracking = r.select(F.explode(F.array("src", "tgt")).alias("key"), F.col("source_id").alias("chunk_id")).distinct()
    gone = read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"))
    lines = read(spark, d, "lineitem").filter("l_orderkey % 3 = 0").select(F.concat(F.lit("c"), "l_orderkey").alias("chunk_id"))
    return documents.deletion_impact(tracking, gone.union(lines))


@query("WITH k AS (SELECT 'c' || user_id AS chunk_id, event_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)) SELECT chunk_id, event_id AS cache_id, ts AS create_time, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY ts, event_id) AS INTEGER) AS nth, min(ts) OVER (PARTITION BY chunk_id) AS earliest, 'extract' AS cache_type FROM k")
def cached_extractions(spark, d):
    e = read(spark, d, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    cache = e.select(F.col("event_id").alias("cache_id"), F.when(F.col("event_type") == kind, "extract").otherwise("query").alias("cache_type"), F.col("ts").alias("create_time"))
    links = e.select(F.concat(F.lit("c"), "user_id").alias("chunk_id"), F.col("event_id").alias("cache_id"))
    return documents.cached_for_chunks(links, cache)


# merging


MERGE_RECORDS = "r AS (SELECT 's' || l_suppkey AS entity_id, l_returnflag AS entity_type, 'line ' || l_linenumber AS description, 'c' || l_orderkey AS source_id, l_orderkey AS a, l_linenumber AS b FROM lineitem)"


def _records(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("entity_type"), F.concat(F.lit("line "), "l_linenumber").alias("description"), F.concat(F.lit("c"), "l_orderkey").alias("source_id"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"))


def _merge_sql(slice_: str) -> str:
    return f"""WITH {MERGE_RECORDS},
 k AS (SELECT entity_id, entity_type, count(*) AS n, min((a, b)) AS f FROM r GROUP BY 1, 2),
 t AS (SELECT entity_id, entity_type FROM k QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, f) = 1),
 x AS (SELECT entity_id, description, min((a, b)) AS f FROM r GROUP BY 1, 2),
 y AS (SELECT entity_id, string_agg(description, '<SEP>' ORDER BY f, description) AS description FROM x GROUP BY 1),
 z AS (SELECT entity_id, source_id, min((a, b)) AS f FROM r GROUP BY 1, 2),
 w AS (SELECT entity_id, list(source_id ORDER BY f, source_id) AS ids FROM z GROUP BY 1)
SELECT entity_id, entity_type, description, {slice_} AS source_ids, CAST(len(ids) AS INTEGER) AS n_sources FROM t JOIN y USING (entity_id) JOIN w USING (entity_id)"""


@query(_merge_sql("ids[-20:]"))
def merge_nodes_fifo(spark, d):
    return merge.merge_nodes(_records(spark, d), ["a", "b"], cap=20, method="FIFO")


@query(_merge_sql("ids[:20]"))
def merge_nodes_keep(spark, d):
    return merge.merge_nodes(_records(spark, d), ["a", "b"], cap=20, method="KEEP")


@query("SELECT src, tgt, sum(q) AS weight, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT unnest(flatten(list(k))) AS w)) AS keywords, count(DISTINCT c) AS n_sources FROM (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, l_quantity AS q, [l_returnflag, l_linestatus] AS k, l_orderkey AS c FROM lineitem) GROUP BY 1, 2")
def merge_edges(spark, d):
    return merge.merge_edges(tables.relations(spark, d))


@query("SELECT 'c' || l_orderkey AS source_id, list_sort(list(DISTINCT 's' || l_suppkey)) AS entity_names, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS count FROM lineitem GROUP BY 1")
def document_entity_index(spark, d):
    return merge.document_index(_records(spark, d))


@query("WITH a AS (SELECT DISTINCT conv_id AS source_id, role AS entity_id, first_value(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS x, last_value(text) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y FROM conversations) SELECT source_id, entity_id, CASE WHEN length(y) > length(x) THEN y ELSE x END AS description, CASE WHEN length(y) > length(x) THEN 1 ELSE 0 END AS pass FROM a")
def gleaning_merge(spark, d):
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("source_id"), F.col("role").alias("entity_id"))
    return merge.longer_description(c.agg(F.min_by("text", "turn").alias("description")), c.agg(F.max_by("text", "turn").alias("description")))


@query(f"WITH {NODES}, {EDGES}, o AS (SELECT * FROM v WHERE entity_type <> 'supplier') SELECT * FROM o UNION ALL SELECT DISTINCT tgt, 'UNKNOWN', NULL FROM e")
def complete_endpoints(spark, d):
    return graph.complete_endpoints(tables.nodes(spark, d).filter("entity_type <> 'supplier'"), tables.edges(spark, d))


@query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS nation, s_name AS name FROM supplier UNION ALL SELECT 1000000 + s_suppkey, s_nationkey + 100, 'new' FROM supplier WHERE s_suppkey % 5 = 0")
def upsert_attributes(spark, d):
    old = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    change = old.filter("key % 2 = 0").select("key", (F.col("nation") + 100).alias("nation"), F.lit(None).cast("string").alias("name"))
    added = old.filter("key % 5 = 0").select((F.col("key") + 1000000).alias("key"), (F.col("nation") + 100).alias("nation"), F.lit("new").alias("name"))
    return merge.upsert(old, change.union(added), ["key"])


# graph


@query(f"WITH {NODES}, {EDGES}, {DEGREE} SELECT v.*, coalesce(degree, 0) AS degree FROM v LEFT JOIN d USING (entity_id)")
def node_degrees(spark, d):
    return graph.node_degrees(tables.nodes(spark, d), tables.edges(spark, d))


@query(f"WITH {EDGES}, {DEGREE}, {RANKED} SELECT * FROM k")
def edge_degrees(spark, d):
    return graph.edge_degrees(tables.edges(spark, d))


@query(f"WITH {NODES}, {EDGES}, {DEGREE} SELECT entity_id, coalesce(degree, 0) AS degree FROM v LEFT JOIN d USING (entity_id) ORDER BY degree DESC, entity_id LIMIT 300")
def popular_labels(spark, d):
    return graph.popular_labels(tables.nodes(spark, d), tables.edges(spark, d))


@query(f"WITH {NODES} SELECT entity_id, CASE WHEN lower(entity_id) = 's1' THEN 1000 WHEN starts_with(lower(entity_id), 's1') THEN 500 ELSE 100 - length(entity_id) + CASE WHEN contains(lower(entity_id), ' s1') OR contains(lower(entity_id), '_s1') THEN 50 ELSE 0 END END AS score FROM v WHERE contains(lower(entity_id), 's1') ORDER BY score DESC, entity_id LIMIT 50")
def search_labels(spark, d):
    return graph.search_labels(tables.nodes(spark, d), "S1")


@query(f"WITH RECURSIVE {EDGES}, u AS (SELECT src AS a, tgt AS b FROM e UNION ALL SELECT tgt, src FROM e), w(entity_id, depth) AS (SELECT 's1', 0 UNION SELECT b, depth + 1 FROM w JOIN u ON a = entity_id WHERE depth < 2) SELECT entity_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1")
def breadth_first_neighbourhood(spark, d):
    return graph.neighbourhood(tables.edges(spark, d), "s1", 2)


@query(f"WITH {EDGES}, {DEGREE}, o AS (SELECT entity_id FROM d ORDER BY degree DESC, entity_id LIMIT 200) SELECT e.* FROM e WHERE src IN (SELECT * FROM o) AND tgt IN (SELECT * FROM o)")
def top_degree_subgraph(spark, d):
    e = tables.edges(spark, d)
    return graph.induced(e, graph.degrees(e).orderBy(F.desc("degree"), "entity_id").limit(200))


@query(f"WITH {EDGES}, u AS (SELECT src AS node, tgt AS other, weight FROM e UNION ALL SELECT tgt, src, weight FROM e), {SEEDS} SELECT node, other, weight FROM u WHERE node IN (SELECT entity_id FROM seed)")
def adjacency(spark, d):
    s = seeds(spark, d).select(F.col("entity_id").alias("node"))
    return graph.incident(tables.edges(spark, d)).join(F.broadcast(s), "node", "left_semi").select("node", "other", "weight")


@query(f"WITH {EDGES} SELECT * FROM e WHERE tgt NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0)")
def remove_nodes_cascade(spark, d):
    v = tables.nodes(spark, d)
    return graph.without_nodes(v, tables.edges(spark, d), v.filter("entity_type = 'supplier' and cast(substr(entity_id, 2) as int) % 4 = 0"))[1]


@query(f"WITH {EDGES}, m AS (SELECT src, CASE WHEN CAST(substr(tgt, 2) AS INT) % 2 = 1 THEN 's0' ELSE tgt END AS tgt, weight FROM e), f AS (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, weight FROM m WHERE src <> tgt) SELECT src, tgt, max(weight) AS weight, count(*) AS merged FROM f GROUP BY 1, 2")
def merge_entities(spark, d):
    renamed = read(spark, d, "supplier").filter("s_suppkey % 2 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("old"), F.lit("s0").alias("new"))
    return graph.merge_entities(tables.edges(spark, d), renamed)


@query(f"WITH {EDGES} SELECT src, tgt, weight FROM e UNION ALL SELECT tgt, src, weight FROM e")
def export_relations(spark, d):
    return graph.exported(tables.edges(spark, d))


@query(f"""WITH {NODES}, t AS (SELECT 's' || l_suppkey AS entity_id, l_orderkey FROM lineitem UNION ALL SELECT 'p' || l_partkey, l_orderkey FROM lineitem),
 w AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders))
SELECT v.*, n AS chunks FROM v JOIN (SELECT entity_id, count(DISTINCT l_orderkey) AS n FROM t WHERE l_orderkey IN (SELECT o_orderkey FROM w) GROUP BY 1) USING (entity_id)""")
def nodes_by_chunk(spark, d):
    """Entities of the dear orders of the first priority; the order is the chunk."""
    o, r = read(spark, d, "orders"), tables.relations(spark, d)
    bounds = o.agg(F.min("o_orderpriority").alias("least"), F.avg("o_totalprice").alias("mean"))
    chunks = o.crossJoin(F.broadcast(bounds)).filter("o_orderpriority = least and o_totalprice > mean").select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"))
    tracking = r.select(F.explode(F.array("src", "tgt")).alias("entity_id"), "source_id")
    return graph.nodes_of_chunks(tables.nodes(spark, d), tracking, chunks)


@query()
def label_propagation(spark, d):
    return graph.communities(tables.edges(spark, d))


# retrieval


@query(f"WITH {NODES}, {EDGES}, {DEGREE}, {SEEDS} SELECT entity_id, ord, entity_type, description, coalesce(degree, 0) AS rank FROM seed JOIN v USING (entity_id) LEFT JOIN d USING (entity_id)")
def entity_hits_with_degree(spark, d):
    return retrieval.node_data(seeds(spark, d), tables.nodes(spark, d), tables.edges(spark, d))


RELATED = f"{EDGES}, {DEGREE}, {RANKED}, {SEEDS}, re AS (SELECT k.*, seed.ord AS seed_ord FROM k JOIN seed ON k.tgt = entity_id), ro AS (SELECT *, CAST(row_number() OVER (ORDER BY rank DESC, weight DESC, seed_ord, src, tgt) AS INTEGER) AS ord FROM re)"


@query(f"WITH {RELATED} SELECT * FROM ro")
def related_edges(spark, d):
    return retrieval.related_edges(seeds(spark, d), tables.edges(spark, d))


@query(f"WITH {RELATED}, {NODES}, x AS (SELECT ord, 0 AS side, src AS entity_id FROM ro UNION ALL SELECT ord, 1, tgt FROM ro), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ord, side) = 1) SELECT entity_id, entity_type, description, CAST(row_number() OVER (ORDER BY ord, side) AS INTEGER) AS ord FROM y JOIN v USING (entity_id)")
def related_entities(spark, d):
    return retrieval.related_entities(retrieval.related_edges(seeds(spark, d), tables.edges(spark, d)), tables.nodes(spark, d))


@query(f"WITH {NODES}, {RELATED}, l AS (SELECT entity_id, ord FROM seed), g AS (SELECT x.entity_id, CAST(row_number() OVER (ORDER BY x.o, x.side) AS INTEGER) AS ord FROM (SELECT entity_id, min(o) AS o, arg_min(side, o) AS side FROM (SELECT ord AS o, 0 AS side, src AS entity_id FROM ro UNION ALL SELECT ord, 1, tgt FROM ro) GROUP BY 1) x), b AS (SELECT entity_id, ord, 0 AS list FROM l UNION ALL SELECT entity_id, ord, 1 FROM g), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ord, list) = 1) SELECT entity_id, CAST(row_number() OVER (ORDER BY ord, list) AS INTEGER) AS ord FROM f")
def hybrid_entities(spark, d):
    local = seeds(spark, d)
    glob = retrieval.related_entities(retrieval.related_edges(local, tables.edges(spark, d)), tables.nodes(spark, d))
    return retrieval.interleaved([local, glob], ["entity_id"], ["entity_id"])


OWNERS = f"{SEEDS}, ow AS (SELECT entity_id AS owner, ord, list(DISTINCT l_orderkey ORDER BY l_orderkey) AS ids FROM seed JOIN lineitem ON entity_id = 's' || l_suppkey GROUP BY 1, 2), ea AS (SELECT owner, ord, unnest(ids) AS c, generate_subscripts(ids, 1) - 1 AS pos FROM ow), ec AS (SELECT *, count(*) OVER (PARTITION BY c) AS occurrences FROM ea), ef AS (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY c ORDER BY ord, pos) = 1)"


def _owners(spark, d):
    """A row for each chunk of each seed; places are counted within a seed."""
    r = tables.relations(spark, d).select("tgt", "ord1").join(F.broadcast(seeds(spark, d)), F.col("tgt") == F.col("entity_id"))
    each = r.select(F.col("tgt").alias("owner"), "ord", F.col("ord1").alias("chunk_id")).distinct()
    return each.withColumn("pos", F.row_number().over(Window.partitionBy("owner").orderBy("chunk_id")) - 1)


@query(f"WITH {OWNERS} SELECT owner, ord, CAST(pos AS INTEGER) AS pos, c AS chunk_id, occurrences FROM ef")
def entity_chunks(spark, d):
    return retrieval.related_chunks(_owners(spark, d))


@query(f"""WITH {OWNERS}, o AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT ord FROM ef)),
 p AS (SELECT c, ord, rank, row_number() OVER (PARTITION BY ord ORDER BY occurrences DESC, pos, c) AS place, CAST(CASE WHEN n <= 1 THEN 5 ELSE round_even(5 - rank / (n - 1) * 4.0, 0) END AS INTEGER) AS quota FROM ef JOIN o USING (ord)),
 h AS (SELECT sum(greatest(q - has, 0)) AS spare FROM (SELECT ord, max(quota) AS q, count(*) AS has FROM p GROUP BY 1)),
 z AS (SELECT *, sum(CASE WHEN place > quota THEN 1 ELSE 0 END) OVER (ORDER BY rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS refill FROM p)
 SELECT c AS chunk_id, ord, CAST(place AS INTEGER) AS place, CASE WHEN place <= quota THEN 0 ELSE 1 END AS round FROM z, h WHERE place <= quota OR refill <= spare""")
def weighted_polling(spark, d):
    return retrieval.weighted_polling(retrieval.related_chunks(_owners(spark, d)))


@query(f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (ORDER BY full_doc_id, chunk_order_index) AS ord FROM c), u AS (SELECT *, sum(tokens) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM r) SELECT full_doc_id, chunk_order_index, tokens, CAST(used AS BIGINT) AS used FROM u WHERE used <= 6000")
def token_budget(spark, d):
    c = tables.chunks(read(spark, d, "documents")).withColumn("ord", F.struct("full_doc_id", "chunk_order_index"))
    return retrieval.within_budget(c, F.col("tokens"), 6000).select("full_doc_id", "chunk_order_index", "tokens", "used")


@query(f"WITH {CHUNKS}, r AS (SELECT file_path, row_number() OVER (ORDER BY full_doc_id, chunk_order_index) AS ord FROM c), p AS (SELECT file_path, count(*) AS n, min(ord) AS f FROM r GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n DESC, f) AS VARCHAR) AS reference_id, file_path, n FROM p")
def reference_list(spark, d):
    c = tables.chunks(read(spark, d, "documents"))
    return retrieval.references(c.withColumn("ord", F.struct("full_doc_id", "chunk_order_index")))


@query("WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST((conv_id * 7 + turn) % 10 AS DOUBLE) / 10 END AS s, length(text) AS tokens, row_number() OVER (ORDER BY conv_id, turn) AS o FROM conversations), h AS (SELECT *, row_number() OVER (ORDER BY coalesce(s, 1.0) DESC, o) AS ord FROM r WHERE coalesce(s, 1.0) >= 0.5), u AS (SELECT *, sum(tokens) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM h WHERE ord <= 40) SELECT conv_id, turn, CAST(ord AS INTEGER) AS ord, 'DC' || ord AS id FROM u WHERE used <= 4000")
def processed_chunks(spark, d):
    c = read(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, ((F.col("conv_id") * 7 + F.col("turn")) % 10).cast("double") / 10).alias("rerank_score"), F.length("text").alias("tokens"), F.struct("conv_id", "turn").alias("ord"))
    return retrieval.processed_chunks(rows, min_score=0.5, top_k=40, budget=4000).select("conv_id", "turn", "ord", "id")


# evidence


EVIDENCE = "cm AS (SELECT 'c' || o_orderkey AS chunk_id, o_custkey AS doc_id, ['text', 'image', 'table', 'equation'][1 + o_orderkey % 4] AS modality FROM orders), ev AS (SELECT src, tgt, count(*) AS evidence_total_count, CAST(count(DISTINCT doc_id) AS INTEGER) AS evidence_doc_count, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modality FROM (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS tgt, 'c' || l_orderkey AS chunk_id FROM lineitem) JOIN cm USING (chunk_id) GROUP BY 1, 2)"


def _evidence(spark, d):
    kinds = F.array(*(F.lit(m) for m in ("text", "image", "table", "equation")))
    chunks = read(spark, d, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.get(kinds, (F.col("o_orderkey") % 4).cast("int")).alias("modality"))
    return evidence.records(tables.relations(spark, d), chunks)


@query(f"WITH {EVIDENCE} SELECT * FROM ev")
def evidence_records(spark, d):
    return _evidence(spark, d).drop("by_modality")


@query(f"WITH {EVIDENCE}, t AS (SELECT count(*) AS total FROM ev), m AS (SELECT unnest(string_split(modality, ',')) AS modality FROM ev) SELECT modality, count(*) AS n, round(count(*) * 100.0 / any_value(total), 2) AS percentage FROM m, t GROUP BY 1")
def modality_stats(spark, d):
    return evidence.modality_stats(_evidence(spark, d))


def _filter_sql(condition: str) -> str:
    return f"WITH {EVIDENCE}, h AS (SELECT *, string_split(modality, ',') AS m FROM ev) SELECT src, tgt, evidence_total_count, modality FROM h WHERE {condition} AND evidence_total_count >= 2 ORDER BY evidence_total_count DESC, src, tgt LIMIT 100"


@query(_filter_sql("list_has_any(m, ['image', 'table'])"))
def evidence_any_modality(spark, d):
    return evidence.filtered(_evidence(spark, d), ["image", "table"], "OR", least=2, top_k=100).select("src", "tgt", "evidence_total_count", "modality")


@query(_filter_sql("list_has_all(m, ['image', 'table'])"))
def evidence_all_modalities(spark, d):
    return evidence.filtered(_evidence(spark, d), ["image", "table"], "AND", least=2, top_k=100).select("src", "tgt", "evidence_total_count", "modality")


@query(_filter_sql("list_has_all(m, ['image', 'table']) AND len(m) = 2"))
def evidence_only_modalities(spark, d):
    return evidence.filtered(_evidence(spark, d), ["image", "table"], "ONLY", least=2, top_k=100).select("src", "tgt", "evidence_total_count", "modality")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'image content analysis') OR contains(lower(text), 'image path:') THEN 'image' WHEN contains(lower(text), 'table analysis') OR contains(lower(text), 'structure:') THEN 'table' WHEN contains(lower(text), 'mathematical equation') OR contains(lower(text), 'equation:') THEN 'equation' ELSE 'text' END AS modality FROM documents")
def inferred_modality(spark, d):
    return read(spark, d, "documents").select("doc_id", text.modality(F.col("text")).alias("modality"))


# content blocks


BLOCKS = "b AS (SELECT conv_id AS doc, turn AS ord, CASE WHEN role = 'user' THEN 'text' WHEN turn % 4 = 1 THEN 'image' ELSE 'table' END AS type, text, CAST(turn % 3 AS INTEGER) AS text_level, CAST(turn // 2 AS INTEGER) AS page_idx FROM conversations)"


def _blocks(spark, d):
    c = read(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "text").when(F.col("turn") % 4 == 1, "image").otherwise("table")
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), kind.alias("type"), "text", (F.col("turn") % 3).cast("int").alias("text_level"), F.floor(F.col("turn") / 2).cast("int").alias("page_idx"))


@query(f"WITH {BLOCKS} SELECT doc, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE type = 'text' AND trim(text) <> ''), '') AS text, count(*) FILTER (WHERE type <> 'text') AS others FROM b GROUP BY 1")
def separate_content(spark, d):
    return blocks.separated_text(_blocks(spark, d))


LINE = "CASE type WHEN 'text' THEN CASE WHEN text_level > 0 THEN repeat('#', text_level) || ' ' || text ELSE text END WHEN 'image' THEN '[Image: ' || text || ']' ELSE '[Table: ' || text || ']' END"


@query(f"WITH {BLOCKS}, l AS (SELECT *, {LINE} AS line FROM b) SELECT doc, ord, array_to_string(list_concat(coalesce(list(line) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), coalesce(list(line) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), [])), chr(10)) AS context FROM l")
def block_neighbours(spark, d):
    return blocks.neighbours(_blocks(spark, d), 2).select("doc", "ord", "context")


@query(f"WITH {BLOCKS}, p AS (SELECT doc, page_idx, count(*) AS n, sum(length(text)) AS c FROM b GROUP BY 1, 2) SELECT doc, page_idx, CAST(sum(n) OVER w AS BIGINT) AS context_blocks, CAST(sum(c) OVER w AS BIGINT) AS context_chars FROM p WINDOW w AS (PARTITION BY doc ORDER BY page_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def page_context(spark, d):
    return blocks.page_context(_blocks(spark, d), 1)


@query(f"WITH {BLOCKS} SELECT doc, 'doc-' || md5(string_agg(type || ':' || trim(text), chr(10) ORDER BY ord)) AS doc_id FROM b GROUP BY 1")
def content_based_ids(spark, d):
    return blocks.content_id(_blocks(spark, d))


@query(f"WITH {BLOCKS} SELECT type, count(*) AS n, count(DISTINCT doc) AS docs FROM b GROUP BY 1")
def block_types(spark, d):
    return _blocks(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


@query("SELECT least('s' || l_suppkey, 'p' || f) AS src, greatest('s' || l_suppkey, 'p' || f) AS tgt, 'belongs_to,part_of,contained_in' AS keywords, 10.0::DOUBLE AS weight, 'c' || l_orderkey AS source_id FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN (SELECT l_orderkey, min(l_partkey) AS f FROM lineitem GROUP BY 1) USING (l_orderkey)")
def belongs_to(spark, d):
    li = read(spark, d, "lineitem")
    chunk = F.concat(F.lit("c"), "l_orderkey").alias("chunk_id")
    mains = li.groupBy(chunk).agg(F.concat(F.lit("p"), F.min("l_partkey")).alias("main_entity"))
    return blocks.belongs_to(li.select(chunk, F.concat(F.lit("s"), "l_suppkey").alias("entity_id")), mains)


# text


@query(f"SELECT page_id, {_clean_sql('html')} AS t FROM pages")
def sanitize_pages(spark, d):
    return read(spark, d, "pages").select("page_id", text.sanitize(F.col("html")).alias("t"))


@query("SELECT item_id, list_filter(list_transform(string_split(replace(text, ', ', '. '), '. '), lambda x: trim(x)), lambda x: x <> '') AS parts FROM benchmark")
def split_by_markers(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.split_markers(F.col("text"), ". ", ", ").alias("parts"))


@query("SELECT DISTINCT least('p' || l_partkey, 's' || l_suppkey) || '<SEP>' || greatest('p' || l_partkey, 's' || l_suppkey) AS pair, 'rel-' || md5('p' || l_partkey || 's' || l_suppkey) AS id FROM lineitem")
def relation_keys(spark, d):
    return tables.edges(spark, d).select(text.pair_key(F.col("tgt"), F.col("src")).alias("pair"), text.hash_id("rel-", F.col("src"), F.col("tgt")).alias("id"))


@query("SELECT item_id, CASE WHEN length(text) <= 120 THEN text WHEN instr(left(text, 120), '.') > 0 AND 120 - instr(reverse(left(text, 120)), '.') > 96 THEN left(text, 121 - instr(reverse(left(text, 120)), '.')) WHEN instr(left(text, 120), chr(10)) > 0 AND 120 - instr(reverse(left(text, 120)), chr(10)) > 96 THEN left(text, 120 - instr(reverse(left(text, 120)), chr(10))) ELSE left(text, 120) || '...' END AS t FROM benchmark")
def truncate_at_sentence(spark, d):
    return read(spark, d, "benchmark").select("item_id", text.truncate_sentence(F.col("text"), 120).alias("t"))


@query()
def parsed_extractions(spark, d):
    """Extraction output is put together from order lines, with a damaged separator in every fifth."""
    li = read(spark, d, "lineitem")
    sep = F.when(F.col("l_linenumber") % 5 == 0, F.lit("<|#>")).otherwise(F.lit("<|#|>"))
    line = F.concat_ws("\n", F.concat(F.lit("entity"), sep, F.concat(F.lit("Part "), "l_partkey"), sep, F.lit("Part Type"), sep, F.lit("a part")), F.concat(F.lit("relation"), sep, F.concat(F.lit("Part "), "l_partkey"), sep, F.concat(F.lit("Supplier "), "l_suppkey"), sep, F.lit("supplies"), sep, F.lit("is supplied by")))
    out = li.groupBy(F.concat(F.lit("c"), "l_orderkey").alias("chunk_id")).agg(F.concat(F.array_join(F.collect_list(line), "\n"), F.lit("\n<|COMPLETE|>")).alias("output"))
    records = extraction.parsed_records(out)
    found = extraction.entities(records).groupBy("entity_type").agg(F.count("*").alias("n"))
    return found.unionByName(extraction.relations(records).groupBy(F.col("keywords").alias("entity_type")).agg(F.count("*").alias("n")))


ORACLE_SQL["parsed_extractions"] = "SELECT 'parttype' AS entity_type, count(*) AS n FROM lineitem UNION ALL SELECT 'supplies', count(*) FROM lineitem"


# scoring


@query()
def edit_similarity(spark, d):
    """Every turn's whole text against that of the next turn of its conversation; held against plain Python, as SQL counts bytes."""
    c = read(spark, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    pairs = c.withColumnRenamed("text", "reference").join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(numbers.anls(F.col("reference"), F.col("prediction")), 6).alias("score"))


FLOATS = "f AS (SELECT l_discount AS a, l_tax AS b FROM lineitem)"
# half-even rounding to two places; none of these values is half-way between two of them
ROUNDS = "round({r}, 2) = round(b, 2)"


@query(f"WITH {FLOATS} SELECT count(*) AS n, count(*) FILTER (WHERE " + " OR ".join(f"abs({r} - b) <= 0.01 * greatest(abs({r}), abs(b)) OR {ROUNDS.format(r=r)}" for r in ("a / 100", "a", "a * 100")) + ") AS close FROM f")
def float_answers(spark, d):
    return read(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(numbers.float_equal(F.col("l_discount"), F.col("l_tax"))).alias("close"))


JUDGED = "j AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'Not answerable' END AS answer, CASE WHEN toxic = 1 THEN 'Not answerable' ELSE 'yes' END AS pred, CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, lang, source FROM labels JOIN documents USING (doc_id))"


def _judged(spark, d):
    met = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    none = F.lit("Not answerable")
    return met.select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise(none).alias("answer"), F.when(F.col("toxic") == 1, none).otherwise("yes").alias("pred"), ((F.col("quality") == 1) == (F.col("toxic") == 0)).cast("double").alias("score"), "lang", "source")


@query(f"WITH {JUDGED}, m AS (SELECT count(*) AS n, avg(score) AS acc, sum(score) FILTER (WHERE answer <> 'Not answerable') / count(*) FILTER (WHERE answer <> 'Not answerable') AS r, sum(score) FILTER (WHERE answer <> 'Not answerable') / count(*) FILTER (WHERE pred <> 'Not answerable') AS p FROM j) SELECT n, round(acc, 6) AS acc, round(r, 6) AS recall, round(p, 6) AS precision, round(2 * r * p / (r + p), 6) AS f1 FROM m")
def accuracy_and_f1(spark, d):
    return scoring.accuracy_f1(_judged(spark, d))


@query(f"WITH {JUDGED} SELECT 'overall' AS dimension, NULL AS value, count(*) AS n, round(avg(score), 6) AS score FROM j UNION ALL SELECT 'lang', lang, count(*), round(avg(score), 6) FROM j GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(score), 6) FROM j GROUP BY source")
def score_breakdown(spark, d):
    return scoring.breakdown(_judged(spark, d), ["lang", "source"])


ANSWERED = """w AS (SELECT l_orderkey, l_linenumber, ['Int', 'Float', 'Str', 'List', 'None'][1 + CAST((l_orderkey + l_linenumber) % 5 AS INTEGER)] AS format, CAST(l_linenumber AS VARCHAR) AS i, CAST(l_suppkey % 7 AS VARCHAR) AS j, l_discount AS a, l_tax AS b, l_returnflag AS r, l_linestatus AS s FROM lineitem),
 z AS (SELECT l_orderkey, l_linenumber, format, CASE format
   WHEN 'Int' THEN CASE WHEN i = j THEN 1.0 ELSE 0.0 END
   WHEN 'Float' THEN CASE WHEN """ + " OR ".join(f"abs({r} - b) <= 0.01 * greatest(abs({r}), abs(b)) OR {ROUNDS.format(r=r)}" for r in ("a / 100", "a", "a * 100")) + """ THEN 1.0 ELSE 0.0 END
   WHEN 'List' THEN CASE WHEN lower(r) = lower(s) THEN 1.0 ELSE 0.0 END
   ELSE CASE WHEN lower(r) = lower(s) THEN 1.0 ELSE 0.0 END END::DOUBLE AS score FROM w)"""


def _answered(spark, d):
    """Answers of every format put together from order lines: line number and supplier, discount and tax, flag and status."""
    li = read(spark, d, "lineitem")
    formats = F.array(*(F.lit(f) for f in ("Int", "Float", "Str", "List", "None")))
    kind = F.get(formats, ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int"))
    text = lambda c: F.col(c).cast("string")
    answer = F.when(kind == "Int", text("l_linenumber")).when(kind == "Float", text("l_discount")).otherwise(F.col("l_returnflag"))
    pred = F.when(kind == "Int", (F.col("l_suppkey") % 7).cast("string")).when(kind == "Float", text("l_tax")).otherwise(F.col("l_linestatus"))
    both = lambda c: F.when(kind == "List", F.array(c, F.lit("x"))).otherwise(F.array(c))
    return li.select("l_orderkey", "l_linenumber", kind.alias("format"), both(answer).alias("answer"), both(pred).alias("pred"))


@query(f"WITH {ANSWERED} SELECT * FROM z")
def answer_scores(spark, d):
    return _answered(spark, d).select("l_orderkey", "l_linenumber", "format", scoring.answer_score(F.col("answer"), F.col("pred"), F.col("format")).alias("score"))


@query(f"WITH {ANSWERED} SELECT format, count(*) AS n, round(avg(score), 6) AS generalized, round(avg(score) * count(*) / 100000, 6) AS rectified FROM z GROUP BY format")
def generalized_accuracy(spark, d):
    scored = _answered(spark, d).select("format", scoring.answer_score(F.col("answer"), F.col("pred"), F.col("format")).alias("score"))
    return scoring.generalized_accuracy(scored, ["format"], asked=100_000)


@query("WITH q AS (SELECT doc_id AS question_id FROM labels), s AS (SELECT unnest(['image', 'table', 'text', 'image,table', 'image,text', 'table,text', 'image,table,text']) AS subset_key), g AS (SELECT question_id, m.model, subset_key FROM q, (VALUES ('a'), ('b')) m(model), s) SELECT question_id, model, list_aggregate(list_sort(string_split(subset_key, ',')), 'string_agg', ',') AS subset_key FROM g WHERE NOT (model = 'a' AND question_id % 2 = 0 AND subset_key = 'image')")
def experiment_grid(spark, d):
    questions = read(spark, d, "labels").select(F.col("doc_id").alias("question_id"))
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    subsets = spark.range(1).select(F.explode(lists.non_empty_subsets(F.array(F.lit("image"), F.lit("table"), F.lit("text")))).alias("subset"))
    answered = questions.filter("question_id % 2 = 0").select("question_id", F.lit("a").alias("model"), F.lit("image").alias("subset_key"))
    return scoring.unanswered(questions, models, subsets, answered)
