"""Orders as described blocks of their customers' documents: chunks, main entities, lists and completion, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import hash_id
from ..operators import modal
from ..sources.tables import read
from .catalog import query

TOLD = "concat(o_orderpriority, ' ', o_orderstatus, ' ', o_custkey % 9)"
BLOCKS = f"""b AS (SELECT o_custkey AS full_doc_id, o_orderkey AS chunk_order_index, concat('in/', o_custkey, '.pdf') AS file_path, o_orderkey % 5 AS k,
  ['image', 'table', 'equation', 'wide list', NULL][o_orderkey % 5 + 1] AS type, concat('img/', o_custkey % 7, '.png') AS img_path,
  CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE concat(o_orderstatus, ', a') END AS captions, {TOLD} AS told FROM orders),
 x AS (SELECT *, concat('n', chunk_order_index % 997, ' (block)') AS entity_name, CASE coalesce(type, 'generic')
  WHEN 'image' THEN concat(chr(10), 'Image Content Analysis:', chr(10), 'Image Path: ', img_path, chr(10), 'Captions: ', captions, chr(10), 'Footnotes: None', chr(10), chr(10), 'Visual Analysis: ', told)
  WHEN 'table' THEN concat('Table Analysis:', chr(10), 'Image Path: ', img_path, chr(10), 'Caption: ', captions, chr(10), 'Structure: ', full_doc_id % 13, chr(10), 'Footnotes: None', chr(10), chr(10), 'Analysis: ', told)
  WHEN 'equation' THEN concat('Mathematical Equation Analysis:', chr(10), 'Equation: ', full_doc_id % 13, chr(10), 'Format: latex', chr(10), chr(10), 'Mathematical Analysis: ', told)
  ELSE concat(CASE WHEN type IS NULL THEN 'Generic' ELSE 'Wide List' END, ' Content Analysis:', chr(10), 'Content: ', full_doc_id % 13, chr(10), chr(10), 'Analysis: ', told) END AS content FROM b),
 c AS (SELECT *, 'chunk-' || md5(content) AS chunk_id FROM x)"""


def _blocks(spark, d):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(F.lit("image"), F.lit("table"), F.lit("equation"), F.lit("wide list"), F.lit(None).cast("string"))
    return read(spark, d, "orders").select(
        customer.alias("full_doc_id"), key.alias("chunk_order_index"), F.concat(F.lit("in/"), customer, F.lit(".pdf")).alias("file_path"), F.get(kinds, (key % 5).cast("int")).alias("type"),
        F.concat(F.lit("img/"), customer % 7, F.lit(".png")).alias("img_path"), F.when(key % 3 != 0, F.array(F.col("o_orderstatus"), F.lit("a"))).alias("captions"), F.array().cast("array<string>").alias("footnotes"),
        (customer % 13).cast("string").alias("body"), F.lit("latex").alias("text_format"), F.expr(TOLD).alias("description"), F.when(key % 2 == 0, F.lit("short")).alias("summary"),
        F.concat(F.lit("n"), key % 997, F.lit(" (block)")).alias("entity_name"), F.when(key % 4 == 0, F.lit("thing")).alias("entity_type"), F.when(key % 6 != 0, (key % 6).cast("int")).alias("page_idx"),
    )


@query(rf"""WITH {BLOCKS} SELECT chunk_id, content, CAST(len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')) AS INTEGER) AS tokens, full_doc_id, chunk_order_index,
 full_doc_id || '.pdf' AS file_path, true AS is_multimodal, entity_name AS modal_entity_name, coalesce(type, 'generic') AS original_type, CAST(chunk_order_index % 6 AS INTEGER) AS page_idx
FROM c QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY full_doc_id DESC, chunk_order_index DESC) = 1""")
def modal_chunks(spark, d):
    return modal.modal_chunks(_blocks(spark, d))


@query(f"""WITH {BLOCKS} SELECT 'ent-' || md5(entity_name) AS entity_id, entity_name, CASE WHEN chunk_order_index % 4 = 0 THEN 'thing' ELSE coalesce(type, 'generic') END AS entity_type,
 CASE WHEN chunk_order_index % 2 = 0 THEN 'short' ELSE told END AS content, chunk_id AS source_id, full_doc_id || '.pdf' AS file_path
FROM c QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY full_doc_id DESC, chunk_order_index DESC) = 1""")
def main_entities_of_blocks(spark, d):
    return modal.main_entities(_blocks(spark, d))


def _own(blocks):
    return blocks.select("full_doc_id", hash_id("chunk-", modal.chunk_text(blocks)).alias("chunk_id"), "chunk_order_index")


def _listed(spark, d):
    """Each third order's chunk is listed already, then all are appended."""
    own = _own(_blocks(spark, d))
    none = spark.createDataFrame([], "full_doc_id long, chunk_id string, place long")
    return modal.appended_chunks(modal.appended_chunks(none, own.filter("chunk_order_index % 3 = 1")), own)


LISTED = """f AS (SELECT full_doc_id, chunk_id, min(chunk_order_index) FILTER (chunk_order_index % 3 = 1) AS early, min(chunk_order_index) AS late FROM c GROUP BY 1, 2),
 l AS (SELECT full_doc_id, chunk_id, row_number() OVER (PARTITION BY full_doc_id ORDER BY early IS NULL, coalesce(early, late), chunk_id) AS place FROM f)"""


@query(f"WITH {BLOCKS}, {LISTED} SELECT * FROM l")
def listed_chunks(spark, d):
    return _listed(spark, d)


@query(f"""WITH {BLOCKS}, {LISTED}, n AS (SELECT full_doc_id, count(*) AS n FROM l GROUP BY 1), g AS (SELECT DISTINCT full_doc_id, chunk_id FROM c WHERE chunk_order_index % 10 <> 0),
 m AS (SELECT DISTINCT full_doc_id FROM c ANTI JOIN g USING (full_doc_id, chunk_id)),
 s AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'processed' END AS status FROM customer)
SELECT doc_id, status, coalesce(n, 0) AS chunks_count, doc_id NOT IN (SELECT full_doc_id FROM m) AS multimodal_processed,
 status = 'processed' AND doc_id NOT IN (SELECT full_doc_id FROM m) AS fully_processed FROM s LEFT JOIN n ON full_doc_id = doc_id""")
def completed_documents(spark, d):
    own = _own(_blocks(spark, d))
    status = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 4 == 0, "failed").otherwise("processed").alias("status"))
    return modal.completion(status, _listed(spark, d), own, own.filter("chunk_order_index % 10 <> 0"))
