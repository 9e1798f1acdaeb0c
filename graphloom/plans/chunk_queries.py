"""Chunks by a tokenizer of one's own, and markers of the images that chunks name, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, markers
from ..sources.tables import read
from .catalog import CHUNKS, query


@query(f"WITH {CHUNKS} SELECT full_doc_id AS doc_id, chunk_order_index, tokens, md5(content) AS content FROM c")
def chunks_by_hook(spark, d):
    """The white-space case of the hook: what ``chunk_documents`` gives."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    return chunking.token_chunks(docs, size=120, overlap=20).select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 w AS (SELECT doc_id, i, part, list_filter(string_split_regex(part, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t FROM p),
 c AS (SELECT doc_id, i, 0 AS start, CAST(len(t) AS INTEGER) AS tokens, regexp_replace(part, '^\s+|\s+$', '', 'g') AS content FROM w WHERE len(t) <= 40
  UNION ALL SELECT doc_id, i, start, CAST(least(40, len(t) - start) AS INTEGER), array_to_string(t[start + 1 : start + 40], ' ')
  FROM (SELECT *, unnest(range(0, len(t), 32)) AS start FROM w WHERE len(t) > 40))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, start) - 1 AS INTEGER) AS chunk_order_index, tokens, md5(content) AS content FROM c""")
def chunks_by_lines(spark, d):
    """Lines are chunks; those of over 40 words are cut into windows."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    return chunking.token_chunks(docs, size=40, overlap=8, split_by="\n").select("doc_id", "chunk_order_index", "tokens", F.md5("content").alias("content"))


MENTION = """concat(CASE WHEN l_returnflag = 'R' THEN 'IMAGE PATH:' ELSE 'Image Path:  ' END, 'img/', l_partkey, CASE WHEN l_partkey % 3 = 0 THEN '.JPG' ELSE '.png' END)"""
MENTIONS = f"""l AS (SELECT o_orderpriority AS topic, o_orderkey, l_partkey, {MENTION} AS said,
  o_orderkey * 1000000 + row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, {MENTION}) AS spot,
  concat('img/', l_partkey, CASE WHEN l_partkey % 3 = 0 THEN '.JPG' ELSE '.png' END) AS path,
  CASE o_orderstatus WHEN 'F' THEN 'image' WHEN 'O' THEN 'table' ELSE 'text' END AS modality
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
 f AS (SELECT topic, path, min(spot) AS place FROM l WHERE modality <> 'text' AND l_partkey % 11 <> 0 GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY place) AS marker_num FROM f)"""


def _told(spark, d):
    """A chunk for each order, which names its lines' parts; the order's priority is the topic."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.expr(MENTION).alias("said"))
    told = lines.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "said"))), lambda x: F.concat(x["said"], F.lit(" is shown\n"))), "").alias("content"))
    kind = F.when(F.col("o_orderstatus") == "F", "image").when(F.col("o_orderstatus") == "O", "table").otherwise("text")
    own = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), kind.alias("modality"))
    return own.join(told, "o_orderkey").drop("o_orderkey")


def _images(spark, d, chunks):
    """Every eleventh part has no image that can be read."""
    part = F.col("p_partkey")
    readable = read(spark, d, "part").filter(part % 11 != 0).select(F.concat(F.lit("img/"), part, F.when(part % 3 == 0, ".JPG").otherwise(".png")).alias("path"))
    return markers.images(chunks, ["topic"], readable)


@query(f"WITH {MENTIONS} SELECT topic, path, 'c' || (place // 1000000) AS chunk_id, marker_num FROM n")
def numbered_images(spark, d):
    return _images(spark, d, _told(spark, d)).select("topic", "path", "chunk_id", "marker_num")


@query(f"""WITH {MENTIONS}, m AS (SELECT l.topic, o_orderkey, spot, modality,
  CASE WHEN marker_num IS NULL THEN said ELSE 'Image Path: ' || l.path || chr(10) || '[VLM_IMAGE_' || marker_num || ']' END || ' is shown' || chr(10) AS said
  FROM l LEFT JOIN n ON n.topic = l.topic AND n.path = l.path AND place = spot AND modality <> 'text')
SELECT topic, 'c' || o_orderkey AS chunk_id, modality, string_agg(said, '' ORDER BY spot) AS content FROM m GROUP BY 1, 2, 3""")
def marked_chunks(spark, d):
    chunks = _told(spark, d)
    return markers.marked(chunks, _images(spark, d, chunks), ["topic"]).select("topic", "chunk_id", "modality", "content")
