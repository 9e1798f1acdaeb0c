"""Source tables in the engine's model: documents, chunks, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_id, tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """Files of a folder and its sub-folders as ``file_path, content``; undecodable and blank files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    return files.select(F.col("path").alias("file_path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content")).filter("content is not null and trim(content) <> ''")


def read_content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Typed blocks of parsed documents (JSON arrays) as ``file_path, ord, block...``."""
    fields = "type:string,text:string,text_level:int,img_path:string,image_caption:array<string>,table_caption:array<string>,table_body:string,latex:string,text_format:string,content:string,page_idx:int"
    raw = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file_path"), F.from_json("value", f"array<struct<{fields}>>").alias("blocks"))
    return raw.select("file_path", F.posexplode("blocks").alias("ord", "b")).select("file_path", "ord", "b.*")


def chunks(docs: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` tokens every ``size - overlap``; a last window of overlap alone is a chunk too."""
    step = size - overlap
    t = docs.select("doc_id", "source", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    starts = t.select("doc_id", "source", "t", F.posexplode(F.sequence(F.lit(0), F.size("t") - 1, F.lit(step))).alias("chunk_order_index", "start"))
    content = F.array_join(F.slice("t", F.col("start") + 1, F.lit(size)), " ")
    return starts.select(F.col("doc_id").alias("full_doc_id"), "chunk_order_index", F.least(F.lit(size), F.size("t") - F.col("start")).alias("tokens"), content.alias("content"), F.col("source").alias("file_path")).withColumn("chunk_id", hash_id("chunk-", F.col("content")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted relations: a part is supplied under an order line. Undirected, src < tgt; the order is the chunk."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("tgt"), F.col("l_quantity").alias("weight"), F.concat_ws(",", "l_returnflag", "l_linestatus").alias("keywords"), F.concat(F.lit("c"), "l_orderkey").alias("source_id"), F.col("l_orderkey").alias("ord1"), F.col("l_linenumber").alias("ord2"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("description"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("supplier").alias("entity_type"), F.col("s_name").alias("description"))
    return p.unionByName(s)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
