"""Five stages from raw documents to packed sequences; each works on all that the one before kept.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but
the last return the columns of documents. ``run`` writes each stage as Parquet in the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold, table, written
from graphloom.llm.lines import dedup_lines
from graphloom.llm.mixing import pareto_mix, word_count
from graphloom.llm.packing import pack_documents
from graphloom.llm.simhash import keep_one_each
from graphloom.llm.toxicity import clean_documents, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. Labels are learnt from the rows outside the held-out fold."""
    model = train(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1))
    return clean_documents(docs, model, threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from texts; a document that was all repeats stays, empty. ``n_chars`` follows."""
    clean = dedup_lines(docs).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8."""
    return keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = pareto_mix(docs, word_count(F.col("text"))).filter("copies > 0")
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, capacity=1024)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash_dedup), ("mixing", mix_sources), ("packing", packing)]

#: Trained scores, shingle classes and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
