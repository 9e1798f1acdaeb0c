"""Continuous ingest: new documents from a folder are cleaned, de-duplicated and merged into written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import enqueue


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, source string", archive: str | None = None) -> DataFrame:
    """New Parquet files of a folder; with ``archive`` they are moved there when they have been read."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(path)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the documents that ``target`` doesn't have, batch by batch; a repeated batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = enqueue(batch.select("doc_id", "text", "source"), "doc_id")
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(target).filter(F.col("batch") != batch_id).select("id"), "id", "left_anti")
        # a batch that is run again replaces its own partition
        new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
