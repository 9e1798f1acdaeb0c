"""Numbered markers for the images that chunks name: the first mention of each image is marked, all in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

# How a chunk names an image, the modalities whose chunks are searched, and the marker.
IMAGE_PATH = "(?i)Image Path:\\s*([^\\r\\n]*?\\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif))"
IMAGE_MODALITIES = ("image", "table")
MARKER = "[VLM_IMAGE_%d]"


def image_path(content: Column) -> Column:
    """The first image that a text names, null where there is none. Takes the longest name in its line."""
    found = F.regexp_extract(content, "(?i)Image Path:\\s*([^\\r\\n]+\\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif))", 1)
    return F.nullif(F.trim(found), F.lit(""))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``order`` within ``by``, however many rows a key holds.

    Rows are dealt by range and written; each range counts its own rows of a key and starts from the sum of those
    before it. ``order`` must tell the rows of a key apart; nulls come first.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    met = own.join(starts, same)
    return met.select(*rows.columns, (F.col("_start") + F.col("_own")).alias(name))


def images(chunks: DataFrame, by: list[str], readable: DataFrame | None = None) -> DataFrame:
    """Rows ``*by, path, ord, chunk_id, mention, marker_num``: each image that image and table chunks of a key name, numbered by
    first mention (``ord``, ``chunk_id``, then place in the text). With ``readable`` (column ``path``) others have no number.

    ``chunks`` has ``*by, ord, chunk_id, content, modality``; ``by`` may be empty. Chunks with a null or empty content or another
    modality name none. Mentions are reduced to one row an image before they are numbered; nothing is gathered by key.
    """
    held = chunks.filter(F.col("modality").isin(*IMAGE_MODALITIES))
    found = held.select(*by, "ord", "chunk_id", F.posexplode(F.regexp_extract_all("content", F.lit(IMAGE_PATH), F.lit(1))).alias("mention", "path")).withColumn("path", F.trim("path"))
    if readable is not None:
        found = found.join(readable.select("path").distinct(), "path", "left_semi")
    first = found.groupBy(*by, "path").agg(F.min(F.struct("ord", "chunk_id", "mention")).alias("f")).select(*by, "path", "f.*")
    return numbered(first, by, ["ord", "chunk_id", "mention"], "marker_num")


def marked(chunks: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``chunks`` whose first mentions of images (rows of ``images``) are followed by their marker on a line of its own.

    Later mentions and all other chunks stay as they are. A chunk's numbers are gathered by chunk: at most as many as it has
    mentions. A (key, ord, chunk_id) that comes twice is marked twice.
    """
    keys = [*by, "ord", "chunk_id"]
    own = found.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys))).agg(F.map_from_entries(F.collect_list(F.struct("mention", "marker_num"))).alias("_numbers"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    shown = F.col("modality").isin(*IMAGE_MODALITIES) & F.col("_numbers").isNotNull()
    told = F.regexp_extract_all("content", F.lit(IMAGE_PATH), F.lit(0))
    paths = F.regexp_extract_all("content", F.lit(IMAGE_PATH), F.lit(1))
    pieces = F.transform(
        F.arrays_zip(F.split("content", IMAGE_PATH, -1).alias("before"), told.alias("told"), paths.alias("path")),
        lambda p, i: F.concat(p["before"], F.when(F.col("_numbers")[i].isNotNull(), F.concat(F.lit("Image Path: "), F.trim(p["path"]), F.lit("\n"), F.format_string(MARKER, F.col("_numbers")[i]))).otherwise(F.coalesce(p["told"], F.lit("")))),
    )
    new = F.when(shown, F.array_join(pieces, "")).otherwise(F.col("content"))
    return chunks.join(own, same, "left").select(*(new.alias(c) if c == "content" else F.col(c) for c in chunks.columns))
