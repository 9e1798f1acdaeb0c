"""What the operators of this subpackage share: the shared folder, written tables, row keys."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is made and set where the setting is missing (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(column: str | Column = "text") -> Column:
    """Tells apart rows that share an id; rows equal in id and text are one document to every operator here."""
    return F.xxhash64(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def fold(id_column: str | Column, parts: int = 3) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % parts


def presence(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of ``2**bits`` bits, packed in words, in which the low bits of every value of a column of hashes are set.

    Its size doesn't depend on the table's. Tasks leave rows out by it before they shuffle; what chance lets
    through leaves in the join that follows.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    words = rows.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def maybe_present(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    own = values.view(np.uint64) & np.uint64(64 * len(held) - 1)
    return (held[own >> np.uint64(6)] >> (own & np.uint64(63)) & np.uint64(1)).astype(bool)
