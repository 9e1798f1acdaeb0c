"""Intermediate tables in the folder that the cluster shares, and stored tables with versions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: How tables are packed; ids and other digits take half of what they take unpacked.
CODEC = "zstd"
#: Versions of a bucket that readers put together; one more and the bucket is written anew.
VERSIONS = 8
#: The folder of ``scratch`` that this thread is in, if any; ``in_threads`` hands it on.
SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is made and set where the setting is missing, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{SCRATCH.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, in a form that Spark leaves out of joins and unions."""
    return spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


MANIFEST = "table string, bucket int, at long, batch long"


def in_threads(do: Callable, items: list) -> list:
    """Independent Spark jobs side by side, in the order of ``items``."""
    with ThreadPoolExecutor(len(items) or 1) as pool:
        return [x.result() for x in [pool.submit(copy_context().run, do, item) for item in items]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go at its end, so nothing that reads them may be left by then."""
    own = fresh_path(spark, "scratch")
    before = SCRATCH.set(own)
    try:
        yield
    finally:
        SCRATCH.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class TableStore:
    """Keyed tables under ``root``, each dealt in ``buckets`` by its key's hash; a commit changes all of them together.

    A commit writes under its own version, and then one small file that says which versions each bucket of each table has:
    new rows beside the older ones where no key of these changes, else the bucket anew. Readers go by the newest such file, so
    they see all of a commit or nothing of it. A batch that was committed before changes nothing, and one that died halfway is
    written over.
    """

    spark: SparkSession
    root: str
    tables: dict[str, tuple[StructType, list[str]]]
    buckets: int = 32

    def _state(self) -> tuple[int, int, dict[str, dict[int, list[int]]]]:
        """Newest version, its batch, and the versions of each bucket; bounded by tables times buckets."""
        try:
            rows = self.spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{self.root}/_manifests")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, -1, {}
        last = rows.agg(F.max("version")).first()[0]
        if last is None:
            return 0, -1, {}
        held: dict[str, dict[int, list[int]]] = {}
        batch = -1
        for r in rows.filter(F.col("version") == last).collect():
            batch = r.batch
            if r.bucket is not None:
                held.setdefault(r.table, {}).setdefault(r.bucket, []).append(r.at)
        return last, batch, held

    def _bucket(self, key: list[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, held: dict[int, list[int]], only: set[int] | None = None) -> DataFrame:
        schema, _ = self.tables[table]
        held = {k: v for k, v in held.items() if only is None or k in only}
        if not held:
            return empty(self.spark, schema)
        base = f"{self.root}/{table}"
        paths = sorted({f"{base}/at={v}/bucket={k}" for k, at in held.items() for v in at})
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def read(self, table: str) -> DataFrame:
        """The table as the newest commit left it; empty before the first."""
        return self._read(table, self._state()[2].get(table, {}))

    def last_batch(self) -> int:
        return self._state()[1]

    def commit(self, batch: int, upserts: dict[str, DataFrame], deletes: dict[str, DataFrame] | None = None, new: tuple[str, ...] = ()) -> bool:
        """New rows in place of those of their keys, and the keys of ``deletes`` out, in all tables at once; False for a batch known already.

        What is given is read several times, so it should be tables that don't change. Of the tables ``new`` no key of ``upserts``
        is there yet, so that nothing is looked up.
        """
        version, last, held = self._state()
        if batch <= last:
            return False
        version += 1

        def write(table: str, rows: DataFrame) -> dict[int, list[int]]:
            """Each task writes its rows by bucket where they are, so none reads more for a large one."""
            path = f"{self.root}/{table}/at={version}"
            rows.withColumn("bucket", self._bucket(self.tables[table][1])).write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(path)
            files = self.spark.read.schema(StructType.fromDDL("bucket int")).parquet(path).inputFiles()
            return {int(f.split("/bucket=")[1].split("/")[0]): [version] for f in files if "/bucket=" in f}

        def change(table: str) -> tuple[str, dict[int, list[int]]]:
            schema, key = self.tables[table]
            own, empty_one, gone = held.get(table, {}), empty(self.spark, schema), (deletes or {}).get(table)
            rows = upserts.get(table, empty_one).select(*schema.names)
            full = {k for k, at in own.items() if len(at) >= VERSIONS}
            stale, before = set(full), self._read(table, own)
            if own and (table not in new or gone is not None):
                # keys that are there already, few columns; buckets without any only get new rows beside theirs
                changed = rows.select(*key) if gone is None else rows.select(*key).union(gone.select(*key))
                known = written(before.select(*key).join(changed, key, "left_semi"), f"known-{table}")
                stale |= {r[0] for r in known.select(self._bucket(key).alias("b")).distinct().collect()}
                kept = self._read(table, own, stale).join(known, key, "left_anti")
            else:
                kept = self._read(table, own, stale)
            filled = write(table, kept.select(*schema.names).unionByName(rows) if stale else rows)
            held_on = {k: at for k, at in own.items() if k not in stale}
            return table, held_on | {k: held_on.get(k, []) + at for k, at in filled.items()}

        held |= dict(in_threads(change, sorted({*upserts, *(deletes or {})})))
        rows = [(t, k, v, batch) for t, own in held.items() for k, at in own.items() for v in at] or [(None, None, None, batch)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/_manifests/version={version}")
        return True
