"""Nearest vectors through an inverted file: every vector lies in the cell of its nearest centroid, a search opens the nearest cells.

Vectors count by direction alone (cosine). Those that are null, empty, without length, of another dimension, or hold null
or non-finite components take no part, neither as rows nor as queries. Repeated ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import norm, unit
from ..sources.shared import written

#: More than rounding to six digits and the arithmetic of angles can move a similarity by.
SLACK = 2e-6
#: Products of matrices that one task makes of a shard and its block of queries.
PRODUCTS = 8


def usable(v: Column, dimension: int | None = None) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    right = F.lit(True) if dimension is None else F.size(v) == dimension
    return F.coalesce(F.when(finite & right, norm(v) > 0), F.lit(False))


def _units(vectors: DataFrame, name: str, dimension: int | None = None) -> DataFrame:
    kept = vectors.select(F.col("vec_id").alias(name), "embedding").filter(usable(F.col("embedding"), dimension))
    return kept.select(name, unit(F.col("embedding")).alias("v"))


@dataclass
class CellIndex:
    """An index under ``path``: centroids, vectors by cell and batch, and what each batch put into each cell.

    A cell of a batch is dealt by id into shards of about ``shard_rows`` rows, so one that holds much of the table (copies have one
    cell) is searched in many tasks. ``low`` is the least similarity of a cell's vectors to its centroid.
    """

    spark: SparkSession
    path: str
    shard_rows: int = 50_000

    def centroids(self) -> np.ndarray:
        """Bounded by the number of cells that was fitted, at most ``most_cells``."""
        rows = self.spark.read.schema("cell int, v array<double>").parquet(f"{self.path}/centroids").collect()
        return np.array([r.v for r in sorted(rows, key=lambda r: r.cell)], dtype=float)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, v array<double>, shard int, batch long, cell int").parquet(f"{self.path}/vectors")

    def stats(self) -> DataFrame:
        return self.spark.read.schema("cell int, shards int, rows long, low double, batch long").parquet(f"{self.path}/stats")

    def add(self, vectors: DataFrame, batch: int) -> None:
        """Every usable row of ``vectors(vec_id, embedding)`` into its cell; a batch that is added again takes its own place."""
        centroids = self.centroids()
        if not len(centroids):
            return
        rows = _units(vectors, "vec_id", centroids.shape[1]).withColumn("near", _nearest(centroids, 1)("v"))
        rows = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.col("near.cells")[0].alias("cell"), F.col("near.similarities")[0].alias("near")), "assigned")
        shards = F.ceil(F.count("*") / F.lit(self.shard_rows)).cast("int").alias("shards")
        stats = written(rows.groupBy("cell").agg(shards, F.count("*").alias("rows"), F.min("near").alias("low")), "stats")
        dealt = rows.join(F.broadcast(stats.select("cell", "shards")), "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
        dealt.select("vec_id", "v", "shard", "cell").repartition("cell", "shard").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors/batch={batch}")
        stats.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/batch={batch}")


def build(vectors: DataFrame, path: str, most_cells: int = 4096, sample_rows: int = 40_000, shard_rows: int = 50_000) -> CellIndex:
    """An index of all of ``vectors(vec_id, embedding)``; centroids are fitted to at most ``sample_rows`` rows, dealt by hash of their ids.

    There are about as many cells as the square root of the rows, at most ``most_cells``.
    """
    spark = vectors.sparkSession
    units = written(_units(vectors, "vec_id"), "units")
    found = units.agg(F.count("*").alias("n"), F.mode(F.size("v"), deterministic=True).alias("dimension")).first()
    index, rows = CellIndex(spark, path, shard_rows), []
    if found.n:
        sample = written(units.filter(F.size("v") == found.dimension).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).select("vec_id", "v"), "sample")
        cells = min(most_cells, max(2, math.isqrt(found.n)))
        features = sample.orderBy("vec_id", "v").select(array_to_vector("v").alias("features"))
        several = sample.select("v").distinct().limit(2).count() > 1
        centers = KMeans(k=cells, seed=42, distanceMeasure="cosine", maxIter=15).fit(features).clusterCenters() if several else [np.array(sample.first().v)]
        rows = [(i, [float(x) for x in c / (np.linalg.norm(c) or 1.0)]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    for part, schema in (("vectors", "vec_id long, v array<double>, shard int, cell int"), ("stats", "cell int, shards int, rows long, low double")):
        none = spark.createDataFrame([], schema).write.mode("overwrite")
        (none.partitionBy("cell") if part == "vectors" else none).parquet(f"{path}/{part}/batch=-1")
    index.add(vectors, 0)
    return index


def _nearest(centroids: np.ndarray, n: int):
    """The ``n`` centroids most similar to a unit vector, the nearest first."""

    @F.pandas_udf("cells array<int>, similarities array<double>")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in parts:
            near = np.stack(v.to_list()) @ centroids.T if len(v) else np.zeros((0, len(centroids)))
            order = np.argsort(-near, axis=1, kind="stable")[:, :n]
            yield pd.DataFrame({"cells": list(order.astype("int32")), "similarities": list(np.take_along_axis(near, order, 1))})

    return nearest


def _others(centroids: np.ndarray, low: np.ndarray, opened: int):
    """Cells past the nearest ``opened`` that may hold a vector as similar as ``least``: none lies nearer than centroid's angle less the cell's."""
    reach = np.arccos(np.clip(low, -1.0, 1.0))

    @F.pandas_udf("array<int>")
    def others(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, least in parts:
            near = np.stack(v.to_list()) @ centroids.T if len(v) else np.zeros((0, len(centroids)))
            best = np.cos(np.maximum(np.arccos(np.clip(near, -1.0, 1.0)) - reach, 0.0))
            order = np.argsort(-near, axis=1, kind="stable")[:, opened:]
            yield pd.Series([[int(c) for c in o if b[c] >= x - SLACK] for o, b, x in zip(order, best, least, strict=True)])

    return others


def _scored(index: CellIndex, probes: DataFrame, k: int, digits: int, block_rows: int) -> DataFrame:
    """The ``k`` best of each opened shard for ``probes(query_id, v, least, cell)``: blocks of queries against a shard, as products of matrices.

    A block is several products, so that a shard is dealt to fewer blocks than there are products.
    """
    blocks = probes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(PRODUCTS * block_rows)).cast("int").alias("blocks"))
    dealt = probes.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    stats = F.broadcast(index.stats().select("batch", "cell", "shards"))
    asked = dealt.join(stats, "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("batch", "cell", "shard", "block", "query_id", "v", "least")
    held = index.vectors().join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("batch", "cell", "shard", "block", "vec_id", "v")

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64"})]
        if queries.empty or rows.empty:
            return out[0]
        ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_list()).T
        for at in range(0, len(queries), block_rows):
            some = queries.iloc[at : at + block_rows]
            near = np.round(np.clip(np.stack(some["v"].to_list()) @ vectors, -1.0, 1.0), digits)
            kept = near >= some["least"].to_numpy()[:, None]
            many = np.flatnonzero(kept.sum(axis=1) > k)
            if len(many):
                kept[many] &= near[many] >= np.partition(near[many], len(ids) - k, axis=1)[:, [len(ids) - k]]
            query, row = np.nonzero(kept)
            order = np.lexsort((ids[row], -near[query, row], query))
            query, row = query[order], row[order]
            first = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, row = query[first], row[first]
            out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[query], "vec_id": ids[row], "similarity": near[query, row]}))
        return pd.concat(out[1:])

    keys = ["batch", "cell", "shard", "block"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, similarity double")


def search(index: CellIndex, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, threshold: float = -1.0, digits: int = 6, block_rows: int = 256) -> DataFrame:
    """``query_id, vec_id, similarity, ord``: the ``k`` most similar rows at or over ``threshold`` for each of ``queries(vec_id, embedding)``, ties to the smaller id.

    The nearest ``probes`` cells are opened. With ``exact`` those follow that could still hold something as good as the k-th found
    or, while fewer are found, as the threshold; the result is then that of comparing all rows. Query ids must differ.
    """
    centroids = index.centroids()
    if not len(centroids):
        return index.spark.createDataFrame([], "query_id long, vec_id long, similarity double, ord int")
    asked = written(_units(queries, "query_id", centroids.shape[1]).select(F.col("query_id").cast("long").alias("query_id"), "v"), "queries")
    first = asked.select("query_id", "v", F.lit(float(threshold)).alias("least"), F.explode(_nearest(centroids, probes)("v")["cells"]).alias("cell"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    top = lambda rows: rows.withColumn("ord", nth).filter(F.col("ord") <= k)
    found = top(_scored(index, first, k, digits, block_rows))
    if not exact:
        return found
    found = written(found, "found")
    low = np.ones(len(centroids))
    for r in index.stats().groupBy("cell").agg(F.min("low").alias("low")).collect():
        low[r.cell] = r.low
    kth = found.groupBy("query_id").agg(F.max("ord").alias("n"), F.min("similarity").alias("least"))
    least = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float(threshold)))
    more = asked.join(kth, "query_id", "left").withColumn("least", least)
    more = more.select("query_id", "v", "least", F.explode(_others(centroids, low, probes)("v", "least")).alias("cell"))
    return top(found.drop("ord").unionByName(_scored(index, more, k, digits, block_rows)))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of the exact hits that were found; 1 where there are none."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    r = both.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return r.hits / r.n if r.n else 1.0


def probes_for(index: CellIndex, queries: DataFrame, k: int = 10, target: float = 0.9, sample_queries: int = 100) -> int:
    """How many cells must be opened for a recall of ``target``, measured on at most ``sample_queries`` queries against the exact way.

    A true hit is found by as many probes as its cell's place among the query's, so one exact search answers for all numbers of probes.
    """
    centroids = index.centroids()
    if not len(centroids):
        return 1
    some = written(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_queries), "some-queries")
    places = _units(some, "query_id", centroids.shape[1]).select("query_id", F.posexplode(_nearest(centroids, len(centroids))("v")["cells"]).alias("place", "cell"))
    hits = written(search(index, some, k, max(1, len(centroids) // 8), exact=True), "hits").filter("query_id <> vec_id")
    homes = index.vectors().select("vec_id", "cell").join(hits.select("vec_id").distinct(), "vec_id", "left_semi")
    met = hits.join(homes, "vec_id").join(places, ["query_id", "cell"]).groupBy((F.col("place") + 1).alias("probes")).agg(F.count("*").alias("n")).orderBy("probes").collect()
    total, done = sum(r.n for r in met), 0
    for r in met:
        done += r.n
        if done >= target * total:
            return r.probes
    return 1
