"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source's target says how many copies its documents should have on average. The whole part of that is
allocated for certain; the rest is a sample without replacement in which documents have unequal odds: the
inclusion probability follows a weight of the document, by default the fourth root of its size, so that longer
documents are likelier. Every document gets a random number u, is ranked by the odds of u over the odds of its
inclusion, and the lowest ranks are taken up to the words that the source still needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of the parts; any engine with MD5 gives the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def favour(size: Column) -> Column:
    """Default weight: 1024 times the fourth root of size + 1, a whole number, so that sums don't depend on their order."""
    return F.floor(1024 * F.sqrt(F.sqrt((size + 1).cast("double")))).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Rows ``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, take the weights in turn. Targets share the total by weight; none
    passes ``most`` times its source, and what is cut off is shared again by weight among the others. The
    level at which that ends is found in one pass over the sources in order of size by weight: a prefix
    of them is cut, the rest share what the prefix leaves.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy("need", F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    upto = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, Window.unboundedFollowing)
    ws = F.array(*(F.lit(float(w)) for w in weights))
    held = (
        sizes.withColumn("w", F.element_at(ws, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("need", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(onward))
    )
    # the first source in that order that isn't cut sets the level for it and all after
    level = held.withColumn("free", F.when(F.col("need") >= F.col("level"), F.col("level"))).withColumn("share", F.first("free", ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return level.select("source", "source_size", F.when(F.col("share").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("share"))).alias("target"))


def pareto_mix(docs: DataFrame, size: Column, *, weight: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``; ``taken`` is copies times size.

    ``weight`` (positive whole numbers; ``favour(size)`` by default) says how documents of a source compare: a
    document's inclusion probability is the source's rest rate times its weight over the mean weight of the
    source's words, at most 1.

    Null sources are a source of their own, null and empty texts have size 0 and are taken as often as
    the whole part says; ties in rank fall to (doc_id, text); rows equal in both share one decision, whose
    weight is their joint size. An empty table gives no rows. Input columns with these names are replaced.
    Ranks are summed in buckets first, so only the bucket in which a source's need
    ends is ordered row by row: no source, however large, is sorted in one task.
    """
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))
    named = docs.select(F.struct("*").alias("row"), F.col("source"), F.col("doc_id").cast("long").alias("id"), ids[1].alias("text_md5"), size.alias("size"), weight.alias("v") if weight is not None else favour(size).alias("v"))
    per = named.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("v") * F.col("size")).alias("held"))
    sources = source_targets(per.drop("held"), weights=weights, most=most)
    means = per.select(F.col("source").alias("m"), (F.col("held") / F.greatest("source_size", F.lit(1))).alias("mean"))
    sources = sources.join(means, F.col("source").eqNullSafe(F.col("m"))).drop("m")
    # one row per decision
    units = named.groupBy("source", "id", "text_md5").agg(F.count("*").alias("rows"), F.max("size").alias("size"), F.max("v").alias("v"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = units.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    u = u.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.col("whole"))
    u = u.withColumn("u", uniform(seed, F.col("id"), F.col("text_md5"))).withColumn("chance", F.col("part") * (F.col("v") / F.col("mean")))
    odds = F.when(F.col("chance") >= 1, 0.0).otherwise((F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance"))))
    u = u.withColumn("rank", F.when(F.col("part") > 0, odds))
    u = u.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int")).withColumn("mass", F.col("size") * F.col("rows"))
    need = F.col("target") - F.col("whole") * F.col("source_size")
    sums = u.filter("part > 0").groupBy("source", "bucket").agg(F.sum("mass").alias("mass"), F.first(need).alias("need"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("mass").over(order), F.lit(0)))
    state = sums.select(F.col("source").alias("s"), F.col("bucket").alias("k"), "before", F.when(F.col("before") + F.col("mass") <= F.col("need"), 1).when(F.col("before") >= F.col("need"), 0).alias("all"))
    at = u.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")), "left").drop("s", "k")
    settled = at.filter("part = 0 or all is not null").withColumn("extra", F.when(F.col("all") == 1, 1).otherwise(0))
    # the bucket where the need ends: a document is in if more than half of it still fits
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "id", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    edge = at.filter("part > 0 and all is null").withColumn("upto", F.col("before") + F.coalesce(F.sum("mass").over(inside), F.lit(0)))
    edge = edge.withColumn("extra", F.when(F.col("upto") + F.col("mass") / 2 <= need, 1).otherwise(0)).drop("upto")
    decided = settled.unionByName(edge).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    d = decided.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("text_md5").alias("t"), "source_size", "target", "copies")
    joined = named.join(d, F.col("source").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("text_md5") == F.col("t")))
    own = ["size", "source_size", "target", "copies", "taken"]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in own]
    return joined.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).select(*kept, *own)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """``pareto_mix`` of the whole table by words; weights 1, 2, 3 repeating, targets up to 3 times a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pareto_mix(docs, word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tm,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CAST(sum(size * CAST(floor(1024 * sqrt(sqrt(CAST(size + 1 AS DOUBLE)))) AS BIGINT)) AS BIGINT) AS DOUBLE) / CAST(greatest(sum(size), 1) AS DOUBLE) AS mean
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
), n AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT *, first_value(CASE WHEN cap / w >= level THEN level END IGNORE NULLS)
            OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS share FROM n
), g AS (
  SELECT source, source_size, mean, CASE WHEN share IS NULL THEN cap ELSE least(cap, w * share) END AS target FROM t
), u AS (
  SELECT d.*, g.source_size, g.target, CAST(CAST(floor(1024 * sqrt(sqrt(CAST(size + 1 AS DOUBLE)))) AS BIGINT) AS DOUBLE) / g.mean AS favour, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         (CAST(CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || tm), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS part, (rate - floor(rate)) * favour AS chance FROM u
), o AS (
  SELECT *, CASE WHEN chance >= 1 THEN 0.0::DOUBLE WHEN part > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM p
), c AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, tm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN part > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
