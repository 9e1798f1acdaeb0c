"""Changing a stored graph: creating, editing, renaming, merging and deleting, and merging new records into it.

``nodes(entity_id, ...)`` and ``edges(src, tgt, ...)`` with src < tgt are tables; each function returns the tables after
the change. Changes are tables too, so that one call makes as many as there are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.text import FIELD_SEP
from .merge import merge_edges

#: How the fields of merged entities are put together.
ENTITY_STRATEGY = {"description": "concatenate", "entity_type": "keep_first", "source_id": "join_unique"}
RELATION_STRATEGY = {"description": "concatenate", "keywords": "join_unique_comma", "source_id": "join_unique", "weight": "max"}


def _ordered(c: str, held: Column, order: list[str]) -> Column:
    kept = F.array_sort(F.collect_list(F.when(held, F.struct(*order, F.col(c).alias("_v")))))
    return F.transform(kept, lambda x: x["_v"].cast("string"))


def merged_attributes(rows: DataFrame, key: list[str], order: list[str], strategies: dict[str, str], keep_empty: bool = False) -> DataFrame:
    """One row for each key, every other column by its strategy: ``concatenate``, ``keep_first`` (also for columns not named),
    ``keep_last``, ``join_unique``, ``join_unique_comma`` (both sorted) or ``max``.

    Nulls take no part; empty strings and zeros don't either unless ``keep_empty``. ``max`` of text is its first value
    where one isn't a number. A column without values is null.
    """
    out = []
    for c in (c for c in rows.columns if c not in key and c not in order):
        how, numeric, v = strategies.get(c, "keep_first"), isinstance(rows.schema[c].dataType, NumericType), F.col(c)
        held = v.isNotNull() if keep_empty else v.isNotNull() & (v != (0 if numeric else ""))
        first = F.min_by(v, F.when(held, F.struct(*order)))
        parts = lambda sep: F.array_distinct(F.flatten(F.collect_set(F.when(held, F.split(v.cast("string"), sep)))))  # noqa: B023, E731
        joined = lambda items, sep: F.when(F.size(items) > 0, F.array_join(F.array_sort(items), sep))
        if how == "concatenate":
            values = _ordered(c, held, order)
            merged = F.when(F.size(values) > 0, F.array_join(values, FIELD_SEP))
        elif how == "keep_last":
            merged = F.max_by(v, F.when(held, F.struct(*order)))
        elif how == "join_unique":
            merged = joined(parts(FIELD_SEP), FIELD_SEP)
        elif how == "join_unique_comma":
            merged = joined(F.array_distinct(F.filter(F.transform(parts(","), lambda x: F.trim(x)), lambda x: x != "")), ",")
        elif how == "max" and numeric:
            merged = F.max(F.when(held, v.cast("double")))
        elif how == "max":
            number = F.when(held, v).try_cast("double")
            merged = F.when(F.count(number) == F.count_if(held), F.max(number).cast("string")).otherwise(first)
        else:
            merged = first
        out.append(merged.alias(c))
    return rows.groupBy(*key).agg(*out)


def create_entities(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with the new ones that don't exist yet, one for each name; fields they lack are null."""
    fresh = new.dropDuplicates(["entity_id"]).join(nodes.select("entity_id"), "entity_id", "left_anti")
    return nodes.unionByName(fresh, allowMissingColumns=True).select(*nodes.columns)


def create_relations(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones whose two ends exist and differ and which don't exist yet in either direction."""
    ends = new.filter("src <> tgt").withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")}).dropDuplicates(["src", "tgt"])
    for side in ("src", "tgt"):
        ends = ends.join(nodes.select(F.col("entity_id").alias(side)), side, "left_semi")
    fresh = ends.join(edges.select("src", "tgt"), ["src", "tgt"], "left_anti")
    return edges.unionByName(fresh, allowMissingColumns=True).select(*edges.columns)


def edit(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``table`` with the fields that ``changes`` gives; nulls there keep the old, unknown keys do nothing."""
    fields = [c for c in changes.columns if c not in key]
    met = table.join(changes.withColumnsRenamed({c: f"_{c}" for c in fields}), key, "left")
    return met.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in table.columns))


def rename_entities(nodes: DataFrame, edges: DataFrame, renamed: DataFrame, edge_order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after entities ``old`` became ``new``. Entities that then share a name are merged, the one that had
    it first, others by their old names; ends follow, self loops go and parallel edges are merged.
    """
    names = renamed.select(F.col("old").alias("entity_id"), F.col("new").alias("_new")).dropDuplicates(["entity_id"])
    moved = nodes.join(names, "entity_id", "left").withColumns({"_moved": F.col("_new").isNotNull(), "_old": F.col("entity_id"), "entity_id": F.coalesce("_new", "entity_id")}).drop("_new")
    ends = edges.withColumns({"_a": F.col("src"), "_b": F.col("tgt")})
    for side in ("src", "tgt"):
        ends = ends.join(names.withColumnsRenamed({"entity_id": side, "_new": "_n"}), side, "left").withColumn(side, F.coalesce("_n", side)).drop("_n")
    # dealt before they are merged, so that a task sorts its edges once, not also where they met the names
    ends = ends.filter("src <> tgt").withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")}).repartition("src", "tgt")
    return merged_attributes(moved, ["entity_id"], ["_moved", "_old"], ENTITY_STRATEGY), merged_attributes(ends, ["src", "tgt"], ["_a", "_b"], RELATION_STRATEGY).select(*edges.columns)


def delete_relations(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the pairs of ``gone``, whichever end is named first."""
    pairs = gone.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"))
    return edges.join(pairs, ["src", "tgt"], "left_anti")


def delete_keys(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Entities ``gone(entity_id)`` taken out of every table that has an ``entity_id``, or ``src`` and ``tgt``."""
    ids, out = gone.select("entity_id"), {}
    for name, t in tables.items():
        for c in ("entity_id", "src", "tgt"):
            t = t.join(ids.withColumnRenamed("entity_id", c), c, "left_anti").select(*t.columns) if c in t.columns else t
        out[name] = t
    return out


def relations_after_deletion(edges: DataFrame, records: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges after the chunks of ``gone`` went: those with a record (``src, tgt, weight, keywords, source_id``) in such a
    chunk are put together again from the records that are left, or go with the last of them; others stay as they are.
    """
    lost = records.join(gone.select(F.col("chunk_id").alias("source_id")), "source_id", "left_semi").select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct()
    left = records.join(gone.select(F.col("chunk_id").alias("source_id")), "source_id", "left_anti").withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})
    rebuilt = merge_edges(left.join(lost, ["src", "tgt"], "left_semi"))
    return edges.join(lost, ["src", "tgt"], "left_anti").select(*rebuilt.columns).unionByName(rebuilt)


def _last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, without what it was ordered by."""
    fields = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def custom_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph that is given: ``source_id`` becomes the chunk's id (``UNKNOWN`` without a chunk), the last
    row of a name or pair holds, and ends that no row names become nodes of type UNKNOWN.
    """
    of = chunks.select("source_id", "chunk_id").dropDuplicates(["source_id"])
    placed = lambda rows: rows.join(of, "source_id", "left").withColumn("source_id", F.coalesce("chunk_id", F.lit("UNKNOWN"))).drop("chunk_id")
    # the last rows first, so that no others meet the chunks; names repeat and are reduced before they are shuffled, pairs rarely do
    nodes = placed(_last(entities, ["entity_id"], order))
    edges = placed(_last(relations.withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")}).repartition("src", "tgt"), ["src", "tgt"], order))
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_id"), "source_id").groupBy("entity_id").agg(F.min("source_id").alias("source_id"))
    missing = ends.join(nodes, "entity_id", "left_anti").withColumn("entity_type", F.lit("UNKNOWN"))
    return nodes.unionByName(missing, allowMissingColumns=True), edges


def merge_into(nodes: DataFrame | None, tracking: DataFrame | None, records: DataFrame, batch: int, cap: int = 300, method: str = "KEEP") -> tuple[DataFrame, DataFrame]:
    """``nodes(entity_id, entity_type, description)`` and ``tracking(entity_id, source_id, seen)`` after one more batch of
    ``records(entity_id, entity_type, description, source_id, time, place)``; None for both before the first.

    Tracking has every source, in the order of ``seen`` (batch, time, place). With KEEP, records of sources past the first ``cap``
    go. The commonest type of the new records and the old node holds, new ones first on ties. New descriptions, each once,
    by time, then the longer first, follow the old.
    """
    spark = records.sparkSession
    if nodes is None or tracking is None:
        nodes = spark.createDataFrame([], "entity_id string, entity_type string, description string")
    at = F.struct(F.lit(batch).alias("batch"), F.col("time").cast("long").alias("time"), F.col("place").cast("long").alias("place"))
    new = records.groupBy("entity_id", "source_id").agg(F.min(at).alias("seen"))
    full = new if tracking is None else tracking.unionByName(new.join(tracking, ["entity_id", "source_id"], "left_anti"))
    if method == "KEEP":
        allowed = sources(full, cap, method).select("entity_id", "source_id")
        records = records.join(allowed if tracking is None else allowed.union(tracking.select("entity_id", "source_id")), ["entity_id", "source_id"], "left_semi")
    place = F.struct(F.lit(0).alias("old"), F.col("time").cast("long").alias("time"), F.col("place").cast("long").alias("place"))
    before = F.struct(F.lit(1).alias("old"), F.lit(0).cast("long").alias("time"), F.lit(0).cast("long").alias("place"))
    votes = records.groupBy("entity_id", "entity_type").agg(F.count("*").alias("n"), F.min(place).alias("first")).unionByName(nodes.select("entity_id", "entity_type", F.lit(1).cast("long").alias("n"), before.alias("first")))
    votes = votes.groupBy("entity_id", "entity_type").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    types = votes.groupBy("entity_id").agg(F.min_by("entity_type", F.struct(-F.col("n"), F.col("first"))).alias("entity_type"))
    told = records.filter("description <> ''").groupBy("entity_id", "description").agg(F.min(F.struct("time", "place")).alias("f"))
    item = F.struct(F.col("f.time").alias("time"), (-F.length("description")).alias("n"), F.col("f.place").alias("place"), "description")
    lines = told.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["description"]), FIELD_SEP).alias("_new"))
    old = nodes.select("entity_id", "description")
    merged = types.join(old, "entity_id", "left").join(lines, "entity_id", "left")
    return merged.select("entity_id", "entity_type", F.concat_ws(FIELD_SEP, "description", "_new").alias("description")), full


def sources(tracking: DataFrame, cap: int, method: str = "KEEP") -> DataFrame:
    """The first (KEEP) or last (FIFO) ``cap`` sources of each entity."""
    end = [F.asc("seen"), F.asc("source_id")] if method == "KEEP" else [F.desc("seen"), F.desc("source_id")]
    return tracking.withColumn("nth", F.row_number().over(Window.partitionBy("entity_id").orderBy(*end))).filter(F.col("nth") <= cap).drop("nth")
