"""Graph operators over ``nodes(entity_id, ...)`` and undirected ``edges(src, tgt, weight)`` with src < tgt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def incident(edges: DataFrame) -> DataFrame:
    """Each edge once from either end: ``node, other`` and the edge's columns."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("tgt").alias("other")), F.struct(F.col("tgt").alias("node"), F.col("src").alias("other"))))
    return edges.select("*", both.alias("end")).select("end.*", *edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    return incident(edges).groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("degree"))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node's degree, 0 without edges."""
    return nodes.join(degrees(edges), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    with_src = edges.join(d.withColumnsRenamed({"entity_id": "src", "degree": "ds"}), "src", "left")
    return with_src.join(d.withColumnsRenamed({"entity_id": "tgt", "degree": "dt"}), "tgt", "left").select(*edges.columns, (F.coalesce("ds", F.lit(0)) + F.coalesce("dt", F.lit(0))).alias("rank"))


def popular_labels(nodes: DataFrame, edges: DataFrame, limit: int = 300) -> DataFrame:
    return node_degrees(nodes, edges).orderBy(F.desc("degree"), "entity_id").limit(limit).select("entity_id", "degree")


def search_labels(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Labels that contain the query, by how well: whole, beginning, else shorter first; word beginnings gain 50."""
    q, name = query.lower().strip(), F.lower("entity_id")
    score = F.when(name == q, 1000).when(name.startswith(q), 500).otherwise(100 - F.length("entity_id") + F.when(name.contains(" " + q) | name.contains("_" + q), 50).otherwise(0))
    return nodes.filter(name.contains(q)).select("entity_id", score.alias("score")).orderBy(F.desc("score"), "entity_id").limit(limit)


def neighbourhood(edges: DataFrame, start: str, depth: int, max_nodes: int | None = None) -> DataFrame:
    """``entity_id, depth`` within ``depth`` steps of ``start``: one join per level, frontier against visited.

    With ``max_nodes`` the nearest are kept, those of higher degree first within a level.
    """
    spark = edges.sparkSession
    steps = incident(edges).select("node", "other")
    seen = spark.createDataFrame([(start, 0)], "entity_id string, depth int")
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.join(steps, frontier["entity_id"] == steps["node"]).select(F.col("other").alias("entity_id")).distinct()
        frontier = reached.join(seen, "entity_id", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    if max_nodes is None:
        return seen
    return seen.join(degrees(edges), "entity_id", "left").orderBy("depth", F.desc_nulls_last("degree"), "entity_id").limit(max_nodes).select("entity_id", "depth")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    ids = kept.select("entity_id")
    return edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "tgt"), "tgt", "left_semi")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes removed with their edges."""
    ids = gone.select("entity_id")
    left = edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_anti").join(ids.withColumnRenamed("entity_id", "tgt"), "tgt", "left_anti")
    return nodes.join(ids, "entity_id", "left_anti"), left


def merge_entities(edges: DataFrame, renamed: DataFrame) -> DataFrame:
    """Edges after entities ``old`` became ``new``: ends follow, self loops go, parallel edges keep the largest weight."""
    to = lambda side: renamed.select(F.col("old").alias(side), F.col("new").alias(side + "_new"))
    moved = edges.join(to("src"), "src", "left").join(to("tgt"), "tgt", "left").select(F.coalesce("src_new", "src").alias("a"), F.coalesce("tgt_new", "tgt").alias("b"), "weight")
    return moved.filter("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")).agg(F.max("weight").alias("weight"), F.count("*").alias("merged"))


def complete_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with one of type UNKNOWN for each endpoint that has none."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct()
    return nodes.unionByName(ends.join(nodes, "entity_id", "left_anti").select("entity_id", F.lit("UNKNOWN").alias("entity_type"), F.lit(None).cast("string").alias("description")))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation: each node takes the label with most weight among its neighbours, ties to the smallest.

    Rounds run on numbers in the order of the names, so that ties stay ties of names; a round's labels are a written table.
    """
    edges = written(edges.select("src", "tgt", "weight"), "edges")
    names = edges.select(F.explode(F.array("src", "tgt")).alias("name")).distinct()
    names = written(names.repartitionByRange("name").sortWithinPartitions("name").select("name", F.when(F.col("name").isNull(), -1).otherwise(F.monotonically_increasing_id()).alias("id")), "names")
    end = lambda side: names.select(F.col("name").alias(side + "_name"), F.col("id").alias(side + "_id"))
    for side in ("src", "tgt"):
        edges = edges.join(end(side), F.col(side).eqNullSafe(F.col(side + "_name")))
    numbered = edges.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), "weight")
    steps = written(incident(numbered).select("node", "other", "weight").filter("other >= 0"), "steps")  # a null end doesn't vote
    labels = names.select("id", F.col("id").alias("label"))
    for turn in range(rounds):
        votes = steps.join(labels, steps["other"] == labels["id"]).groupBy("node", "label").agg(F.sum("weight").alias("w"))
        labels = written(votes.groupBy(F.col("node").alias("id")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")), f"labels-{turn}")
    label = names.select(F.col("id").alias("label"), F.col("name").alias("named"))
    return labels.join(names, "id").join(label, "label").select(F.col("name").alias("entity_id"), F.col("named").alias("label"))


def exported(edges: DataFrame) -> DataFrame:
    """Each undirected edge in both directions, as exports list them."""
    return edges.select("src", "tgt", "weight").union(edges.select("tgt", "src", "weight"))


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def nodes_of_chunks(nodes: DataFrame, tracking: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes with a source (``tracking(entity_id, source_id)``) among ``chunks(chunk_id)``, and how many they have there."""
    wanted = chunks.select(F.col("chunk_id").alias("source_id")).distinct()
    met = tracking.join(wanted, "source_id", "left_semi").groupBy("entity_id").agg(F.count_distinct("source_id").alias("chunks"))
    return nodes.join(met, "entity_id")


def neighbourhoods(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 3, max_nodes: int = 1000) -> DataFrame:
    """``start, entity_id, depth, place, is_truncated``: for each of ``starts(entity_id)`` the nodes within ``depth`` steps, at most ``max_nodes``.

    Nearer nodes come first, in a level those of higher degree, then by name. ``is_truncated`` says that more would have been
    within reach. A level is a written table; a start that is cut goes no further, and all end when none has a frontier.
    Starts that aren't nodes have no rows, repeated ones count once. Of a node's neighbours the first ``max_nodes + 1`` are
    followed: one further down has that many before it, which the start holds or which come before it there, too.
    """
    steps = written(incident(edges).select("node", "other"), "steps")
    degree = steps.groupBy("other").agg(F.count("*").alias("degree"))
    among = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("degree"), "other"))
    first = starts.select("entity_id").distinct().join(nodes.select("entity_id"), "entity_id", "left_semi")
    seen = frontier = written(first.select(F.col("entity_id").alias("start"), "entity_id", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("place")), "level-0")
    # one step leads from the starts only
    left = steps if depth > 1 else steps.join(seen.select(F.col("start").alias("node")), "node", "left_semi")
    ways = written(left.join(degree, "other").withColumn("among", among).filter(F.col("among") <= max_nodes + 1).select("node", "other", "degree"), "ways")
    cut = seen.select("start").limit(0)
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("held"), F.desc("degree"), "entity_id")).cast("long")
    for level in range(1, depth + 1):
        reached = frontier.join(ways, F.col("entity_id") == F.col("node")).select("start", F.col("other").alias("entity_id"), "degree", F.lit(False).alias("held"))
        held = seen.select("start", "entity_id", F.lit(0).cast("long").alias("degree"), F.lit(True).alias("held"))
        # by start alone, so that one shuffle serves the grouping and the places
        each = reached.unionByName(held).repartition("start").groupBy("start", "entity_id").agg(F.max("degree").alias("degree"), F.max("held").alias("held"))
        ranked = each.withColumn("place", place).filter((F.col("place") <= max_nodes + 1) & ~F.col("held"))
        ranked = written(ranked.select("start", "entity_id", F.lit(level).alias("depth"), "place"), f"level-{level}")
        over = ranked.filter(F.col("place") > max_nodes).select("start")
        cut = cut.union(over)
        level_rows = ranked.filter(F.col("place") <= max_nodes)
        seen, frontier = seen.unionByName(level_rows), level_rows.join(over, "start", "left_anti")
        if frontier.isEmpty():
            break
    return seen.join(cut.withColumn("is_truncated", F.lit(True)), "start", "left").withColumn("is_truncated", F.coalesce("is_truncated", F.lit(False)))


def induced_by_start(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges of ``neighbourhoods``' rows: those with both ends in the same start's."""
    ends = reached.select("start", "entity_id")
    one = edges.join(ends.withColumnRenamed("entity_id", "src"), "src")
    return one.join(ends.withColumnRenamed("entity_id", "tgt"), ["start", "tgt"], "left_semi").select("start", *edges.columns)
