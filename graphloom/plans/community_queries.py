"""Communities by modularity of the graph of parts and suppliers, with SQL where the grouping is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities
from ..sources import tables
from .catalog import EDGES, query

#: A node's group by the last digit of its name, so that groups hold both parts and suppliers.
SMALL = """m AS (SELECT right(src, 1) AS a, right(tgt, 1) AS b, weight FROM e),
 c AS (SELECT least(a, b) AS src, greatest(a, b) AS tgt, CAST(sum(weight) AS DOUBLE) AS weight FROM m GROUP BY 1, 2)"""


def _groups(spark, d):
    edges = tables.edges(spark, d)
    return edges, edges.select(F.explode(F.array("src", "tgt")).alias("entity_id")).distinct().withColumn("label", F.right("entity_id", F.lit(1)))


@query(f"WITH {EDGES}, {SMALL} SELECT * FROM c")
def contracted_graph(spark, d):
    return communities.contracted(*_groups(spark, d))


@query(f"""WITH {EDGES}, {SMALL}, x AS (SELECT src AS label, weight, src = tgt AS loop FROM c UNION ALL SELECT tgt, weight, src = tgt FROM c),
 s AS (SELECT label, sum(CASE WHEN loop THEN weight ELSE 0 END) AS inside, sum(weight) AS total FROM x GROUP BY 1)
SELECT label, inside, total, round(inside / (sum(total) OVER ()) - (total / (sum(total) OVER ())) ** 2, 9) AS part FROM s""")
def modularity_by_community(spark, d):
    return communities.modularity_parts(*_groups(spark, d)).withColumn("part", F.round("part", 9))


@query()
def louvain_communities(spark, d):
    return communities.louvain(tables.nodes(spark, d), tables.edges(spark, d))
