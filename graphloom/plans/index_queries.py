"""Searches through the index of cells: every twentieth row against all rows, with the SQL of the exact way."""

from __future__ import annotations

from ..operators import cells
from ..sources.shared import fresh_path
from ..sources.tables import read
from .catalog import query

K, THRESHOLD = 10, 0.2


def _index(spark, d):
    """Rows of the first half of labels in one batch, the others in a second, as an index grows."""
    vectors = read(spark, d, "embeddings")
    index = cells.build(vectors.filter("label % 2 = 0"), fresh_path(spark, "cells"))
    index.add(vectors.filter("coalesce(label % 2, 1) <> 0"), 1)
    return index, vectors.filter("vec_id % 20 = 0")


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
 s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.v, r.v), 6) AS similarity FROM v q JOIN v r ON q.vec_id % 20 = 0)
SELECT query_id, vec_id, similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS ord FROM s WHERE similarity >= {THRESHOLD} QUALIFY ord <= {K}""")
def exact_search_by_cells(spark, d):
    """As many cells are opened as can hold a hit, so nothing is missed."""
    index, queries = _index(spark, d)
    return cells.search(index, queries, K, exact=True, threshold=THRESHOLD)


@query()
def approximate_search_by_cells(spark, d):
    """As many cells as a recall of 0.95 takes on a sample of the queries; a test holds the hits of all against the exact ones."""
    index, queries = _index(spark, d)
    return cells.search(index, queries, K, cells.probes_for(index, queries, K, 0.95), threshold=THRESHOLD)
