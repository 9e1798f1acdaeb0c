"""Removing repeated runs of lines by winnowing over line hashes, with DataFrame operations only.

A window is the shortest run of lines that holds ``min_words`` words or ``max_lines`` lines, taken forward
from each line and backward from each line. The line with the smallest hash in a window is selected, and its
hash is the window's fingerprint; neighbouring windows of short lines share it. Two equal runs that hold a
whole window select the same line of it, so a run whose selected lines occur once in the corpus is settled by
their positions alone. Where positions meet, the windows around them are compared, and a match extends to both
sides over the windows that touch it: what they cover together is the longest repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, written

WORD = "[^\\x20\\x09-\\x0D]+"
LEN = 1024  # a window is start * LEN + len while it is a number in an array


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _array_windows(h: Column, w: Column, min_words: int, max_lines: int) -> Column:
    """Windows of a document as distinct numbers, from its arrays of line hashes and word counts."""
    n = F.size(h)

    def reach(i: Column, step: int) -> Column:
        """Lines from i on in the direction of step until the window is whole; null where the document ends first."""
        out = F.lit(None).cast("int")
        for k in reversed(range(1, max_lines + 1)):
            words = sum((F.get(w, i + F.lit(step * j)) for j in range(1, k)), F.get(w, i))
            inside = i + F.lit(step * (k - 1))
            whole = (words >= min_words) if k < max_lines else F.lit(True)
            out = F.when((inside >= 0) & (inside < n) & whole, F.lit(k)).otherwise(out)
        return out

    at = F.sequence(F.lit(0), n - 1)
    coded = lambda start, k: start.cast("long") * LEN + k
    forward = F.transform(at, lambda i: coded(i, reach(i, 1)))
    backward = F.transform(F.transform(at, lambda i: F.struct(i.alias("i"), reach(i, -1).alias("k"))), lambda x: coded(x["i"] - x["k"] + 1, x["k"]))
    return F.filter(F.array_distinct(F.concat(forward, backward)), lambda x: x.isNotNull())


def line_windows(docs: DataFrame, *, min_words: int = 4, max_lines: int = 3) -> DataFrame:
    """Rows ``doc_id, text_key, start, len, pos, fingerprint, k1, k2``: a document's windows, the line that each selects, and what it holds."""
    if not 1 <= max_lines < LEN:
        raise ValueError(f"max_lines must be 1 to {LEN - 1}")
    arrays = docs.select("doc_id", text_key("text").alias("text_key"), _lines(F.col("text")).alias("ls")).select(
        "doc_id", "text_key",
        F.transform("ls", lambda x: F.xxhash64(x)).alias("h"), F.transform("ls", lambda x: F.xxhash64(F.lit("second"), x)).alias("g"),
        F.transform("ls", lambda x: F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))).alias("w"),
    )
    each = arrays.select("doc_id", "text_key", "h", "g", _array_windows(F.col("h"), F.col("w"), min_words, max_lines).alias("windows"))
    start, size = lambda x: F.floor(x / LEN).cast("int"), lambda x: (x % LEN).cast("int")
    parts = lambda a, x: F.slice(a, start(x) + 1, size(x))
    held = F.transform(
        "windows",
        lambda x: F.struct(
            start(x).alias("start"), size(x).alias("len"), (start(x) + F.array_position(parts(F.col("h"), x), F.array_min(parts(F.col("h"), x))) - 1).cast("int").alias("pos"),
            F.array_min(parts(F.col("h"), x)).alias("fingerprint"), F.xxhash64(parts(F.col("h"), x)).alias("k1"), F.xxhash64(F.lit("second"), parts(F.col("g"), x)).alias("k2"),
        ),
    )
    return each.select("doc_id", "text_key", F.inline(held))


def _place(line: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"), F.col(line))


def repeated_windows(docs: DataFrame, *, min_words: int = 4, max_lines: int = 3) -> DataFrame:
    """Rows ``doc_id, text_key, start, len`` of windows that occur earlier, by (doc_id with null last, text, line).

    Windows are made once and written. Fingerprints that are selected at two positions and first positions of
    what windows hold are minima and maxima, pre-aggregated before they are shuffled, and written tables too,
    so that Spark splits the hot keys of the joins back.
    """
    windows = written(line_windows(docs, min_words=min_words, max_lines=max_lines), "windows")
    ends = windows.groupBy("fingerprint").agg(F.min(_place("pos")).alias("first"), F.max(_place("pos")).alias("last"))
    shared = written(ends.filter("first <> last").select("fingerprint"), "fingerprints")
    met = written(windows.join(shared, "fingerprint").drop("fingerprint", "pos"), "matches")
    starts = met.groupBy("k1", "k2").agg(F.min(_place("start")).alias("first"), F.max(_place("start")).alias("last"))
    first = written(starts.filter("first <> last").drop("last"), "firsts")
    return met.join(first, ["k1", "k2"]).filter(_place("start") > F.col("first")).select("doc_id", "text_key", "start", "len")


def dedup_lines(docs: DataFrame, *, min_words: int = 4, max_lines: int = 3) -> DataFrame:
    """``docs`` with ``text`` without repeated runs, and ``removed_lines`` and ``total_lines``.

    A run of lines with at least ``min_words`` words or ``max_lines`` lines goes if it occurs earlier, in an
    earlier document or further up in its own; the first occurrence stays. Null texts stay null, with no
    lines; empty texts are one empty line. A document may be left with an empty text. Rows equal in doc_id
    and text come out alike. Input columns with the added names are replaced; an empty table gives no rows.
    """
    found = repeated_windows(docs, min_words=min_words, max_lines=max_lines)
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key("text").alias("key"))
    met = rows.join(spans, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key")), "left")
    # lines are a column of their own, read twice below, so that they aren't split again for each line
    joined = met.select("row", "gone", _lines(F.col("row.text")).alias("ls"))
    text = F.col("row.text")
    stay = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("ls"), i)), "\n")
    new = {
        "text": F.when(F.col("gone").isNull(), text).otherwise(left),
        "removed_lines": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")),
        "total_lines": F.when(text.isNull(), 0).otherwise(F.size("ls")),
    }
    names = [*docs.columns, *(c for c in ("removed_lines", "total_lines") if c not in docs.columns)]
    return joined.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in names))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "text", "total_lines", "removed_lines")


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, text
  FROM documents
), c AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l
), e AS (
  SELECT *, lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2, lead(w, 1) OVER d AS w1, lead(w, 2) OVER d AS w2,
         lag(line, 1) OVER d AS p1, lag(line, 2) OVER d AS p2, lag(w, 1) OVER d AS q1, lag(w, 2) OVER d AS q2
  FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), f AS (
  SELECT doc_id, i AS s, CASE WHEN w >= 4 THEN [line] WHEN l1 IS NOT NULL AND w + w1 >= 4 THEN [line, l1] WHEN l2 IS NOT NULL THEN [line, l1, l2] END AS k FROM e
  UNION
  SELECT doc_id, i - len(k) + 1, k FROM (
    SELECT doc_id, i, CASE WHEN w >= 4 THEN [line] WHEN p1 IS NOT NULL AND w + q1 >= 4 THEN [p1, line] WHEN p2 IS NOT NULL THEN [p2, p1, line] END AS k FROM e
  ) WHERE k IS NOT NULL
), o AS (
  SELECT doc_id, s, k, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM f WHERE k IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + len(k))) AS i FROM o WHERE nth > 1
), r AS (
  SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE g.i IS NULL) AS t,
         count(*) AS total, count(g.i) AS removed
  FROM c LEFT JOIN g ON c.doc_id = g.doc_id AND c.i = g.i GROUP BY c.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.t, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE r.total END AS INTEGER) AS total_lines, CAST(r.removed AS INTEGER) AS removed_lines
FROM documents d JOIN r ON d.doc_id = r.doc_id
"""
