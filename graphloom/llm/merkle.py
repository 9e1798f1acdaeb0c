"""Merkle manifest of a dataset: supersteps over RDDs of nodes, messages up to parents, sibling paths back down to leaves.

A tree for each language, eight children to a node, and a tree over their roots. In a superstep every node sends its
digest by key to its ancestor three levels up; one that has heard from all below it hashes the levels between and sends on.
The runs that met are saved in the shared folder, which cuts lineage. Reverse supersteps join the runs
with what their ancestors know and send each node the siblings on its way to the root. No key ever gets more than 512
messages, and neither a tree nor a level is held in one place: the driver sees counts, the height that follows from them, and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD, SparkContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table, written

FAN, STEP = 8, 3  # children of a node; levels that a superstep climbs
SPAN = FAN**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Sides = tuple[bytes, bytes]  # digests of the siblings before and after a node, put together


def digest(*inputs: bytes) -> bytes:
    """SHA-256 of digests, each taken as hex text."""
    return hashlib.sha256(b"".join(inputs).hex().encode()).digest()


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 of a document's fields; ``changed`` names those to be taken from elsewhere."""
    return F.unhex(F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256))


def tampered_text() -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the id in decimals; a null id leaves it."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))


def placed_leaves(documents: DataFrame, now: Column) -> DataFrame:
    """Rows ``tree, place, size, doc_id, leaf, now``: a leaf's place among its language's, and the digest of what is there now.

    Leaves are dealt by range of language (null first), id and digest, so a large language lies in many partitions;
    equal rows, told apart by where they were read, may, too. ``tree`` numbers languages in order, with gaps.
    """
    rows = documents.select("lang", "doc_id", leaf_digest().alias("leaf"), leaf_digest(text=now).alias("now"), F.monotonically_increasing_id().alias("read"))
    order = ["lang", "doc_id", "leaf"]
    placed = written(rows.repartitionByRange(*order, "read").sortWithinPartitions(*order, "read").withColumn("at", F.monotonically_increasing_id()).drop("read"), "merkle-leaves")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, no more
    before = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(ends), F.lit(0)).alias("before"))
    dense = placed.withColumn("part", part).join(before, "part").select("lang", "doc_id", "leaf", "now", (F.col("before") + within).alias("at"))
    trees = written(dense.groupBy("lang").agg(F.min("at").alias("tree"), F.count("*").alias("size")), "merkle-trees").withColumnRenamed("lang", "of")
    return dense.join(trees, F.col("lang").eqNullSafe(F.col("of"))).select("tree", (F.col("at") - F.col("tree")).alias("place"), "size", "doc_id", "leaf", "now")


def _parts(sc: SparkContext, n: int) -> int:
    return max(1, -(-n // 200_000), min(-(-n // 4_000), 2 * sc.defaultParallelism))


def _saved(rdd: RDD, spark: SparkSession, label: str) -> RDD:
    path = fresh_path(spark, label)
    rdd.saveAsPickleFile(path, 8)
    return spark.sparkContext.pickleFile(path)


def height(size: int, fan: int = FAN) -> int:
    return 0 if size <= 1 else 1 + height(-(-size // fan), fan)


def _sent(node: tuple) -> tuple:
    tree, place, size, own, payload = node
    return (tree, place // SPAN), (place % SPAN, size, own, payload)


def _heard(met: tuple) -> tuple:
    """An ancestor's run: it is complete once all that its place leaves it have sent."""
    (tree, place), messages = met
    run = sorted(messages, key=lambda m: m[0])
    size = run[0][1]
    if [m[0] for m in run] != list(range(min(SPAN, size - SPAN * place))):
        raise ValueError(f"tree {tree}: nodes below {place} are missing or repeated")
    return (tree, place), (size, [(own, payload) for _, _, own, payload in run])


def _hashed(size: int, digests: list[bytes]) -> list[list[bytes]]:
    """The levels from a run up to its ancestor, ``STEP`` further up, or to the root where the whole tree is there."""
    levels = [digests]
    for _ in range(min(STEP, height(size))):
        last = levels[-1]
        levels.append([digest(*last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def _forwarded(run: tuple) -> tuple:
    (tree, place), (size, children) = run
    return tree, place, -(-size // SPAN), _hashed(size, [own for own, _ in children])[-1][0], None


def climb(nodes: RDD, most: int, total: int, spark: SparkSession) -> tuple[list[RDD], list[RDD]]:
    """Supersteps up from ``(tree, place, size, digest, payload)``, ``size`` (2 at least) being the number of the tree's nodes there.

    Gives the runs that met in each, ``((tree, place above), (size, [(digest, payload) of each]))``, and the roots
    that each completed, ``(tree, (supersteps, digest, None))``. ``most`` is the largest tree's number of leaves.
    """
    levels: list[RDD] = []
    roots: list[RDD] = []
    for step in range(1, height(most, SPAN) + 1):
        total = max(1, -(-total // SPAN))
        met = nodes.map(_sent).groupByKey(_parts(spark.sparkContext, total * FAN)).coalesce(_parts(spark.sparkContext, total * FAN))
        levels.append(_saved(met.map(_heard), spark, f"merkle-runs-{step}"))
        roots.append(levels[-1].filter(lambda r: r[1][0] <= SPAN).map(_forwarded).map(lambda n, step=step: (n[0], (step, n[3], None))))
        nodes = levels[-1].filter(lambda r: r[1][0] > SPAN).map(_forwarded)
    return levels, roots


def _passed(met: tuple) -> Iterator[tuple]:
    """A run and what its ancestor knows: each node hears of its siblings and its parents' siblings, then of the ancestor's way."""
    (tree, place), ((size, children), (top, way)) = met
    levels = _hashed(size, [own for own, _ in children])[:-1]
    for i, (own, payload) in enumerate(children):
        sides, at = [], i
        for level in levels:
            run = at // FAN * FAN
            sides.append((b"".join(level[run:at]), b"".join(level[at + 1 : run + FAN])))
            at //= FAN
        yield (tree, SPAN * place + i), (top, (*sides, *way)), own, payload


def descend(levels: list[RDD], roots: RDD, total: int, spark: SparkSession) -> RDD:
    """Reverse supersteps: ``((tree, place), (top, way), digest, payload)`` of every leaf below a root.

    ``roots`` has ``(tree, (supersteps, top, way))``; ``way`` holds the siblings' digests before and after a node, level by
    level up to the root, and a leaf's begins at its own run. A root of no supersteps is a leaf itself and isn't among them.
    """
    known: RDD | None = None
    for step in range(len(levels), 0, -1):
        parts = _parts(spark.sparkContext, -(-total // SPAN**step) * FAN)
        here = roots.filter(lambda r, step=step: r[1][0] == step).map(lambda r: ((r[0], 0), r[1][1:]))
        known = here if known is None else known.map(lambda n: n[:2]).union(here)
        known = levels[step - 1].join(known, parts).coalesce(parts).flatMap(_passed)
    return known


def folded(leaf: bytes, way: Iterable[Sides]) -> bytes:
    """The root that follows from a leaf and the siblings on its way."""
    for before, after in way:
        leaf = digest(before, leaf, after)
    return leaf


def proof_digest(way: Iterable[Sides]) -> bytes:
    return digest(*(side for both in way for side in both))


def proofs(documents: DataFrame, now: Column) -> tuple[RDD, bytes] | None:
    """Every document's ``(doc_id, leaf, digest now, subroot, way)``, and the root; None for an empty table."""
    spark = documents.sparkSession
    sc, leaves = spark.sparkContext, written(placed_leaves(documents, now), "merkle-placed")
    total, most = leaves.agg(F.count("*"), F.max("size")).first()
    if not total:
        return None
    nodes = lambda of: leaves.filter(of).rdd.map(lambda r: (r.tree, r.place, r.size, bytes(r.leaf), (r.doc_id, bytes(r.now))))
    levels, roots = climb(nodes("size > 1"), most, total, spark)
    subroots = sc.union([nodes("size = 1").map(lambda n: (n[0], (0, n[3], n[4]))), *roots])
    # numbered before they are saved: saved files come back in any order
    subroots = _saved(subroots.sortByKey(numPartitions=_parts(sc, total)).zipWithIndex(), spark, "merkle-subroots")
    trees = subroots.count()
    tops = subroots.map(lambda x: (-1, x[1], trees, x[0][1][1], (x[0][0], *x[0][1])))
    if trees > 1:
        upper, top = climb(tops, trees, trees, spark)
        root = top[-1].first()[1][1]
        ways = descend(upper, sc.parallelize([(-1, (len(upper), root, ()))], 1), trees, spark)
    else:
        root = tops.first()[3]
        ways = tops.map(lambda n: ((-1, 0), (root, ()), n[3], n[4]))
    # (tree, (supersteps, subroot, way from there), payload of a lone leaf)
    below = _saved(ways.map(lambda n: (n[3][0], (n[3][1], n[2], n[1][1]), n[3][3])), spark, "merkle-ways")
    alone = below.filter(lambda n: n[2] is not None).map(lambda n: (n[2][0], n[1][1], n[2][1], n[1][1], n[1][2]))
    if not levels:
        return alone, root
    leaf_ways = descend(levels, below.filter(lambda n: n[1][0] > 0).map(lambda n: n[:2]), total, spark)
    return leaf_ways.map(lambda n: (n[3][0], n[2], n[3][1], n[1][0], n[1][1])).union(alone), root


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified_manifest(documents: DataFrame, now: Column | None = None) -> DataFrame:
    """Per document its leaf, its language's root, the root, its proof's digest and the root that its text of now leads to.

    ``documents`` has ``doc_id, source, lang, n_chars, text``, of which any may be null, and maybe other columns, which
    don't matter; ``now`` is the text held against the manifest (the same if left out). Rows of one id go by their digest,
    repeated rows are leaves each. A null language comes first. A single document is its own subroot and root, with an
    empty proof; an empty table gives an empty result.
    """
    found = proofs(documents, F.col("text") if now is None else now)
    if found is None:
        return documents.sparkSession.createDataFrame([], RESULT)
    rows, root = found

    def checked(row: tuple) -> Row:
        doc_id, leaf, present, subroot, way = row
        end = folded(present, way)
        return doc_id, leaf.hex(), subroot.hex(), root.hex(), proof_digest(way).hex(), end.hex(), end == root

    return documents.sparkSession.createDataFrame(rows.map(checked), RESULT, verifySchema=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the whole table, held against texts of which a third lost their capitals; nulls and ties as ``verified_manifest`` says."""
    return verified_manifest(table(spark, sf_dir, "documents"), tampered_text())
