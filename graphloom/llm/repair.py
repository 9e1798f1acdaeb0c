"""Repair of conversations: the cheapest edits that make the roles ``(system? (user assistant)+)?``, by min-plus matrices.

What a turn can do is a 4 x 4 matrix over the states of that pattern (start, after a system, user or assistant
turn), closed under inserts, whose elements are a cost and the initials of the edits. Products take the least of
such pairs. Two audits of one cost over the same turns never extend each other, as the longer one would have paid for
its inserts, so the product is associative, ties included. A conversation is cut into segments of ``SPAN`` turns of
a global order; segments are multiplied in rounds of ``FAN`` neighbours, each a written table, so no task
holds a conversation's turns, however many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

SPAN, FAN = 16, 8  # turns of a segment; neighbours multiplied at once
SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = ("user", "user", "assistant", "user")  # the role that an insert or a new role takes in a state
Element = tuple[int, str]
Matrix = list[Element | None]


def product(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus: the cheapest way through, on ties that of the ASCII-least audit."""
    out: Matrix = []
    for p in range(0, 16, 4):
        for q in range(4):
            ways = [(a[0] + b[0], a[1] + b[1]) for m in range(4) if (a := x[p + m]) and (b := y[4 * m + q])]
            out.append(min(ways, default=None))
    return out


def _closure() -> Matrix:
    """No insert or as many as lead from a state to another at the least cost."""
    out: Matrix = [None] * 16
    for p in range(4):
        out[5 * p], at, n = (0, ""), p, 0
        while (at := NEXT[at][MADE[at][0]]) and (n := n + 1) and out[4 * p + at] is None:
            out[4 * p + at] = (INSERT * n, "I" * n)
    return out


INSERTS = _closure()


@cache
def turn_matrix(code: str) -> tuple[Element | None, ...]:
    """The matrix of a turn: its role's initial (``x`` for others), upper case where it must go, a digit where it is truncated."""
    must_go, truncated = code.isupper(), TRUNCATED * code.isdigit()
    initial = "suax"[int(code)] if truncated else code.lower()
    edit: Matrix = [None] * 16
    for p in range(4):
        edit[5 * p] = (DELETE, "D")
        if not must_go:
            made = NEXT[p][MADE[p][0]]
            edit[4 * p + made] = min(edit[4 * p + made] or (99, ""), (REROLE + truncated, "R"))
            if initial in NEXT[p]:
                kept = NEXT[p][initial]
                edit[4 * p + kept] = min(edit[4 * p + kept] or (99, ""), (KEEP + truncated, "K"))
    return tuple(product(INSERTS, edit))


def tree(matrices: list[Matrix]) -> Matrix:
    """The product in order, neighbours first, so that audits are copied as often as the tree is high."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


ELEMENTS = T.StructType().add("costs", T.ArrayType(T.LongType())).add("audits", T.ArrayType(T.StringType()))


def _frame(found: list[Matrix]) -> pd.DataFrame:
    return pd.DataFrame({"costs": [[e[0] if e else 0 for e in m] for m in found], "audits": [[e and e[1] for e in m] for m in found]}, columns=["costs", "audits"])


def _matrix(costs, audits) -> Matrix:
    return [None if a is None else (int(c), a) for c, a in zip(costs, audits, strict=True)]


@F.pandas_udf(ELEMENTS)
def segment_matrix(codes: pd.Series) -> pd.DataFrame:
    known: dict[str, Matrix] = {}
    for c in set(codes):
        known[c] = tree([list(turn_matrix(x)) for x in c])
    return _frame([known[c] for c in codes])


@F.pandas_udf(ELEMENTS)
def neighbours_matrix(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
    return _frame([tree([_matrix(*m) for m in zip(*both, strict=True)]) for both in zip(costs, audits, strict=True)])


@F.pandas_udf(T.StructType().add("cost", T.LongType()).add("audit", T.StringType()))
def cheapest(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
    """From the start to a state that may end, inserts after the last turn included."""
    ends = [product(_matrix(*m), INSERTS) for m in zip(costs, audits, strict=True)]
    return pd.DataFrame([min(m[0], m[3]) for m in ends], columns=["cost", "audit"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with a fault each by the CRC-32 of ``conv_id:turn`` (null: one space) modulo 20.

    0 drops a row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's. Null roles and
    texts are one space. Other columns are left out; an empty table gives an empty one.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _ordered(turns: DataFrame, *more: Column | str) -> DataFrame:
    """Turns as strings, with the key that duplicates share: conversation, role and text."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.octet_length("role"), "role", "text")))
    return rows.select("conv_id", "turn", "role", "text", key.alias("key"), *more)


ORDER = ["conv_id", "turn", "role", "key"]  # nulls first


def coded_turns(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, at, code, blank, duplicate, truncated``: a turn's first fault, its place in the order of all turns.

    Turns are dealt by range of the whole order, so a long conversation lies in several partitions. Only what decides
    goes along, not the text. Equal rows are told apart by where they were read, so that they can be dealt apart, too.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    narrow = _ordered(turns, F.col("role").substr(1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("read")).drop("text")
    placed = written(narrow.repartitionByRange(*ORDER, "read").sortWithinPartitions(*ORDER, "read").withColumn("at", F.monotonically_increasing_id()).drop("read", "role"), "repair-turns")
    repeated = written(placed.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repair-repeated")
    met = placed.join(repeated, "key", "left")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    blank, duplicate = F.col("blank"), ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    truncated = ~blank & ~duplicate & F.col("open")
    code = F.when(blank | duplicate, F.upper(initial)).when(truncated, F.translate(initial, "suax", "0123")).otherwise(initial)
    return met.select("conv_id", "turn", "at", code.alias("code"), *(c.cast("long").alias(n) for c, n in ((blank, "blank"), (duplicate, "duplicate"), (truncated, "truncated"))))


def segments(coded: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows ``conv_id, seg, costs, audits, illegal, head, tail``: what the turns of a conversation in a stretch of the order do together.

    ``seg`` numbers stretches through all partitions. At most ``span`` turns are gathered for a row.
    """
    mask = (1 << 33) - 1  # the place within a partition
    part, stretch = F.shiftright("at", 33), (F.col("at").bitwiseAND(F.lit(mask)) / span).cast("long")
    gathered = coded.groupBy("conv_id", part.alias("part"), stretch.alias("stretch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "").alias("codes"))
    roles = F.translate("codes", "SUAX0123", "suaxsuax")
    pairs = F.regexp_replace(roles, "(?=su|ua|au)(.)", "$1 ")  # a legal pair is parted by a blank
    made = written(
        gathered.withColumn("m", segment_matrix("codes")).select("conv_id", "part", "stretch", "m.*", (F.length("codes") - 1 - F.length(pairs) + F.length("codes")).cast("long").alias("illegal"), F.substring(roles, 1, 1).alias("head"), F.right(roles, F.lit(1)).alias("tail")), "repair-segments"
    )
    ends = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, no more
    before = made.groupBy("part").agg((F.max("stretch") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias("before"))
    return made.join(before, "part").select("conv_id", (F.col("before") + F.col("stretch")).alias("seg"), "costs", "audits", "illegal", "head", "tail")


def _joined(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Neighbours by ``by`` become one row; illegal pairs between them count."""
    near = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seg", "costs", "audits", "illegal", "head", "tail"))).alias("near"))
    between = F.expr("aggregate(sequence(1, size(near)), 0L, (n, i) -> n + if(i < size(near) and not concat(near[i - 1].tail, get(near, i).head) in ('su', 'ua', 'au'), 1, 0) + near[i - 1].illegal)")
    one = near.withColumn("m", neighbours_matrix("near.costs", "near.audits"))
    return one.select("conv_id", F.col("near")[0]["seg"].alias("seg"), "m.*", between.alias("illegal"), F.col("near")[0]["head"].alias("head"), F.element_at("near", -1)["tail"].alias("tail"))


def reduced(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """One row for each conversation, by rounds that join at most ``fan`` neighbours each until none has more than ``fan``."""
    width = fan
    while (rows.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > fan:
        rows = written(_joined(rows, "conv_id", (F.col("seg") / width).cast("long").alias("run")), "repair-round")
        width *= fan
    return _joined(rows, "conv_id")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Repaired:
    """Walks through a conversation's turns and hashes what its audit leaves and adds."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.lines, self.sha = audit, 0, 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1
        self.state = NEXT[self.state][role[0]]

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.line(MADE[self.state], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.line(role if edit == "K" else MADE[self.state], text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order, each a result followed by its turns; one result and one turn are held at a time."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    waiting: tuple[dict, _Repaired] | None = None
    for b in batches:
        done = []
        for a in range(0, b.num_rows, 256):
            for row in b.slice(a, 256).to_pylist():
                if row["kind"]:
                    waiting[1].turn(row["role"], row["text"])
                else:
                    done += [waiting] if waiting else []
                    waiting = (row, _Repaired(row["audit"]))
        yield _results(done, names)
    yield _results([waiting] if waiting else [], names)


def _results(done: list[tuple[dict, _Repaired]], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([r[n] for r, _ in done], pa.string() if n == "audit" else pa.int64()) for n in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array([w.digest() for _, w in done], pa.string())], names=[*names, "repaired_sha256"])


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``turns`` has ``conv_id, turn, role, text``; other columns don't matter. Null roles and texts are one space, a null
    conv_id is a conversation of its own, null turns come first. Turns of one number go by role, then by a
    digest of role and text; repeated rows are duplicates from the second on. ``ids`` may name conversations without turns,
    which get zeros, an empty audit and the hash of nothing; an empty table gives an empty result. Texts move once, to be
    hashed in order: one task reads a conversation's turns as a stream, since SHA-256 has no other order, and holds one turn at a time.
    """
    coded = written(coded_turns(turns), "repair-coded")
    zero, gaps = F.lit(0).cast("long"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long"))
    counts = coded.groupBy("conv_id").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    edits = reduced(segments(coded)).withColumn("best", cheapest("costs", "audits")).select(F.col("conv_id").alias("id"), "illegal", "best.*")
    found = counts.join(edits, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    if ids is not None:
        found = written(found, "repair-found")
        named = ids.select(F.col("conv_id").cast("long").alias("id")).distinct()
        fill = lambda c: F.coalesce(c, F.lit("") if c == "audit" else zero).alias(c)
        found = named.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(F.col("id").alias("conv_id"), *(fill(c) for c in found.columns if c != "conv_id"))
    columns = [x.split() for x in RESULT.split(", ")]
    none = {"turn": "long", "role": "string", "text": "string", "key": "binary"}
    heads = found.select(*(F.col(n).cast(t) for n, t in columns), F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    bodies = _ordered(turns).select("conv_id", *(F.lit(None).cast(t).alias(n) for n, t in columns[1:]), F.lit(1).alias("kind"), *none)
    stream = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "key")
    return stream.mapInArrow(_hashed, RESULT + ", repaired_sha256 string")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged by its turns' CRC-32 and repaired; all nulls, empties and ties as ``repair`` says."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)
