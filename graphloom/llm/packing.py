"""Best-fit packing planned on a length histogram.

Documents become token pieces of at most one sequence. The plan looks at how many pieces there are of
each length, never at pieces: best-fit decreasing over counts fills classes of equal sequences and gives
out runs of slots for runs of ranks. Pieces then take their slots by their rank within their length.
The plan's size depends on the sequence length alone, not on the number of documents.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key, written

LONG = 400_000  # characters; longer texts go to tokenizers itself, as the fast encoder's pattern overflows its stack on long runs
PIECES = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, object] = {}


class Encoder:
    """The ids that tokenizers gives for a file of its own.

    The same vocabulary as ranks gives the same ids several times faster; texts that hold the string of a
    special token and texts over ``LONG`` characters go to tokenizers itself.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers as files
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(files.path(f"{name}.json"))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(files.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if len(text) > LONG or any(s in text for s in self.special):
            return self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.fast.encode_ordinary(text)


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def token_pieces(docs: DataFrame, *, capacity: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut where longer than ``capacity``: full pieces, the first may be shorter.

    Null and empty texts are the end id alone. ``keep_ids`` adds the ids themselves (``ids``, array<int>).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.array([*encode(cell.as_py() or ""), end_id], "<u4")
                at, end = 0, len(ids) % capacity or min(capacity, len(ids))
                piece = 0
                while at < len(ids):
                    part = ids[at:end]
                    rows.append((doc, key, piece, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if keep_ids else [])))
                    at, end, piece = end, end + capacity, piece + 1
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if keep_ids else [])]
            names = ["doc_id", "text_key", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    own = docs.select(F.col("doc_id").cast("long"), text_key("text").alias("text_key"), "text")
    return own.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


@dataclass
class Run:
    """Pieces ``rank .. rank + count`` of one length go to sequences ``sequence ..``, one each, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over counts. A class is a run of sequences with the same fill.

    Longest lengths first; each goes to the class with the least room that still holds it, as many pieces
    as the class has sequences; what is left opens new sequences, each with as many of that length as fit.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, sequence: int, count: int) -> None:
        if room and count:
            by_room.setdefault(room, []).append((sequence, count))

    plan: list[Run] = []
    used = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        while left:
            fit = min((r for r in by_room if r >= length), default=None)
            if fit is None:
                break
            sequence, count = by_room[fit].pop()
            if not by_room[fit]:
                del by_room[fit]
            take = min(left, count)
            plan.append(Run(length, rank, take, sequence, capacity - fit))
            put(fit, sequence + take, count - take)
            put(fit - length, sequence, take)
            left, rank = left - take, rank + take
        per = capacity // length
        for n, each in ((left // per, per), (1 if left % per else 0, left % per)):
            for k in range(each if n else 0):
                plan.append(Run(length, rank, n, used, k * length))
                rank += n
            put(capacity - each * length, used, n)
            used += n
    return plan


def rank_within_length(pieces: DataFrame, rows: int, per_group: int = 20_000) -> DataFrame:
    """Adds ``_rank``, from 0 within ``length``: salted groups are ranked alone and shifted by the groups before.

    No group holds more than about ``per_group`` pieces, however many share a length.
    """
    salts = max(64, -(-rows // per_group))
    order = ["doc_id", "text_key", "piece"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("length", "_salt", before.alias("_shift"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    return salted.withColumn("_own", own).join(shifts, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_shift")).drop("_own", "_shift", "_salt")


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: sequences hold at most ``capacity`` tokens, without gaps.

    ``pieces`` is read more than once; pass a written table. It has ``doc_id, text_key, piece, length``; null ids
    are ordered like others, equal rows take slots of their own, and an empty table gives no rows. Columns named
    ``sequence_id`` or ``offset`` are replaced, others stay; names that begin with an underscore are the operator's own.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(best_fit_plan(counts, capacity), key=lambda r: (r.length, r.rank))
    spread = 1 << 48
    starts = np.array([r.length * spread + r.rank for r in runs], np.int64)
    ranks = np.array([r.rank for r in runs], np.int64)
    sequences = np.array([r.sequence for r in runs], np.int64)
    offsets = np.array([r.offset for r in runs], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("_rank").to_numpy()
            at = np.searchsorted(starts, b.column("length").to_numpy() * spread + rank, side="right") - 1
            kept = [i for i, name in enumerate(b.schema.names) if name != "_rank"]
            arrays = [b.column(i) for i in kept] + [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(b.schema.names[i] for i in kept), "sequence_id", "offset"])

    ranked = rank_within_length(pieces, sum(counts.values()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, capacity: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 2) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end id; null ids stay null; rows that repeat are packed as often as
    they occur, ties falling to (doc_id, text, piece); other columns of ``docs`` don't matter; an empty table gives no rows.
    """
    pieces = written(token_pieces(docs, capacity=capacity, tokenizer=tokenizer, end_id=end_id), "pieces")
    return packed(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """``pack_documents`` of the whole table in sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=1024)
