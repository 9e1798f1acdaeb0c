"""Substring deduplication by content-defined chunking.

A gear rolling hash over the bytes cuts texts where its top bits are zero, so cuts depend on the last few
bytes alone and come back in step after an insertion. Units of two neighbouring chunks are deduplicated
by digest over the whole corpus: a unit that occurs earlier is a repeat, and repeats that touch make a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_present, presence, text_key, written

WINDOW = 16  # bytes that a cut depends on
GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 16, 256, dtype=np.uint16)
PRESENT = 26  # log2 of the bits that say which digests occur twice
UNIT = "doc_id long, text_key long, digest long, digest2 long, start long, len long"
DIGEST = ["digest", "digest2"]


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = sum over j < 16 of gear[data[i - j]] << j, modulo 2**16, by doubling the window."""
    h, span = gear.copy(), 1
    while span < WINDOW:
        moved = np.zeros_like(h)
        moved[span:] = h[:-span] << np.uint16(span)
        h = h + moved
        span *= 2
    return h


def chunk_ends(text: bytes | np.ndarray, bits: int, longest: int) -> np.ndarray:
    """Ends of a text's chunks: content cuts, moved to the next character, and cuts where a chunk would pass ``longest``."""
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hashes(data, GEAR[data])
    found = np.flatnonzero(h < np.uint16(1 << (16 - bits))) + 1
    ends = np.union1d(found[found < n], [n])
    gaps = np.diff(ends, prepend=0)
    if (gaps > longest).any():
        ends = np.union1d(ends, np.concatenate([np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest], strict=True)]))
    inside = ends < n
    for _ in range(3):  # not within a character of several bytes
        ends = np.where(inside & (data[np.minimum(ends, n - 1)] & 0xC0 == 0x80), ends + 1, ends)
        inside = ends < n
    return np.unique(ends)


def unit_digests(parts: list[bytes]) -> np.ndarray:
    """A row of two longs for each part: its 128-bit digest, by which alone units are equal."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in parts), ">i8").astype(np.int64).reshape(-1, 2)


def units(docs: DataFrame, *, bits: int, longest: int, twice: np.ndarray | None = None) -> DataFrame:
    """Rows ``doc_id, text_key, digest, digest2, start, len`` (bytes): every two neighbouring chunks, or a text's only one.

    ``len`` is negative for a text's last unit. With ``twice`` (``presence`` of their first halves) most units that occur once are left out.
    """
    held = None if twice is None else docs.sparkSession.sparkContext.broadcast(twice)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                rows, digests, starts, sizes = [], [], [], []
                for i, text in enumerate(some.column(2)):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    ends = chunk_ends(raw, bits, longest)
                    if not len(ends):
                        continue
                    edge = [0, *ends.tolist()]
                    a, z = (edge[:-2], edge[2:]) if len(edge) > 2 else (edge[:1], edge[1:])
                    own = unit_digests([raw[s:e] for s, e in zip(a, z, strict=True)])
                    size = np.array(z, np.int64) - np.array(a, np.int64)
                    size[-1] = -size[-1]
                    kept = np.arange(len(own)) if held is None else np.flatnonzero(maybe_present(held.value, np.ascontiguousarray(own[:, 0])))
                    digests.append(own[kept])
                    starts.append(np.array(a, np.int64)[kept])
                    sizes.append(size[kept])
                    rows.append(np.full(len(kept), i))
                if rows:
                    pick, both = pa.array(np.concatenate(rows)), np.concatenate(digests)
                    columns = [some.column(0).take(pick), some.column(1).take(pick), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", *DIGEST, "start", "len"])

    return docs.select(F.col("doc_id").cast("long"), text_key("text").alias("text_key"), "text").mapInArrow(cut, UNIT)


def repeated_spans(docs: DataFrame, *, min_bytes: int = 100, bits: int = 5, longest: int = 256) -> DataFrame:
    """Rows ``doc_id, text_key, start, len, units, first_doc_id``: spans of a text that occur earlier in the corpus.

    Earlier is by (doc_id with null last, text, position); chunks average 2**bits bytes. ``start`` and
    ``len`` are bytes of the UTF-8 text, ``first_doc_id`` the earliest document that has the span's first
    unit. Spans under ``min_bytes`` are chance and left out, but for those that are a whole text. Null and empty texts have none, nor has an
    empty table; rows equal in doc_id and text are one document and count once. First positions are
    pre-aggregated by digest; those of digests that occur twice are a written table, so that Spark splits hot ones
    in the join back, to which tasks send hardly any other units. Other columns of ``docs`` don't matter.
    """
    own = units(docs, bits=bits, longest=longest)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"), F.col("start"))
    first = own.groupBy(*DIGEST).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select(*DIGEST, "first")
    first = written(first, "firsts")
    own = units(docs, bits=bits, longest=longest, twice=presence(first, "digest", PRESENT))
    again = own.join(first, DIGEST).filter(place > F.col("first")).select("doc_id", "text_key", "start", F.abs("len").alias("len"), (F.col("len") < 0).alias("ends"), F.col("first.doc_id").alias("first_doc_id"))
    again = again.dropDuplicates(["doc_id", "text_key", "start"])
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("start")
    ends = F.max(F.col("start") + F.col("len")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = again.withColumn("new", (F.coalesce(ends, F.lit(-1)) < F.col("start")).cast("int")).withColumn("span", F.sum("new").over(by_doc))
    merged = spans.groupBy("doc_id", "text_key", "span").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("len")) - F.min("start")).alias("len"), F.count("*").alias("units"), F.min_by("first_doc_id", "start").alias("first_doc_id"), F.max("ends").alias("ends")
    )
    return merged.filter((F.col("len") >= min_bytes) | (F.col("start") == 0) & F.col("ends")).drop("span", "ends")


def dedup_substrings(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``text`` without its repeated spans, and ``removed_bytes``; a fully repeated text becomes empty."""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("gone_spans")
            texts = []
            for text, spans in zip(b.column(at + 1).to_pylist(), b.column(at).to_pylist(), strict=True):
                raw, out, done = (text or "").encode(), [], 0
                for s in sorted(spans or [], key=lambda s: s["start"]):
                    out.append(raw[done : s["start"]])
                    done = s["start"] + s["len"]
                texts.append(text if not spans else (b"".join(out) + raw[done:]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "new_text"])

    spans = repeated_spans(docs, **settings).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "len")).alias("gone_spans"))
    spans = spans.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "gone_spans")
    rows = docs.select(F.struct("*").alias("row"))
    met = rows.join(spans, F.col("row.doc_id").cast("long").eqNullSafe(F.col("g_id")) & (text_key(F.col("row.text")) == F.col("g_key")), "left").select("row", "gone_spans", F.col("row.text").alias("text"))
    clean = met.mapInArrow(removed, f"row {rows.schema['row'].dataType.simpleString()}, new_text string")
    new = {"text": F.col("new_text"), "removed_bytes": F.coalesce(F.octet_length("row.text") - F.octet_length("new_text"), F.lit(0))}
    return clean.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in [*docs.columns, *({"removed_bytes"} - {*docs.columns})]))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated spans of all whole texts of the table."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")
