"""Language identification with interpolated Kneser-Ney character models in sorted arrays.

Counts of character 4-grams come from every training text; lower orders are continuation counts, the
numbers of distinct characters seen before. Grams and contexts are kept as they are, packed into a long, so
counts are never merged; the arrays that go to the tasks hold each distinct gram and context of the corpus
once for each language and order, and grow with these. A text gets the language whose
model has the lowest cross-entropy per character; a confidence and a rejection bound are calibrated on
texts that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, text_key, written

ORDER = 4
SEP = "\0" * 3
CHARS = 2_000_000  # of texts that are worked on at once
BINS = 40


def letter_table() -> np.ndarray:
    """1 for the 16-bit code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


_LETTERS: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct packed 4-grams, the gram of each position, the text of each position).

    Texts are lower-cased; runs of other characters than letters are one space. Each text starts from
    spaces of its own. Characters past 16 bits are folded into the upper half of them.
    """
    if not _LETTERS:
        _LETTERS.append(letter_table())
    joined = SEP + SEP.join(t.lower().replace("\0", " ") for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    big = raw > 0xFFFF
    code = np.where(big, (raw * np.uint32(2654435761) >> np.uint32(17)) | np.uint32(0x8000), raw).astype(np.uint16)
    letter = _LETTERS[0][np.where(big, 0, raw)]
    if big.any():
        letter[big] = [chr(c).isalpha() for c in raw[big].tolist()]
    code[~letter] = 0
    start = raw == 0
    keep = letter | start | np.concatenate([[True], letter[:-1]])
    code, start = code[keep], start[keep]
    text = np.cumsum(start) // 3 - 1
    sym, width = np.unique(code), 0
    width = len(sym)
    lut = np.zeros(1 << 16, np.int64)
    lut[sym] = np.arange(width)
    s = lut[code]
    at = np.flatnonzero(~start)
    at = at[at >= 3]
    if width**4 <= 1 << 23:
        ids = ((s[at - 3] * width + s[at - 2]) * width + s[at - 1]) * width + s[at]
        seen = np.zeros(width**4, bool)
        seen[ids] = True
        own = np.flatnonzero(seen)
        back = np.zeros(width**4, np.int32)
        back[own] = np.arange(len(own))
        inverse = back[ids]
        parts = [own // width**3, own // width**2 % width, own // width % width, own % width]
        packed = sum(sym[p].astype(np.uint64) << np.uint64(16 * (3 - i)) for i, p in enumerate(parts)) if len(own) else np.zeros(0, np.uint64)
    else:
        c = code.astype(np.uint64)
        packed, inverse = np.unique(c[at - 3] << np.uint64(48) | c[at - 2] << np.uint64(32) | c[at - 1] << np.uint64(16) | c[at], return_inverse=True)
    return packed, inverse, text[at]


def by_size(texts: list[str | None], most: int = CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) of at most about ``most`` characters; longer texts stand alone, whole."""
    at, some, held = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if some and held + len(t) > most:
            yield at, some
            at, some, held = i, [], 0
        some.append(t)
        held += len(t)
    if some:
        yield at, some


def hash64(x: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte integers with seed 42, as Spark's xxhash64 of a long."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = (p5 + np.uint64(50)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


@dataclass
class SortedGrams:
    """Values by packed gram, found by binary search."""

    grams: np.ndarray
    values: np.ndarray

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros((len(grams), self.values.shape[1]))
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where((self.grams[at] == grams)[:, None], self.values[at], 0)


@dataclass
class Model:
    languages: list[str]
    tables: dict[tuple[str, int, str], SortedGrams]
    discounts: dict[tuple[str, int], float]
    alphabet: int
    right: list[float] = field(default_factory=lambda: [1.0] * BINS)
    bound: dict[str, float] = field(default_factory=dict)

    def bits_of(self, packed: np.ndarray) -> np.ndarray:
        """-log2 P of each gram's last character after the others: grams x languages."""
        out = np.zeros((len(packed), len(self.languages)))
        for j, lang in enumerate(self.languages):
            p = np.full(len(packed), 1.0 / self.alphabet)
            for n in range(1, ORDER + 1):
                gram = packed & np.uint64((1 << (16 * n)) - 1) if n < 4 else packed
                d = self.discounts.get((lang, n), 0.75)
                c = self.tables[lang, n, "gram"](gram.view(np.int64))[:, 0]
                total, kinds = self.tables[lang, n, "context"]((gram >> np.uint64(16)).view(np.int64)).T
                known = np.maximum(total, 1)
                p = np.where(total > 0, np.maximum(c - d, 0) / known + d * kinds / known * p, p)
            out[:, j] = -np.log2(np.maximum(p, 1e-12))
        return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows ``lang, gram, n`` over all of ``docs`` (``lang, text``), pre-aggregated in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        size = 0
        for b in batches:
            langs = b.column(0).to_pylist()
            for at, texts in by_size(b.column(1).to_pylist()):
                packed, inverse, text = grams(texts)
                names, own = np.unique(langs[at : at + len(texts)], return_inverse=True)
                of = own[text]
                for i, lang in enumerate(names.tolist()):
                    n = np.bincount(inverse[of == i], minlength=len(packed))
                    some = np.flatnonzero(n)
                    held.setdefault(lang, []).append((packed[some], n[some]))
                    size += len(some)
                if size > 3_000_000:
                    yield from merged()
                    size = 0
        yield from merged()

    found = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    """Models of every language in ``docs`` (``lang``, ``text``; rows with a null are left out), over all texts."""
    four = written(gram_counts(docs.filter("lang is not null and text is not null")), "grams")
    tables, levels, discounts = {}, four.select("lang", "gram", F.col("n").alias("c")), {}
    parts, ones = [], []
    for n in range(ORDER, 0, -1):
        level = levels
        parts.append(level.select("lang", "gram", F.col("c").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(2 * n).alias("kind")))
        parts.append(level.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("gram")).agg(F.sum("c").alias("a"), F.count("*").alias("b")).withColumn("kind", F.lit(2 * n + 1)))
        ones.append(level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count("*").alias("kinds")).withColumn("n", F.lit(n)))
        if n > 1:
            levels = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * (n - 1))) - 1)).alias("gram")).agg(F.count("*").alias("c"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    stats = ones[0]
    for o in ones[1:]:
        stats = stats.unionByName(o)
    alphabet = 1
    found = stats.collect()
    for r in found:
        discounts[r["lang"], r["n"]] = r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] else 0.5
        alphabet = max(alphabet, r["kinds"] + 1) if r["n"] == 1 else alphabet
    languages = sorted({r["lang"] for r in found})
    empty = SortedGrams(np.zeros(0, np.int64), np.zeros((0, 2), np.float32))
    if not languages:
        return Model(languages, tables, discounts, alphabet)
    # a number for each language, order and kind: what reaches the driver are numbers only, read as they lie in Arrow
    of = F.element_at(F.create_map(*(F.lit(x) for i, lang in enumerate(languages) for x in (lang, i * 16))), F.col("lang")) + F.col("kind")
    t = rows.select(of.alias("of"), "gram", F.col("a").cast("float").alias("a"), F.col("b").cast("float").alias("b")).toArrow()
    which, grams_, values = t["of"].to_numpy(), t["gram"].to_numpy(), np.stack([t["a"].to_numpy(), t["b"].to_numpy()], 1)
    order = np.lexsort((grams_, which))
    which, grams_, values = which[order], grams_[order], values[order]
    for i, lang in enumerate(languages):
        for n in range(1, ORDER + 1):
            for k, kind in enumerate(("gram", "context")):
                a, z = np.searchsorted(which, [i * 16 + 2 * n + k, i * 16 + 2 * n + k + 1])
                tables[lang, n, kind] = SortedGrams(grams_[a:z], values[a:z]) if z > a else empty
    return Model(languages, tables, discounts, alphabet)


def measure(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``letters``, ``best``, ``bits`` (cross-entropy per character) and ``margin`` to the next."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n = len(texts)
            letters, sums, sizes = np.zeros(n, np.int64), np.zeros((n, len(m.languages))), np.zeros(n)
            for at, some in by_size(texts):
                packed, inverse, text = grams(some)
                cost = m.bits_of(packed)
                own = slice(at, at + len(some))
                sizes[own] = np.bincount(text, minlength=len(some))
                letters[own] = np.bincount(text, weights=(packed & np.uint64(0xFFFF) != 0)[inverse], minlength=len(some))
                for j in range(len(m.languages)):
                    sums[own, j] = np.bincount(text, weights=cost[inverse, j], minlength=len(some))
            mean = sums / np.maximum(sizes, 1)[:, None]
            if m.languages:
                best = mean.argmin(1)
                low = np.sort(mean, 1)
                margin = low[:, 1] - low[:, 0] if low.shape[1] > 1 else np.ones(n)
                names, bits = [m.languages[i] for i in best], low[:, 0]
            else:
                names, bits, margin = [None] * n, np.zeros(n), np.zeros(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(letters), pa.array(names, pa.string()), pa.array(bits), pa.array(margin)], names=[*b.schema.names[:-1], "letters", "best", "bits", "margin"])

    return docs.select(*keep, F.col("text").alias("measured_text")).mapInArrow(score, ", ".join([*fields, "letters long", "best string", "bits double", "margin double"]))


def _bin(margin: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(margin * 20)).cast("int")


def calibrate(model: Model, docs: DataFrame, reject_sd: float = 4.0) -> Model:
    """Sets from labelled texts the share of right answers by margin (never falling) and each language's rejection bound."""
    seen = measure(docs.filter("lang is not null"), model, ["lang"]).filter("letters > 0")
    right = F.col("lang") == F.col("best")
    counts = {r["k"]: (r["n"], r["ok"]) for r in seen.groupBy(_bin(F.col("margin")).alias("k")).agg(F.count("*").alias("n"), F.count_if(right).alias("ok")).collect()}
    pools: list[list[float]] = []  # adjacent violators are pooled
    for k in range(BINS):
        n, ok = counts.get(k, (0, 0))
        prior = 0.5 + 0.5 * min(1, k / 10)
        pools.append([ok + prior * 2, n + 2, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    model.right = [float(a / b) for a, b, w in pools for _ in range(int(w))]
    for r in seen.filter(right).groupBy("lang").agg(F.avg("bits").alias("m"), F.coalesce(F.stddev("bits"), F.lit(0.0)).alias("sd")).collect():
        model.bound[r["lang"]] = r["m"] + reject_sd * max(r["sd"], 0.05)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``lang_pred``, ``score`` (calibrated, 0 to 1), ``bits`` and ``accepted``.

    ``und`` with score 0 for null texts, texts without a letter, and a model without languages. ``accepted``
    is false where the cross-entropy passes the best language's bound: likely another language.
    Equal texts get equal results whatever else the table holds.
    """
    found = measure(docs, model, keep)
    known = (F.col("letters") > 0) & F.col("best").isNotNull()
    right = F.array(*(F.lit(x) for x in model.right))
    bound = F.element_at(F.create_map(*(F.lit(x) for kv in model.bound.items() for x in kv)), F.col("best")) if model.bound else F.lit(None).cast("double")
    return found.select(
        *keep, F.when(known, F.col("best")).otherwise("und").alias("lang_pred"), F.when(known, F.element_at(right, _bin(F.col("margin")) + 1)).otherwise(0.0).alias("score"),
        F.when(known, F.col("bits")).alias("bits"), F.coalesce(known & (F.col("bits") <= bound), F.lit(False)).alias("accepted"),
    )


def trained(docs: DataFrame) -> Model:
    """A calibrated model from labelled rows: one in thirty, by id, calibrates; the others are counted."""
    return calibrate(fit(docs.filter(fold("doc_id", 30) != 3)), docs.filter(fold("doc_id", 30) == 3))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(docs.filter(fold("doc_id", 3) != 1))
    return identify(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "accepted")
