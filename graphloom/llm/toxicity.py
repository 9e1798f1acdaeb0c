"""A toxicity classifier that is regularised by counterfactuals.

Logistic regression over hashed words and word beginnings, which inflected forms share. For each labelled text that mentions a group, a copy with the
identity terms swapped for others of their kind is made; training penalises the change of score between
the two, so that the mention of a group says little by itself. Identity terms always have weights, whether they
are tied to the label or not, so that the penalty reaches them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, written

#: Terms of a row stand for groups of one kind; a swap takes the next term of the row.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("boys", "girls"),
    ("he", "she"), ("him", "her"), ("his", "hers"), ("father", "mother"), ("son", "daughter"), ("husband", "wife"),
    ("gay", "straight", "lesbian", "bisexual", "queer"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"),
    ("american", "mexican", "chinese", "indian", "french", "german", "spanish", "russian", "turkish"),
    ("immigrant", "native"), ("immigrants", "natives"), ("old", "young"), ("elderly", "youthful"), ("disabled", "able"), ("deaf", "hearing"), ("blind", "sighted"),
    ("er", "sie"), ("mann", "frau"), ("männer", "frauen"), ("vater", "mutter"), ("sohn", "tochter"), ("christen", "muslime", "juden"), ("schwarze", "weiße"), ("ausländer", "einheimische"),
    ("il", "elle"), ("ils", "elles"), ("homme", "femme"), ("hommes", "femmes"), ("père", "mère"), ("fils", "fille"), ("chrétiens", "musulmans", "juifs"), ("noirs", "blancs"), ("étrangers", "français"),
    ("él", "ella"), ("ellos", "ellas"), ("hombre", "mujer"), ("hombres", "mujeres"), ("padre", "madre"), ("hijo", "hija"), ("cristianos", "musulmanes", "judíos"), ("negros", "blancos"), ("extranjeros", "nativos"),
)
SWAP = {a.encode(): row[(i + 1) % len(row)].encode() for row in IDENTITY_TERMS for i, a in enumerate(row)}
#: ASCII characters that aren't letters or digits become spaces.
_BREAKS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split())


_SLOTS: dict[int, dict[bytes, tuple[int, ...]]] = {}


def slots_of(words: set[bytes], bits: int) -> set[int]:
    """Slots of the words and of their first four and five bytes, each once."""
    known, out, mask = _SLOTS.setdefault(bits, {}), set(), (1 << bits) - 1
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if (own := known.get(w)) is None:
            own = known[w] = tuple(zlib.crc32(x) & mask for x in {w, *(w[:n] + b"*" for n in (4, 5) if len(w) > n)})
        out.update(own)
    return out


def swapped_words(words: set[bytes]) -> set[bytes]:
    return {SWAP.get(x, x) for x in words}


def identity_slots(bits: int) -> np.ndarray:
    return hashed({*SWAP, *SWAP.values()}, bits)


def hashed(words: set[bytes], bits: int) -> np.ndarray:
    return np.array(sorted(slots_of(words, bits)), np.int32)


LEAST = 15.0  # chi-square from which a slot is tied to the label


@dataclass
class Classifier:
    bits: int
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        heavy = dict(zip((at := np.flatnonzero(self.weights)).tolist(), self.weights[at].tolist(), strict=True))
        told = heavy.keys()
        z = np.array([sum(sorted(heavy[i] for i in told & slots_of(words_of(t), self.bits))) for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -40, 40)))


def _sums(w: np.ndarray, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=w[at], minlength=n)


def telling(rows: list[np.ndarray], y: np.ndarray, dim: int, least: float) -> np.ndarray:
    """True for the slots whose presence is tied to the label by a chi-square of at least ``least``."""
    n, pos = len(y), y.sum()
    df = np.bincount(np.concatenate(rows), minlength=dim).astype(np.float64)
    both = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=dim)
    apart = both * n - df * pos
    return n * apart**2 >= least * np.maximum(df * (n - df) * pos * (n - pos), 1e-9)


def fit_rows(rows: list[np.ndarray], swapped: list[np.ndarray | None], y: np.ndarray, *, bits: int = 18, l2: float = 1e-4, fairness: float = 4.0, rounds: int = 300, rate: float = 0.05, least: float = LEAST) -> Classifier:
    """Weights by Adam on cross-entropy + fairness * mean (z - z')**2 over texts with a counterfactual + l2.

    Words that are neither identity terms nor tied to the label (chi-square of at least ``least``) get no weight, so the
    many rare words of a long text can't add up to a score. Classes weigh alike up to a factor of 4. No rows, or one class
    only, give the base rate.
    """
    n, dim = len(y), 1 << bits
    base = (y.sum() + 0.5) / (n + 1)
    model = Classifier(bits, np.zeros(dim), float(np.log(base / (1 - base))))
    if n == 0 or y.min() == y.max():
        return model
    used_words = telling(rows, y, dim, least)
    if not used_words.any():
        return model
    used_words[identity_slots(bits)] = True
    rows = [r[used_words[r]] for r in rows]
    swapped = [None if s is None else s[used_words[s]] for s in swapped]
    own = np.flatnonzero([s is not None for s in swapped])
    at, row = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    used, at = np.unique(at, return_inverse=True)
    if len(own):
        # only what the two texts don't share changes the score
        gone = [np.setdiff1d(rows[i], swapped[i]) for i in own]
        come = [np.setdiff1d(swapped[i], rows[i]) for i in own]
        cf_at = np.concatenate([*gone, *come])
        used_all, inverse = np.unique(np.concatenate([used, cf_at]), return_inverse=True)
        at, cf_at, used = inverse[: len(used)][at], inverse[len(used) :], used_all
        cf_row = np.repeat(np.tile(np.arange(len(own)), 2), [len(x) for x in gone + come])
        sign = np.repeat([1.0, -1.0], [sum(map(len, gone)), sum(map(len, come))])
    pos = min(4.0, (n - y.sum()) / y.sum())
    weight = np.where(y == 1, pos, 1.0)
    weight /= weight.sum()
    w, b = np.zeros(len(used)), model.bias
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(_sums(w, at, row, n) + b, -40, 40)))
        r = (p - y) * weight
        g = np.bincount(at, weights=r[row], minlength=len(used)) + l2 * w
        if len(own):
            change = np.bincount(cf_row, weights=sign * w[cf_at], minlength=len(own))
            g += np.bincount(cf_at, weights=2 * fairness / len(own) * sign * change[cf_row], minlength=len(used))
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    model.weights[used] = w
    model.bias = float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, bits: int = 18, fairness: float = 4.0) -> Classifier:
    """Fits on labelled documents: at most ``max_rows`` of them, those with the smallest hash of their id.

    ``max_rows`` is the documented bound of the sample, which makes the broadcast bounded too. Which slots are
    tied to the label is counted in Spark, and only these and identity slots come to the driver. Documents with a
    null label or id take no part; of several labels the highest counts; of several texts under an id each is a row.
    """
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own, other, c = [], [], b.slice(at, 256)
                for text in c.column(2):
                    words = words_of(text.as_py())
                    own.append(hashed(words, bits))
                    other.append(hashed(swapped_words(words), bits) if not words.isdisjoint(SWAP) else None)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(own, kind), pa.array(other, kind)], names=["doc_id", "y", "own", "other"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text")
    rows = written(rows.mapInArrow(features, "doc_id long, y int, own array<int>, other array<int>"), "features")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    df, both = F.count("*"), F.sum("y")
    apart = both * n - df * pos
    tied = n * apart * apart.cast("double") >= LEAST * F.greatest((df * (n - df)).cast("double") * float(pos * (n - pos)), F.lit(1e-9))
    slots = rows.select("y", F.explode("own").alias("slot")).groupBy("slot").agg(tied.alias("tied")).filter("tied").select("slot").toArrow()["slot"].to_numpy()
    used = np.union1d(slots, identity_slots(bits)).astype(np.int32)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [pa.array([None if not x.is_valid else np.intersect1d(x.values.to_numpy(), used) for x in b.column(i)], pa.list_(pa.int32())) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *kept], names=["doc_id", "y", "own", "other"])

    t = rows.mapInArrow(told, "doc_id long, y int, own array<int>, other array<int>").toArrow()
    t = t.take(pa.array(sorted(range(t.num_rows), key=lambda i, d=t["doc_id"].to_pylist(), o=t["own"].to_pylist(): (d[i], o[i]))))  # the same fit wherever rows come from
    lists = lambda c: [x.values.to_numpy() if x.is_valid else None for x in t[c]]
    return fit_rows(lists("own"), lists("other"), t["y"].to_numpy().astype(np.float64), bits=bits, fairness=fairness)


def score(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``, 0 to 1, for every row; null and empty texts get the bias alone.

    Equal texts score alike, rows that repeat stay, an empty table gives no rows, and a kept column named ``score`` is replaced.
    """
    keep = [c for c in keep if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.scores(b.column(b.num_columns - 1).slice(at, 256).to_pylist()) for at in range(0, b.num_rows, 256)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(found or [np.zeros(0)]))], names=[*b.schema.names[:-1], "score"])

    return docs.select(*keep, F.col("text").alias("scored_text")).mapInArrow(scored, ", ".join([*fields, "score double"]))


def clean_documents(docs: DataFrame, model: Classifier, threshold: float = 0.7) -> DataFrame:
    """The documents that score under ``threshold``; all columns stay, rows that repeat stay."""
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("row"), "text")
    return score(rows, model, ["row"]).filter(F.col("score") < threshold).select(*(F.col("row")[c].alias(c) for c in columns))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole table; labels are learnt from the rows outside the held-out fold."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(fold("doc_id", 3) != 1))
    found = score(docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
