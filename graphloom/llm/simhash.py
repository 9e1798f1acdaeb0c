"""SimHash near-duplicates found with a generalised pigeonhole index.

Fingerprints are 64-bit SimHashes of word shingles. Two link when they differ in at most ``radius`` bits.
The index groups correlated bits into ``m`` partitions; any pair within the radius agrees to within
T[i] bits in some partition i whenever the thresholds sum to ``radius - m + 1``. Each fingerprint gets
the thresholds of its own that a dynamic program finds cheapest, from candidate counts estimated on
histograms of the whole table, then probes the values within T[i] flips of its own and verifies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_present, presence, text_key, written
from .components import _forest, connected_components, contracted

BLOCK = 8  # bits of a sub-block, whose values have a histogram of 256 counts


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of the whole where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, n = ends - lengths, max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


LANES = np.array([sum(1 << 8 * b for b in range(8) if v >> b & 1) for v in range(256)], np.uint64)  # a byte's bits, one to a byte
AT_ONCE = 200_000  # shingles whose bits are summed at once


def _set_bits(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes (from a start to the next) how many have each of the 64 bits set."""
    ends = np.append(starts[1:], len(h))
    blocks = -(-(ends - starts) // 255)  # a lane counts to 255
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    lanes = np.add.reduceat(LANES[np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)], at, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).astype(np.int64).reshape(-1, 64), first, axis=0)


def majorities(hashes: list[np.ndarray], families: int = 1) -> np.ndarray:
    """Unsigned 64-bit SimHashes, texts x families: a bit is 1 if set in over half of a text's hashes; none: 0."""
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), families), np.uint64)
    some = np.flatnonzero(n)
    for own in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // AT_ONCE)) + 1):
        if not own.size:
            continue
        h = np.concatenate([hashes[i] for i in own])
        edges = np.cumsum(n[own])
        for k in range(families):
            counts = np.zeros((len(own), 64), np.int64)
            for at in range(0, len(h), AT_ONCE):  # a very long text takes several rounds
                lo, hi = np.searchsorted(edges, [at, min(at + AT_ONCE, len(h)) - 1], side="right")
                inside = np.concatenate([[0], edges[lo:hi] - at])
                counts[lo : hi + 1] += _set_bits(_again(h[at : at + AT_ONCE], k), inside)
            out[own, k] = np.packbits((2 * counts > n[own, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _again(h: np.ndarray, family: int) -> np.ndarray:
    """Hashes of another family, mixed from the first."""
    if not family:
        return h
    h = h ^ np.uint64(family * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def simhash(text: Column, size: int = 5, seed: int = 42, families: int = 1, distinct: bool = False) -> Column:
    """Struct of ``n`` (shingles) and ``fps``, a signed long for each family with the fingerprint's 64 bits. Both take each shingle once if ``distinct``.

    Null and blank texts have no shingles and fingerprint 0 in every family.
    """

    @F.pandas_udf("n long, fps array<long>")
    def fingerprints(texts: pd.Series) -> pd.DataFrame:
        h = [shingle_hashes(t, size, seed) for t in texts]
        h = [np.unique(x) for x in h] if distinct else h
        return pd.DataFrame({"n": [len(x) for x in h], "fps": list(majorities(h, families).view(np.int64))})

    return fingerprints(text)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def tally(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray], None], cells: int) -> np.ndarray:
    """Sums over all fingerprints (``fps``): each task lets ``add`` put its batches into a vector of ``cells`` and sends that."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for b in batches:
            if b.num_rows:
                add(total, b.column(0).flatten().to_numpy().reshape(b.num_rows, -1))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    t = rows.select("fps").mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells)
    out[t["cell"].to_numpy()] = t["n"].to_numpy()
    return out


def bit_counts(rows: DataFrame, families: int) -> np.ndarray:
    """For each family 64 x 64 counts of bits set together."""

    def add(total: np.ndarray, fps: np.ndarray) -> None:
        for k in range(families):
            x = _bits(fps[:, k]).astype(np.float32)
            total[4096 * k : 4096 * (k + 1)] += (x.T @ x).ravel()

    return tally(rows, add, families * 4096).reshape(families, 64, 64)


def group_bits(together: np.ndarray, n: int, m: int, width: int | None = None) -> list[list[int]]:
    """Partitions of ``width`` bits (64/m by default): each starts from the free bit tied most to others and takes in the most correlated."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(64)), []
    for i in range(m):
        size = width or 64 // m + (i < 64 % m)
        order = sorted(free)
        own = [max(order, key=lambda b: (tie[b, order].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            b = max(sorted(free), key=lambda x: (tie[x, own].sum(), -x))
            own.append(b)
            free.remove(b)
        groups.append(sorted(own))
    return groups


def project(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The partition's bits, packed from bit 0 up."""
    v, out = values.view(np.uint64), np.zeros(len(values), np.uint64)
    for to, b in enumerate(bits):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(to)
    return out


def _sub_blocks(width: int) -> list[tuple[int, int]]:
    return [(at, min(BLOCK, width - at)) for at in range(0, width, BLOCK)]


def histograms(rows: DataFrame, groups: list[list[list[int]]]) -> list[list[list[np.ndarray]]]:
    """For each family, partition and sub-block the count of every value, over all fingerprints."""
    blocks = [(f, bits, at, w) for f, parts in enumerate(groups) for bits in parts for at, w in _sub_blocks(len(bits))]
    edges = np.cumsum([0] + [1 << w for *_, w in blocks]).tolist()

    def add(total: np.ndarray, fps: np.ndarray) -> None:
        for (f, bits, at, w), lo in zip(blocks, edges, strict=False):
            total[lo : lo + (1 << w)] += np.bincount(project(fps[:, f], bits[at : at + w]).astype(np.int64), minlength=1 << w)

    found = iter(np.split(tally(rows, add, edges[-1]), edges[1:-1]))
    return [[[next(found) for _ in _sub_blocks(len(bits))] for bits in parts] for parts in groups]


def distance_tables(hist: list[list[np.ndarray]], radius: int) -> list[list[np.ndarray]]:
    """For each sub-block: row v has the shares of fingerprints at 0..radius differing bits from v."""
    out = []
    for blocks in hist:
        own = []
        for n in blocks:
            size, share = len(n), n / max(n.sum(), 1)
            apart = np.bitwise_count(np.arange(size)[:, None] ^ np.arange(size)[None, :])
            own.append(np.stack([(share[None, :] * (apart == d)).sum(1) for d in range(radius + 1)], 1))
        out.append(own)
    return out


def allocate(values: list[np.ndarray], tables: list[list[np.ndarray]], widths: list[int], n: int, radius: int, check_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (rows x partitions, -1: not probed), by dynamic programming on the estimated cost of each choice, and these costs."""
    rows, m = len(values[0]), len(widths)
    cost = np.zeros((m, radius + 2, rows))
    for i, (x, blocks) in enumerate(zip(values, tables, strict=True)):
        dist = np.zeros((rows, radius + 1))
        dist[:, 0] = 1
        for (at, w), t in zip(_sub_blocks(widths[i]), blocks, strict=True):
            d = t[((x >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64)]
            dist = np.stack([sum(dist[:, j] * d[:, e - j] for j in range(e + 1)) for e in range(radius + 1)], 1)
        within = np.cumsum(dist, 1) * n
        for e in range(radius + 1):
            cost[i, e + 1] = len(flips(widths[i], e)) + check_cost * within[:, e]
    # best[s]: least cost with thresholds + 1 of the partitions so far summing to s; they must reach radius + 1
    need = radius + 1
    best = np.full((need + 1, rows), np.inf)
    best[0] = 0
    choice = np.zeros((m, need + 1, rows), np.int64)
    for i in range(m):
        after = np.full((need + 1, rows), np.inf)
        for s in range(need + 1):
            for t in range(min(s, radius + 1) + 1):
                c = best[s - t] + cost[i, t]
                better = c < after[s]
                after[s][better] = c[better]
                choice[i, s][better] = t
        best = after
    left, out = np.full(rows, need), np.zeros((rows, m), np.int64)
    for i in reversed(range(m)):
        t = choice[i, left, np.arange(rows)]
        out[:, i] = t - 1
        left = left - t
    return out, best[need]


_FLIPS: dict[tuple[int, int], np.ndarray] = {}


def flips(width: int, e: int) -> np.ndarray:
    """Masks of at most e of the partition's bits."""
    if (width, e) not in _FLIPS:
        _FLIPS[width, e] = np.array([sum(1 << b for b in c) for k in range(e + 1) for c in combinations(range(width), k)], np.uint64)
    return _FLIPS[width, e]


@dataclass
class Index:
    """What a pigeonhole index of one family's fingerprints is built on; its size doesn't depend on the table's."""

    n_rows: int
    groups: list[list[int]]
    tables: list[list[np.ndarray]]

    def allowed(self, values: np.ndarray, radius: int, check_cost: float) -> tuple[list[np.ndarray], np.ndarray]:
        """The values' partitions, and the threshold of each."""
        parts = [project(values, bits) for bits in self.groups]
        return parts, allocate(parts, self.tables, [len(g) for g in self.groups], self.n_rows, radius, check_cost)[0]

    def cost(self, values: np.ndarray, radius: int, check_cost: float) -> float:
        """Probes and candidates, weighed, that a fingerprint is estimated to need."""
        parts = [project(values, bits) for bits in self.groups]
        return float(allocate(parts, self.tables, [len(g) for g in self.groups], self.n_rows, radius, check_cost)[1].mean())


def plan_index(rows: DataFrame, radius: int, partitions: int, width: int | None = None, families: int = 1) -> list[Index]:
    """An index for each family of ``fps``: two passes over the table, which send vectors of a set length to the driver."""
    n_rows = rows.count()
    rows = rows.coalesce(-(-n_rows // 50_000) or 1)
    groups = [group_bits(x, n_rows, partitions, width) for x in bit_counts(rows, families)]
    return [Index(n_rows, g, distance_tables(h, radius)) for g, h in zip(groups, histograms(rows, groups), strict=True)]


def plan_cheapest(rows: DataFrame, radius: int, check_cost: float, sample: int = 4096) -> Index:
    """The index whose number of partitions costs least for a table of this size.

    Fewer partitions are wider: their buckets are emptier, but thresholds higher and probes many. With one more than
    the radius all thresholds would be 0 and buckets as narrow as they get, which only suits small tables, so at most
    ``radius`` are tried (two at least where the radius allows). Statistics are those of all
    rows, the same two passes for every choice; costs are estimated for up to ``sample`` fingerprints chosen by hash.
    """
    n_rows, value = rows.count(), F.get("fps", F.lit(0))
    choices = list(range(min(2, radius + 1), min(max(2, radius), radius + 1, 15) + 1))
    few = rows.coalesce(-(-n_rows // 50_000) or 1).select(F.array_repeat(value, len(choices)).alias("fps"))
    [together] = bit_counts(few, 1)
    groups = [group_bits(together, n_rows, m) for m in choices]
    indexes = [Index(n_rows, g, distance_tables(h, radius)) for g, h in zip(groups, histograms(few, groups), strict=True)]
    share = min(1 << 20, (sample << 21) // max(1, n_rows))
    some = rows.select(value.alias("fp")).filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share).orderBy("fp").limit(sample).toArrow()["fp"].to_numpy()
    return min(indexes, key=lambda x: x.cost(some, radius, check_cost)) if len(some) else indexes[0]


def bucket_keys(part: int, v: np.ndarray) -> np.ndarray:
    """The partition's value, mixed with its number."""
    return _again(v ^ (np.uint64(part + 1) << np.uint64(40)), 1).view(np.int64)


def hamming_links(rows: DataFrame, radius: int = 3, partitions: int | None = None, check_cost: float = 0.02) -> DataFrame:
    """Every pair of ids ``a < b`` whose fingerprints differ in at most ``radius`` bits, once.

    ``rows`` has ``id`` (each once) and ``fps``, of which the first counts. A pair is found from its member
    with the smaller id, whose probes cover everything within the radius. The number of partitions is the cheapest
    for the table's size unless it is given; equal keys meet
    in an equi-join, whose hot keys Spark splits at run time. A pair that several partitions match is listed
    by the first.
    """
    if not 0 <= radius < 64 or not (partitions is None or 1 <= partitions <= radius + 1):
        raise ValueError("needs 0 <= radius < 64 and 1 <= partitions <= radius + 1")
    index = plan_cheapest(rows, radius, check_cost) if partitions is None else plan_index(rows, radius, partitions)[0]
    groups, partitions = index.groups, len(index.groups)
    widths = [len(g) for g in groups]
    masks = [sum(1 << b for b in g) for g in groups]

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2048):
                c = b.iloc[at : at + 2048]
                own, ids = c["fp"].to_numpy(), c["id"].to_numpy()
                parts, allowed = index.allowed(own, radius, check_cost)
                # what the pairs of earlier partitions are told by: four bits for each threshold + 1
                told = sum((allowed[:, i] + 1) << (4 * i) for i in range(partitions))
                for i, w in enumerate(widths):
                    for e in range(radius + 1):
                        at_e = np.flatnonzero(allowed[:, i] == e)
                        flip = flips(w, e) if at_e.size else np.zeros(0, np.uint64)
                        for to in range(0, at_e.size, step := max(1, 200_000 // max(1, len(flip)))):
                            some = at_e[to : to + step]
                            each = np.repeat(some, len(flip))
                            yield pd.DataFrame({"key": bucket_keys(i, (parts[i][some][:, None] ^ flip[None, :]).ravel()), "id": ids[each], "fp": own[each], "part": np.int8(i), "told": told[each]})

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = b["fp"].to_numpy()
            for i, bits in enumerate(groups):
                yield pd.DataFrame({"key": bucket_keys(i, project(v, bits)), "id": b["id"], "fp": v})

    own = rows.select("id", F.get("fps", F.lit(0)).alias("fp"))
    left = own.mapInPandas(probes, "key long, id long, fp long, part byte, told long").alias("p")
    right = own.mapInPandas(buckets, "key long, id long, fp long").alias("i")
    apart = F.col("p.fp").bitwiseXOR(F.col("i.fp"))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    near = (F.col("p.key") == F.col("i.key")) & (F.col("p.id") < F.col("i.id")) & (F.bit_count(apart) <= radius)
    for j in range(partitions):
        outside = F.bit_count(apart.bitwiseAND(F.lit(signed(masks[j])))) >= F.shiftright("p.told", 4 * j).bitwiseAND(F.lit(15))
        inside = F.bit_count(apart.bitwiseAND(F.lit(signed(masks[j])))) < F.shiftright("p.told", 4 * j).bitwiseAND(F.lit(15))
        near &= ((F.col("p.part") <= j) | outside) & ((F.col("p.part") != j) | inside)
    return left.join(right, near).select(F.col("p.id").alias("a"), F.col("i.id").alias("b"))


SMALL = 8  # members of a bucket whose pairs are listed in the join; larger buckets are verified in blocks
BLOCK_ROWS = 256  # members of a block; larger buckets are joined by stars first
APART = 16  # bits of 62 in which marks of a pair may differ: at the similarity of 0.8 a pair passes in 99 % of its buckets
PRESENT = 23  # log2 of the bits that say which texts are wanted


def width_for(rows: int) -> int:
    """Bits of a partition: enough that a bucket holds few texts that only chance brings together."""
    return min(64, max(17, int(np.ceil(np.log2(max(rows, 2)))) - 1))


def families_for(similarity: float, partitions: int, width: int, recall: float) -> int:
    """How many families find pairs of that similarity with that probability, by a partition that is equal in both.

    Of two sets of equal size with Jaccard similarity s, fingerprints differ in a bit with probability
    acos(2s / (1 + s)) / pi. Sets of unequal sizes are nearer.
    """
    equal = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** width
    return max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-equal) / partitions))) if equal < 1 else 1


def keyed(rows: DataFrame, index: list[Index], radius: int, check_cost: float) -> DataFrame:
    """``key, id, mark`` for every partition of every family of ``rows`` (``id, fps``), and for each probe besides.

    ``mark`` is the next family's fingerprint; its lowest bit says that the row probes, the next that it is
    in the index. A partition with a threshold of 0 is one row for both.
    """
    m, families = len(index[0].groups), len(index)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                ids, fps = some.column(0).to_numpy(), some.column(1).flatten().to_numpy().reshape(some.num_rows, families)
                keys, who, marks = [], [], []
                for f, own in enumerate(index):
                    parts, allowed = own.allowed(np.ascontiguousarray(fps[:, f]), radius, check_cost)
                    mark = fps[:, (f + 1) % families] & ~np.int64(3)
                    for i, v in enumerate(parts):
                        keys.append(bucket_keys(m * f + i, v))
                        who.append(ids)
                        marks.append(mark | 2 | (allowed[:, i] >= 0))
                        for e in range(1, radius + 1):
                            at_e = np.flatnonzero(allowed[:, i] == e)
                            if at_e.size:
                                flip = flips(len(own.groups[i]), e)[1:]
                                each = np.repeat(at_e, len(flip))
                                keys.append(bucket_keys(m * f + i, (v[at_e][:, None] ^ flip[None, :]).ravel()))
                                who.append(ids[each])
                                marks.append(mark[each] | 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, who, marks)], names=["key", "id", "mark"])

    return rows.select("id", "fps").mapInArrow(emit, "key long, id long, mark long")


def small_pairs(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of a bucket that isn't in ``hot``, found from the smaller id's probes, whose marks are near."""
    few = keys.join(hot.select("key"), "key", "left_anti")
    p, i = few.alias("p"), few.alias("i")
    near = F.bit_count(F.shiftright(F.col("p.mark").bitwiseXOR(F.col("i.mark")), 2)) <= APART
    # both flags in one expression, so that the two sides are read alike and dealt out once
    flags = F.col("p.mark").bitwiseAND(F.shiftright("i.mark", 1)).bitwiseAND(F.lit(1)) != 0
    met = p.join(i, (F.col("p.key") == F.col("i.key")) & (F.col("p.id") < F.col("i.id")) & flags & near)
    return met.select(F.col("p.id").alias("a"), F.col("i.id").alias("b")).distinct()


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs of each member of a bucket (``key, id, mark``) with a chosen one, that nearest to the bucket's majority mark,
    which stands for the text that the others were made from.

    A group of thousands of near copies fills its buckets, so these few links join nearly all of it. Rows
    grow with the table, not with the square of a group; the chosen are minima, pre-aggregated.
    """
    bit = lambda b: F.shiftright("mark", b).bitwiseAND(F.lit(1))
    sums = members.groupBy("key").agg(F.count("*").alias("held"), *(F.sum(bit(b)).alias(f"b{b}") for b in range(2, 64)))
    middle = sums.select("key", reduce(Column.bitwiseOR, [F.when(2 * F.col(f"b{b}") > F.col("held"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(2, 64)]).alias("middle"))
    far = F.bit_count(F.shiftright(F.col("mark").bitwiseXOR(F.col("middle")), 2))
    chosen = members.join(middle, "key").groupBy("key").agg(F.min(F.struct(far.alias("far"), F.xxhash64("id").alias("by"), "id")).alias("near"))
    met = members.join(chosen, "key").select("id", F.col("near.id").alias("centre")).filter("id <> centre")
    return met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int, seed: int) -> DataFrame:
    """``id, s``: the sorted shingle hashes of the texts whose key is among ``ids``.

    ``2**PRESENT`` bits of the ids' hashes, a set size, go to the tasks, so that most other texts stay where they are
    read; what chance lets through leaves in the join.
    """
    ids = ids.distinct()
    shared = docs.sparkSession.sparkContext.broadcast(presence(ids, "id", PRESENT))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(maybe_present(shared.value, b.column(0).to_numpy()))
            for at in range(0, len(some), 256):
                c = b.take(pa.array(some[at : at + 256]))
                s = [np.unique(shingle_hashes(t.as_py(), size, seed)).view(np.int64) for t in c.column(1)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(s, pa.list_(pa.int64()))], names=["id", "s"])

    found = docs.select(text_key("text").alias("id"), "text").mapInArrow(sets, "id long, s array<long>")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"])


def jaccard_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of at least ``similarity``."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "y"}), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.filter(same >= F.lit(similarity) * (F.size("x") + F.size("y") - same)).select("a", "b")


def overlaps(probes: list[np.ndarray], targets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each probe how many values it shares with each target; all hold distinct values."""
    owner = np.repeat(np.arange(len(targets)), [len(t) for t in targets])
    values = np.concatenate(targets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    for p in probes:
        lo, hi = np.searchsorted(values, p), np.searchsorted(values, p, side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield np.bincount(owner[at], minlength=len(targets))


CELL = "struct<t:int,p:int>"


def dealt(members: DataFrame) -> DataFrame:
    """Members of large buckets (``key, id, comp``) once for each block in which they are a target or a probe.

    A bucket's largest component needs no pairs within itself: the other members are probes, which meet
    everyone. Probes and members are dealt in blocks of about ``BLOCK_ROWS``.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    per = parts.groupBy("key").agg(F.max_by("comp", "n").alias("big"), F.sum("n").alias("held"), F.max("n").alias("most")).filter("held > most")
    per = per.select("key", "big", blocks(F.col("held")).alias("nt"), blocks(F.col("held") - F.col("most")).alias("np"))
    of = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    own = members.join(per, "key").withColumns({"own_t": of("nt", 1), "own_p": of("np", 2)})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda t, p: F.struct(t.alias("t"), p.alias("p"))
    # as a target a member meets each block of probes, and as a probe each block of targets
    as_target = F.transform(every("np"), lambda p: cell(F.col("own_t"), p))
    as_probe = F.when(F.col("comp") != F.col("big"), F.transform(every("nt"), lambda t: cell(t, F.col("own_p")))).otherwise(F.array().cast(f"array<{CELL}>"))
    cells = own.select("*", F.explode(F.array_union(as_target, as_probe)).alias("cell")).select("*", "cell.*")
    return cells.select("key", "id", "comp", "t", "p", ((F.col("comp") != F.col("big")) & (F.col("p") == F.col("own_p"))).alias("probe"), (F.col("t") == F.col("own_t")).alias("target"))


def block_links(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that join what a bucket's blocks (``key, t, p``) hold apart, by the members' sets.

    A task compares one block of probes with one of targets and returns a forest of what is similar, so neither a
    group nor a list of its pairs is ever held whole.
    """

    def verify(t: pa.Table) -> pa.Table:
        ids, comp, probe, target = (t[c].to_numpy() for c in ("id", "comp", "probe", "target"))
        s = t["s"].combine_chunks()
        flat, edge = s.flatten().to_numpy(), s.offsets.to_numpy() - s.offsets[0].as_py()
        own = [flat[edge[i] : edge[i + 1]] for i in range(len(ids))]
        a, b = np.flatnonzero(probe), np.flatnonzero(target)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if a.size and b.size:
            sizes = np.array([len(own[j]) for j in b])
            for i, same in zip(a, overlaps([own[i] for i in a], [own[j] for j in b]), strict=True):
                hit = b[(same >= similarity * (len(own[i]) + sizes - same)) & (comp[b] != comp[i])]
                u.append(np.full(len(hit), ids[i]))
                v.append(ids[hit])
        x, y = _forest(np.concatenate(u), np.concatenate(v))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return blocks.join(sets, "id").groupBy("key", "t", "p").applyInArrow(verify, "a long, b long").distinct()


def similar_links(docs: DataFrame, classes: DataFrame, index: list[Index], size: int, seed: int, similarity: float, radius: int, check_cost: float) -> DataFrame:
    """Links ``a, b`` (text keys) that join what a Jaccard similarity of ``similarity`` joins; ``classes`` has ``id, fps``.

    Texts that share a key are candidates. In buckets of up to ``SMALL`` rows every pair with near marks is
    verified; larger ones are verified in a block each, and those of over ``BLOCK_ROWS`` are joined by stars first
    and then verified in several blocks.
    """
    keys = written(keyed(classes, index, radius, check_cost), "keys")
    hot = written(keys.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > SMALL), "hot-keys")
    few = written(small_pairs(keys, hot), "pairs")
    members = written(keys.join(hot, "key").select("key", "id", "mark", "held").distinct(), "members")
    modest, large = members.filter(F.col("held") <= BLOCK_ROWS), members.filter(F.col("held") > BLOCK_ROWS)
    stars = written(star_pairs(large), "stars")
    ids = few.select(F.col("a").alias("id")).union(few.select("b")).union(members.select("id"))
    sets = written(shingle_sets(docs, ids, size, seed), "shingles")
    found = written(jaccard_links(few.union(stars), sets, similarity), "links")
    known = written(connected_components(found, "a", "b"), "joined").withColumnsRenamed({"node": "id", "root": "comp"})
    apart = large.select("key", "id").join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    zero, yes = F.lit(0).alias("t"), F.lit(True)
    blocks = modest.select("key", "id", F.col("id").alias("comp"), zero, F.lit(0).alias("p"), yes.alias("probe"), yes.alias("target"))
    return found.union(written(block_links(blocks.union(dealt(apart)), sets, similarity), "block-links"))


def near_duplicates(docs: DataFrame, *, size: int = 5, seed: int = 42, similarity: float | None = 0.8, recall: float = 0.997, radius: int = 3, partitions: int | None = None) -> DataFrame:
    """Rows ``doc_id, text_key, fp, component_id, keep`` for every document.

    With ``similarity=None`` texts link if their fingerprints differ in at most ``radius`` bits, and every such
    link is found, by as many ``partitions`` as are estimated to cost least if none are given. With a ``similarity`` they link if their shingle sets have that Jaccard similarity: families
    of fingerprints give candidates, as many as find a pair at exactly that similarity with probability
    ``recall``; each family's thresholds cover one bit less than it has partitions, whose width follows
    from the number of texts. Verification is exact, so nothing false links.

    ``component_id`` is the smallest doc_id in the class, ``keep`` true for the member with the smallest
    (doc_id, text_key). Null and blank texts have fingerprint 0; they link like others. Null doc_ids come
    last and get a null component_id only where the class has no other; rows equal in doc_id and text come
    out alike; an empty table gives no rows. Other columns of ``docs`` don't matter. Copies are pre-aggregated,
    so a hot group of them costs one row in the link search; a hot group of near copies is joined by stars first.
    """
    width = families = None
    if similarity:
        # the similarity is one of sets, so fingerprints are those of sets
        width = width_for(docs.count())
        partitions = 64 // width
        radius, families = partitions - 1, families_for(similarity, partitions, width, recall)
    sketch = simhash(F.col("text"), size, seed, families or 1, distinct=bool(similarity))
    own = written(docs.select("doc_id", text_key("text").alias("text_key"), sketch.alias("s")).select("doc_id", "text_key", "s.*"), "fingerprints")
    own = own.withColumn("fp", F.get("fps", F.lit(0))).withColumn("id", F.col("text_key") if similarity else F.col("fp"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))
    classes = written(own.groupBy("id").agg(F.min(order).alias("first"), F.first("fps").alias("fps")), "classes")
    if similarity:
        links = similar_links(docs, classes, plan_index(classes, radius, partitions, width, families), size, seed, similarity, radius, check_cost=0.005)
    else:  # each pair is a link: what a task finds is contracted before it is written
        links = written(contracted(hamming_links(classes, radius, partitions)), "links")
    roots = connected_components(links.toDF("a", "b"), "a", "b")
    rooted = classes.drop("fps").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("root", "id"))
    least = rooted.groupBy("component").agg(F.min("first").alias("least"))
    known = rooted.select("id", "component").join(least, "component")
    return own.drop("fps").join(known, "id").select(
        "doc_id", "text_key", "fp", F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))).alias("keep"),
    )


def keep_one_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one kept of each near-duplicate class: that with the smallest (doc_id, text).

    Rows that repeat the kept one in id and text stay.
    """
    kept = near_duplicates(docs, **settings).filter("keep").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["k_id"]) & (text_key(docs["text"]) == kept["k_text"]), "left_semi")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Classes of all documents by fingerprints of three-word shingles within three bits; nulls, empties and repeats as ``near_duplicates`` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, size=3, seed=42, radius=3, similarity=None)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
