"""Ordered sets in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_union(a: Column, b: Column) -> Column:
    """First-seen order, no repeats, no empty strings."""
    full = lambda x: F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.array_union(full(a), full(b))


def capped(ids: Column, n: int, method: str = "FIFO") -> Column:
    """FIFO keeps the last n, KEEP the first n; n <= 0 keeps none."""
    if n <= 0:
        return F.array().cast("array<string>")
    return F.slice(ids, 1, n) if method == "KEEP" else F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def subtract(ids: Column, gone: Column) -> Column:
    """Order and repeats stay, blank ids go."""
    return F.filter(ids, lambda v: v.isNotNull() & (v != "") & ~F.array_contains(gone, v))


def incremental(existing: Column, old: Column, new: Column) -> Column:
    """existing without (old - new), then (new - old) in new's order."""
    return F.array_union(subtract(existing, F.array_except(old, new)), subtract(new, old))


def non_empty_subsets(items: Column) -> Column:
    """All non-empty subsets of an array, smaller ones first, then by the items' order."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size(items)) - 1).cast("int"))
    sets = F.transform(masks, lambda m: F.filter(items, lambda _, i: F.getbit(m.cast("long"), i) == 1))
    return F.array_sort(sets, lambda a, b: F.when(F.size(a) != F.size(b), F.size(a) - F.size(b)).otherwise(F.when(F.array_position(items, a[0]) < F.array_position(items, b[0]), -1).when(F.array_position(items, a[0]) > F.array_position(items, b[0]), 1).otherwise(0)))
