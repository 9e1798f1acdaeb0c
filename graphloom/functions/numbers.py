"""Vectors, answer scores and quotas as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def anls(reference: Column, prediction: Column) -> Column:
    """1 - edit distance over the longer length, 0 where that is at most 0.5; two empty strings are alike."""
    longest = F.greatest(F.length(reference), F.length(prediction))
    value = 1 - F.levenshtein(reference, prediction) / longest
    return F.when(longest == 0, 1.0).when(value <= 0.5, 0.0).otherwise(value)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def precision(x: Column) -> Column:
    """Digits after the point of a number as it is written; 3 without a point."""
    t = x.cast("string")
    return F.when(t.contains("."), F.length(F.substring_index(t, ".", -1))).otherwise(3)


def float_equal(reference: Column, prediction: Column) -> Column:
    """Equal within 1 % to the reference, its hundredth or its hundredfold, or after half-even rounding to as many places
    as both have, at least 2 (compared up to 9).
    """
    def same(v: Column) -> Column:
        r, p = v["r"], v["p"]
        out = F.bround(r, 9) == F.bround(p, 9)
        for n in range(2, 9):
            out = F.when(v["digits"] == n, F.bround(r, n) == F.bround(p, n)).otherwise(out)
        return (F.abs(r - p) <= 0.01 * F.greatest(F.abs(r), F.abs(p))) | out

    def any_scale(v: Column) -> Column:
        scaled = F.transform(F.array(v["r"] / 100, v["r"], v["r"] * 100), lambda r: F.struct(r.alias("r"), v["p"].alias("p"), F.greatest(F.lit(2), F.least(v["places"], precision(r))).alias("digits")))
        return F.exists(scaled, same)

    return bound(F.struct(reference.alias("r"), prediction.alias("p"), precision(prediction).alias("places")), any_scale)


# The patterns of this and the next function are those of the scoring rules.
def clean_answer(text: Column) -> Column:
    t = F.trim(F.lower(text))
    t = F.trim(F.regexp_replace(t, "\\s*\\([^)]*\\)", ""))
    t = F.trim(F.regexp_replace(t, "^['\"]|['\"]$", ""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, "^\\$+", "")), "%+$", ""))


# Endings that come off, one after the other.
UNITS = ("kg", "mm", "m", "meters", "acres", "minutes", "mile", "miles", "million", "thousand", "billion")


def clean_answer_with_units(text: Column) -> Column:
    """As ``clean_answer``, after commas and units; a unit takes every letter of its own off the end."""
    t = F.trim(F.replace(F.trim(F.lower(text)), F.lit(","), F.lit("")))
    for unit in UNITS:
        t = F.regexp_replace(t, f"\\s*[{unit}]*{unit}$", "")
    t = F.trim(F.regexp_replace(t, "\\s*\\([^)]*\\)", ""))
    t = F.trim(F.regexp_replace(t, "^['\"]|['\"]$", ""))
    t = F.trim(F.regexp_replace(t, "^\\$+", ""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, "^£+", "")), "%+$", ""))


def needs_exact_match(text: Column) -> Column:
    """Urls, files, pages, phone numbers, times, dates and mail addresses aren't scored by edit distance."""
    return text.contains("https://") | text.endswith(".py") | text.endswith("ipynb") | text.startswith("page") | text.rlike("^\\d+(-\\d+|\\s\\d+)?$") | text.contains("a.m.") | text.contains("p.m.") | text.rlike("^\\d{4}[-\\s]\\d{2}([-\\s]\\d{2})?$") | text.rlike("^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$")


def linear_quota(rank: Column, n: Column, most: int, least: int) -> Column:
    """Quota of the owner at ``rank`` (from 0) of ``n``: falls in a line from most to least, rounded half to even."""
    return F.when(n <= 1, F.lit(most)).otherwise(F.bround(F.lit(float(most)) - rank / (n - 1) * (most - least), 0)).cast("int")
