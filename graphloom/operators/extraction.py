"""Extraction records: parsing what a model wrote into entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import END_MARK, NAME_LIMIT, TUPLE_SEP, cleaned, is_number, split_markers

# What models make of the separator ``<|#|>``, mended in this order.
DAMAGED = (
    r"<\|#\|*?#\|>", r"<\|\\#\|>", r"<\|+>", r"<.?\|#\|.?>", r"<\|?#\|?>", r"<[^|]#\|>|<\|#[^|]>", r"<\|#\|+(?!>)", r"<\|#:(?!>)",
    r"<\|+#>", r"<\|\|(?!>)", r"(?<!<)\|#\|>", r"<\|#\|>\|", r"\|\|#\|\|",
)


#: What any of ``DAMAGED`` that changes a line takes, once whole separators are one character each.
MARKS = "#|<\\||\\x01[|>]|<\\x01"


def mended(line: Column) -> Column:
    """A record line whose damaged separators are whole again; lines with whole ones alone are left as they are."""

    def mend(x: Column) -> Column:
        out = x
        for pattern in DAMAGED:
            out = F.regexp_replace(out, pattern, TUPLE_SEP.replace("$", ""))
        return F.when(F.replace(x, F.lit(TUPLE_SEP), F.lit("\x01")).rlike(MARKS), out).otherwise(x)

    return F.transform(F.array(line), mend)[0]  # the line is worked out once


def parsed_records(rows: DataFrame) -> DataFrame:
    """One row per record of ``chunk_id, output``: ``ord`` and its trimmed ``fields``; other columns stay beside them.

    Lines are records; so is what follows a separator, ``entity`` or ``relation`` and another separator within a line, where a
    model took separators for line ends. Damaged separators are mended in each. A null output has no records.
    """
    tag = f"(?=\\Q{TUPLE_SEP}\\E(?:entity|relation(?:ship)?)\\Q{TUPLE_SEP}\\E)"
    within = lambda x: x.contains(f"{TUPLE_SEP}entity") | x.contains(f"{TUPLE_SEP}relation")
    cut = lambda x: F.when(within(x), F.split(x, tag)).otherwise(F.array(x))
    parts = F.flatten(F.transform(split_markers(F.col("output"), "\n", END_MARK, END_MARK.lower()), cut))
    keep = [c for c in rows.columns if c != "output"]
    lines = rows.select(*keep, F.posexplode(F.filter(parts, lambda x: x != "")).alias("ord", "line"))
    bare = F.regexp_replace("line", f"^\\Q{TUPLE_SEP}\\E", "")
    return lines.select(*keep, "ord", _cleaned(fields=F.transform(F.split(mended(bare), "\\Q" + TUPLE_SEP + "\\E"), lambda f: F.trim(f))))


def _cleaned(**fields: Column) -> Column:
    """Columns worked out once, however often they are asked for afterwards."""
    return F.inline(F.array(F.struct(*(c.alias(n) for n, c in fields.items()))))


def extracted(records: DataFrame) -> DataFrame:
    """Valid entity and relation records in one pass: ``src, tgt, word, description, weight`` beside the other columns.

    An entity has its name in ``src``, null in ``tgt`` and ``weight``, and its type in ``word``, a relation its keywords there. An entity
    has four fields, a name, a plain type and a description; a relation five and two different ends, and its weight is the last field
    where that is a number, else 1. The last field is the description.
    """
    keep, f = [c for c in records.columns if c != "fields"], lambda i: F.get("fields", F.lit(i))
    linked = (F.size("fields") == 5) & f(0).contains("relation")
    rows = records.select(*keep, "fields", linked.alias("linked")).filter(F.col("linked") | (F.size("fields") == 4) & f(0).contains("entity"))
    clean = F.transform("fields", lambda x, i: F.when(i == 0, x).when(i < F.size("fields") - 1, cleaned(x, inner_quotes=True)).otherwise(cleaned(x)))
    number = F.when(F.col("linked"), F.regexp_replace(F.regexp_replace(f(4), "^\"+|\"+$", ""), "^'+|'+$", ""))
    rows = rows.select(*keep, "linked", _cleaned(clean=clean, number=number))
    c = lambda i: F.get("clean", F.lit(i))
    a, b = F.substring(c(1), 1, NAME_LIMIT), F.substring(c(2), 1, NAME_LIMIT)
    either = lambda x, y: F.when(F.col("linked"), x).otherwise(y)
    word = either(F.replace(c(3), F.lit("，"), F.lit(",")), F.lower(F.replace(c(2), F.lit(" "))))
    weight = F.when(F.col("linked"), F.when(is_number(F.col("number")), F.col("number").try_cast("double")).otherwise(1.0))
    made = rows.select(*keep, "linked", either(F.least(a, b), a).alias("src"), either(F.greatest(a, b), F.lit(None)).alias("tgt"), word.alias("word"), either(c(4), c(3)).alias("description"), weight.alias("weight"))
    pair = (F.col("src") != "") & (F.col("tgt") != "") & (F.col("src") != F.col("tgt"))
    entity = (F.col("src") != "") & (F.trim("description") != "") & (F.col("word") != "") & ~F.col("word").rlike("['()<>|/\\\\]")
    return made.filter(either(pair, entity)).drop("linked")


def entities(records: DataFrame) -> DataFrame:
    """Valid entity records: four fields, a name, a plain type, a description."""
    keep = [c for c in records.columns if c != "fields"]
    return extracted(records.filter(F.size("fields") == 4)).select(*keep, F.col("src").alias("entity_id"), F.col("word").alias("entity_type"), "description")


def relations(records: DataFrame) -> DataFrame:
    """Valid relation records: five fields, two different ends; the weight is the last field where that is a number, else 1."""
    keep = [c for c in records.columns if c != "fields"]
    return extracted(records.filter(F.size("fields") == 5)).select(*keep, "src", "tgt", F.col("word").alias("keywords"), "description", "weight")
