"""What a model says of an image, table or formula: a JSON object somewhere in its answer, often damaged, as columns.

All is column functions: braces are followed by a fold over the pieces between them, objects are parsed as variants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the fields asked for, and of what stands in where they are missing.
DESCRIPTION, INFO, FIELDS = "detailed_description", "entity_info", ("entity_name", "entity_type", "summary")
NO_NAME, NO_TYPE, SUMMARY_LENGTH = "unknown_entity", "unknown", 100


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def balanced(text: Column) -> Column:
    """Outermost runs from ``{`` to its ``}``, in order. Braces inside strings count too.

    The fold holds places of pieces, not their text, so long objects with many braces cost no more than their length.
    """
    return _let(F.split(text, r"(?<=[{}])", -1), _runs)


def _runs(pieces: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("opened"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))

    def step(s: Column, piece: Column) -> Column:
        opens, closes = piece.endswith("{"), piece.endswith("}")
        ends = closes & (s["depth"] == 1)
        return F.struct(
            (s["at"] + 1).alias("at"),
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["opened"]).alias("opened"),
            F.when(ends, F.array_append(s["found"], F.struct(s["opened"].alias("a"), s["at"].alias("b")))).otherwise(s["found"]).alias("found"),
        )

    runs = F.aggregate(pieces, start, step)["found"]
    return F.transform(runs, lambda r: F.concat(F.lit("{"), F.array_join(F.slice(pieces, r["a"] + 2, r["b"] - r["a"]), "")))


def candidates(text: Column) -> Column:
    """What may be the object: fenced code first, then balanced runs, then all from the first brace to the last."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    widest = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.concat(fenced, balanced(text), F.when(widest != "", F.array(widest)).otherwise(F.array().cast("array<string>")))


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r",(\s*[}\]])", "$1")


def with_escaped_backslashes(text: Column) -> Column:
    """A backslash before a quote or a letter stands for itself, as in formulas."""
    return F.regexp_replace(F.regexp_replace(text, r'(?<!\\)\\(?=")', r"\\\\"), r"\\(?=[a-zA-Z])", r"\\\\")


def _parsed(candidate: Column) -> Column:
    """The object if the candidate is one and nothing else; brackets around it make what follows an object an error."""
    whole = F.try_parse_json(F.concat(F.lit("["), candidate, F.lit("]")))
    return _let(whole, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def first_object(text: Column) -> Column:
    """A variant of the first candidate that parses and isn't empty: as it stands, else without trailing commas, else with backslashes escaped.

    Null where none does. A key that comes twice makes a candidate unreadable.
    """

    def first(found: Column, repair) -> Column:
        objects = F.filter(F.transform(found, lambda c: _parsed(repair(c))), lambda v: v.isNotNull() & (F.to_json(v) != "{}"))
        return F.get(objects, F.lit(0))

    return _let(candidates(text), lambda found: F.coalesce(first(found, lambda c: c), first(found, without_trailing_commas), first(found, with_escaped_backslashes)))


def described(response: Column, kind: Column, name: Column | None = None) -> Column:
    """``struct<description, entity_name, entity_type, summary, how>`` of a model's response about a thing of ``kind``.

    ``how`` is ``parsed``, ``fields`` where no object can be read and fields are taken from their quoted names, or ``fallback``
    where the description or a field is missing: then the response is the description. A parsed name gains its type in
    brackets; ``name`` stands in place of any. Values that aren't text become their JSON; a null field counts as missing, a null
    response is an empty one.
    """
    response = F.coalesce(response, F.lit(""))
    given = F.lit(None).cast("string") if name is None else F.nullif(name, F.lit(""))
    return _let(first_object(response), lambda found: _entity(found, response, kind, given))


def _entity(found: Column, response: Column, kind: Column, given: Column) -> Column:
    of = lambda path: F.try_variant_get(found, path, "string")
    field = lambda n: F.nullif(F.regexp_extract(response, rf'"{n}":\s*"([^"]*)"', 0), F.lit(""))
    value = lambda n: F.when(field(n).isNotNull(), F.regexp_extract(response, rf'"{n}":\s*"([^"]*)"', 1))
    told = F.when(found.isNotNull(), of(f"$.{DESCRIPTION}")).otherwise(F.coalesce(value(DESCRIPTION), F.lit("")))
    parts = [F.when(found.isNotNull(), of(f"$.{INFO}.{n}")) for n in FIELDS]
    taken = [F.coalesce(value(FIELDS[0]), F.lit(NO_NAME)), F.coalesce(value(FIELDS[1]), F.lit(NO_TYPE)), F.coalesce(value(FIELDS[2]), F.substring(told, 1, SUMMARY_LENGTH))]
    entity, type_, summary = (F.when(found.isNotNull(), p).otherwise(t) for p, t in zip(parts, taken, strict=True))
    whole = F.coalesce((told != "") & entity.isNotNull() & type_.isNotNull() & summary.isNotNull(), F.lit(False))
    kept = F.struct(told.alias("description"), F.coalesce(given, F.concat(entity, F.lit(" ("), type_, F.lit(")"))).alias("entity_name"), type_.alias("entity_type"), summary.alias("summary"), F.when(found.isNotNull(), "parsed").otherwise("fields").alias("how"))
    cut = F.when(F.length(response) > SUMMARY_LENGTH, F.concat(F.substring(response, 1, SUMMARY_LENGTH), F.lit("..."))).otherwise(response)
    other = F.struct(response.alias("description"), F.coalesce(given, F.concat(kind, F.lit("_"), F.md5(response.cast("binary")))).alias("entity_name"), kind.alias("entity_type"), cut.alias("summary"), F.lit("fallback").alias("how"))
    return F.when(whole, kept).otherwise(other)
