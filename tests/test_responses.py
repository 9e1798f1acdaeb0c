"""Objects in damaged answers, case by case."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import responses

GOOD = {"detailed_description": "A red car", "entity_info": {"entity_name": "car", "entity_type": "image", "summary": "red"}}
TEXT = json.dumps(GOOD)
WHOLE = ("A red car", "car (image)", "image", "red", "parsed")


def fallback(text, kind="table"):
    return text, f"{kind}_{hashlib.md5(text.encode()).hexdigest()}", kind, text[:100] + "..." if len(text) > 100 else text, "fallback"


CASES = [
    (TEXT, WHOLE),
    (f"Sure!\n```json\n{TEXT}\n```\nDone", WHOLE),
    (f"{{}} an empty one, then {TEXT} and {{more}}", WHOLE),
    (f"not this {{one}} but {TEXT}", WHOLE),
    (TEXT.replace("}}", ",},}"), WHOLE),
    (TEXT.replace("A red car", r"\alpha is red"), (r"\alpha is red", *WHOLE[1:])),
    (TEXT.replace("A red car", "set {a, b}"), ("set {a, b}", *WHOLE[1:])),
    (TEXT.replace("A red car", "opens { here"), ("opens { here", *WHOLE[1:])),
    (TEXT.replace("A red car", "größe 车"), ("größe 车", *WHOLE[1:])),
    (TEXT[:-2], ("A red car", "car (image)", "image", "red", "fields")),
    ('"detailed_description": "' + "x" * 150 + '" and no more', ("x" * 150, "unknown_entity (unknown)", "unknown", "x" * 100, "fields")),
    ("No object at all. " * 9, fallback("No object at all. " * 9)),
    ("", fallback("")),
    (None, fallback("")),
    ("}}{{", fallback("}}{{")),
    (json.dumps({"detailed_description": "x"}), fallback(json.dumps({"detailed_description": "x"}))),
    (json.dumps(GOOD | {"detailed_description": ""}), fallback(json.dumps(GOOD | {"detailed_description": ""}))),
    (json.dumps({"detailed_description": "x", "entity_info": {"entity_name": "n", "entity_type": "t"}}), fallback(json.dumps({"detailed_description": "x", "entity_info": {"entity_name": "n", "entity_type": "t"}}))),
    (json.dumps(GOOD | {"detailed_description": 5}), ("5", *WHOLE[1:])),
    (json.dumps(GOOD | {"entity_info": {"entity_name": None, "entity_type": "t", "summary": "s"}}), None),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", responses.described(F.col("t"), F.lit("table")).alias("d"))
    return {r.i: tuple(r.d) for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_described(got, i):
    text, want = CASES[i]
    assert got[i] == (want or fallback(text))


def test_given_names_and_long_texts(spark):
    many = TEXT.replace("A red car", "{}" * 20_000)
    rows = [(TEXT, "mine"), ("nothing", "mine"), (TEXT, ""), (many, "mine")]
    df = spark.createDataFrame(rows, "t string, n string").select(responses.described(F.col("t"), F.lit("image"), F.col("n")).alias("d"))
    found = [r.d for r in df.collect()]
    assert [d.entity_name for d in found] == ["mine", "mine", "car (image)", "mine"]
    assert found[3].description == "{}" * 20_000


def plain_runs(text):
    depth, start, out = 0, 0, []
    for i, c in enumerate(text):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def test_balanced(spark):
    texts = ["", "a", "{}", "x{a{b}c}y{d}", "}{", "{a}}{b}{c}", "{{a}", "{a}b{c{d}e}{", "é{ü}😀{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", responses.balanced(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == {t: plain_runs(t) for t in texts}
