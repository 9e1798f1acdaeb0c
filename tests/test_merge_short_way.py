"""What one record says of a key isn't put in order or gathered, and a chunk's records are found in one pass."""

import re

from graphloom.functions import text
from graphloom.operators import state

from test_state import ENTITY, RELATION, outputs, rules


def noted(monkeypatch):
    tables, kept = {}, state.written

    def note(df, label):
        tables.setdefault(label, []).append(kept(df, label))
        return tables[label][-1]

    monkeypatch.setattr(state, "written", note)
    return tables


def test_keys_of_one_record_are_taken_as_they_are(spark, monkeypatch):
    tables = noted(monkeypatch)
    common = {"file_path": "f", "time": 1, "place": 2}
    rows = [{"src": a, "tgt": b, "weight": 2.0, "keywords": "z, a,,a", "description": told, "source_id": source, **common} for a, b, told, source in (("a", "b", "once", "c1"), ("c", "a", None, ""), ("d", "a", "first", "c1"), ("a", "d", "second", "c2"))]
    changes = state.merge_batch(state.empty_graph(spark), spark.createDataFrame([], ENTITY), spark.createDataFrame(rows, RELATION), 0, rules(1, 1, "KEEP"))
    row = lambda a, b, told, source, more="": (a, b, 2.0, "a,z", told, source, "f", more)
    assert sorted(map(tuple, changes["edges"].collect())) == [row("a", "b", "once", "c1"), row("a", "c", "", ""), row("a", "d", "first", "c1", "KEEP Old")]
    assert [(r.src, r.tgt) for r in tables["edges"][0].collect()] == [("a", "d")]
    assert sorted((r.tgt, r.source_id) for r in changes["relation_chunks"].collect()) == [("b", "c1"), ("d", "c1"), ("d", "c2")]


def test_records_of_chunks_in_one_pass(spark, monkeypatch):
    tables = noted(monkeypatch)
    chunks, cache = outputs(9)
    entities, relations = state.cached_records(spark.createDataFrame(cache, state.SCHEMAS["cache"]), spark.createDataFrame(chunks, state.SCHEMAS["chunks"]))
    assert not entities.isEmpty() and not relations.isEmpty()
    assert list(tables) == ["cached-records"] and len(tables["cached-records"]) == 1


def test_characters_that_need_cleaning():
    before = re.compile("[^\\x20!#-%(-;=-~]")
    assert all(bool(before.fullmatch(chr(c))) == bool(re.fullmatch(text.ODD, chr(c))) for c in range(0x3000))
    assert "-" not in re.sub(r"\\.", "", text.ODD)  # no ranges
