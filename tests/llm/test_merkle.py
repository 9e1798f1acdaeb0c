"""The Merkle manifest against one built in plain Python, and on nulls, ties, repeats, single and many trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, place long, leaf string, at long, size long"


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def way_of(levels, i):
    way = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        way.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return way


def plain(rows):
    order = lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(*r))
    rows = sorted(rows, key=order)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: tree_of([leaf_of(*r) for r in rows if r[2] == x]) for x in langs}
    top = tree_of([own[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (doc_id, text, lang, source, n) in enumerate(r for r in rows if r[2] == x):
            way = way_of(own[x], i) + way_of(top, k)
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            end = leaf_of(doc_id, text, lang, source, n)
            for a, b in way:
                end = h(*a, end, *b)
            out.append((doc_id, own[x][0][i], own[x][-1][0], top[-1][0], h(*(y for a, b in way for y in (*a, *b))), end, end == top[-1][0]))
    return sorted(out, key=repr)


def given_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 4, 5) for r in rows], SCHEMA).repartition(3)


def results(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (1, [None]), (8, ["en"]), (9, ["en"]), (2, ["en", None]), (600, ["en", "de", None, "Ünï", "𐐀", "￿"]), (90, [f"l{i}" for i in range(70)]), (1300, [f"l{i}" for i in range(600)])])
def test_manifest(spark, n, langs):
    r = random.Random(n)
    rows = [(r.randrange(4 * n), f"Text {i} ÄB", langs[i % len(langs)] if i % 2 else langs[0], r.choice(["a", None]), r.choice([None, i])) for i in range(n)]
    rows += [rows[0]] * (3 * (n > 500)) + ([(None, "No Id", "en", None, None), (None, None, None, None, None), (5, "", "", "", 0), (6, "X" * 300_000, "en", "s", 1)] if n > 500 else [])
    assert results(merkle.verified_manifest(given_rows(spark, rows), merkle.tampered_text())) == plain(rows)


def test_subroots_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_parts", lambda sc, n: 9)
    rows = [(i, f"Text {i}", f"l{i % 70}" if i % 7 else None, "a", i) for i in range(210)]
    assert results(merkle.verified_manifest(given_rows(spark, rows), merkle.tampered_text())) == plain(rows)


def test_untouched_and_empty(spark):
    rows = given_rows(spark, [(i, "Some Text", "en", "a", 9) for i in range(40)])
    assert all(r.verified for r in merkle.verified_manifest(rows).collect())
    assert results(merkle.verified_manifest(rows.filter("false"))) == []


def test_missing_children_are_noticed():
    with pytest.raises(ValueError):
        merkle._heard(((0, 0), [(0, 3, b"a", None), (2, 3, b"c", None)]))
    with pytest.raises(ValueError):
        merkle._heard(((0, 1), [(0, 9, b"a", None), (0, 9, b"a", None)]))


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = merkle.op12_merkle_manifest(spark, d)
    assert results(got) == plain(rows)
    assert 0 < got.filter(~F.col("verified")).count() <= got.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 0).count()
