"""Every query of the engine against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from graphloom.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="session")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = sql.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_similarity(spark, tmp_path):
    texts = ["kitten", "sitting", "", "", "größe ñandú", "grösse nandu", "a" * 300, "a" * 290 + "b" * 10]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.score for r in catalog.QUERIES["edit_similarity"](spark, str(tmp_path)).collect()}
    for i, (a, b) in enumerate(zip(texts, texts[1:])):
        n = max(len(a), len(b))
        x = 1 - edit_distance(a, b) / n if n else 1.0
        assert got[i] == pytest.approx(round(x if x > 0.5 else 0.0, 6))


def test_label_propagation(spark):
    from graphloom.operators import graph

    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 0.5), ("d", "e", 3.0), ("e", "f", 1.0), ("d", "f", 1.0)]
    labels = {n: n for e in edges for n in e[:2]}
    for _ in range(5):
        new = {}
        for n in labels:
            votes = {}
            for x, y, w in edges:
                for u, v in ((x, y), (y, x)):
                    if u == n:
                        votes[labels[v]] = votes.get(labels[v], 0) + w
            new[n] = min(votes, key=lambda k: (-votes[k], k))
        labels = new
    got = graph.communities(spark.createDataFrame(edges, "src string, tgt string, weight double")).collect()
    assert {r.entity_id: r.label for r in got} == labels


def test_relation_weights(spark):
    from graphloom.operators import extraction

    rows = [(f"c{i}", f"relation<|#|>A{i} x<|#|>B<|#|>k<|#|>{w}") for i, w in enumerate(["-3", "12345678901", '"2.5"', "words"])]
    got = extraction.relations(extraction.parsed_records(spark.createDataFrame(rows, "chunk_id string, output string"))).orderBy("chunk_id").collect()
    assert [r.weight for r in got] == [-3.0, 12345678901.0, 2.5, 1.0]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
