import corpus_pipeline
from graphloom.llm import queries

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, D, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, D), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() >= counts[4]


def test_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, D)
        found = c.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
        want = sorted(tuple(show(r[names.index(x)]) for x in sorted(names)) for r in found.fetchall())
        assert sorted(tuple(show(r[x]) for x in sorted(names)) for r in df.collect()) == want, name
