"""Label propagation on numbered nodes: ties go by name, null ends don't vote, each round is a written table of numbers."""

from graphloom.operators import graph


def test_numbers_keep_names_order(spark, monkeypatch):
    tables = {}
    kept = graph.written

    def noted(df, label):
        tables[label] = dict(df.dtypes)
        return kept(df, label)

    monkeypatch.setattr(graph, "written", noted)
    edges = [("p10", "s2", 1.0), ("p10", "s10", 1.0), ("p9", "s10", 1.0), ("p9", "s2", 1.0), ("P1", "é", 2.0), ("é", "z", 2.0), (None, "p9", 9.0), ("lone", None, 1.0)]
    labels = {n: n for e in edges for n in e[:2]}
    for _ in range(3):
        new = {}
        for n in labels:
            votes = {}
            for x, y, w in edges:
                for u, v in ((x, y), (y, x)):
                    if u == n and v is not None and v in labels:
                        votes[labels[v]] = votes.get(labels[v], 0) + w
            if votes:
                new[n] = min(votes, key=lambda k: (-votes[k], k.encode()))
        labels = new
    got = graph.communities(spark.createDataFrame(edges, "src string, tgt string, weight double"), 3).collect()
    assert {r.entity_id: r.label for r in got} == labels and len(got) == len(labels)
    assert [tables[f"labels-{i}"] for i in range(3)] == [{"id": "bigint", "label": "bigint"}] * 3
