"""The stored graph against the merge rules run one key after the other on dicts; deletion against building without; commits run twice."""

import random
from collections import Counter

import pytest

from graphloom.operators import state
from graphloom.operators.summaries import joined_and_cut
from graphloom.sources.shared import fresh_path

ENTITY = "entity_id string, entity_type string, description string, source_id string, file_path string, time long, place long"
RELATION = "src string, tgt string, weight double, keywords string, description string, source_id string, file_path string, time long, place long"
SEP = "<SEP>"


def summed(parts, cut):
    parts = [p for p in parts if p]
    if not parts:
        return ""
    if len(parts) == 1:
        return parts[0]
    return SEP.join(parts) if len(parts) < 8 else " ".join(" ".join(parts).split()[:cut])


class Plain:
    def __init__(self, cap, paths, method, cut=40):
        self.cap, self.paths, self.method, self.cut = cap, paths, method, cut
        self.nodes, self.edges, self.known, self.known_pairs = {}, {}, {}, {}

    def capped(self, ids, n):
        return ids[:n] if self.method == "KEEP" else ids[-n:]

    def merge_key(self, table, known, key, records):
        old, had = table.get(key), known.get(key, [])
        full = list(dict.fromkeys(had + [r["source_id"] for r in records if r["source_id"]]))
        known[key] = full
        kept = self.capped(full, self.cap)
        if self.method == "KEEP":
            records = [r for r in records if not r["source_id"] or r["source_id"] in kept or r["source_id"] in had]
        if not records:
            return
        row = {"source_id": SEP.join(kept), "truncate": "" if len(full) <= self.cap else f"FIFO {self.cap}/{len(full)}" if self.method == "FIFO" else "KEEP Old"}
        told = {}
        for r in records:
            if r["description"]:
                told.setdefault(r["description"], (r["time"], -len(r["description"]), r["place"], r["description"]))
        row["description"] = summed((old["description"].split(SEP) if old else []) + [d for d, _ in sorted(told.items(), key=lambda x: x[1])], self.cut)
        files = [p for p in (old["file_path"].split(SEP) if old else []) if p and not p.startswith("...")]
        files = list(dict.fromkeys(files + [r["file_path"] for r in records if r["file_path"]]))
        more = ["...truncated...(FIFO)" if self.method == "FIFO" else "...truncated...(KEEP Old)"] * (len(files) > self.paths)
        row["file_path"] = SEP.join(self.capped(files, self.paths) + more)
        if table is self.nodes:
            row["entity_type"] = Counter([r["entity_type"] for r in records] + ([old["entity_type"]] if old else [])).most_common()[0][0]
        else:
            row["weight"] = sum(r["weight"] for r in records) + (old["weight"] if old else 0)
            row["keywords"] = ",".join(sorted({k.strip() for r in [*records, *([old] if old else [])] for k in r["keywords"].split(",") if k.strip()}))
        table[key] = row

    def merge(self, entities, relations):
        def grouped(rows, key):
            out = {}
            for r in sorted(rows, key=lambda r: (r["time"], r["place"], r.get("entity_type", ""), r["source_id"] or "")):
                out.setdefault(key(r), []).append(r)
            return out

        for name, records in grouped(entities, lambda r: r["entity_id"]).items():
            self.merge_key(self.nodes, self.known, name, records)
        pairs = grouped([r for r in relations if r["src"] != r["tgt"]], lambda r: tuple(sorted((r["src"], r["tgt"]))))
        for pair, records in pairs.items():
            self.merge_key(self.edges, self.known_pairs, pair, records)
        for pair in sorted(pairs, key=SEP.join):
            edge = self.edges[pair]
            for end in pair:
                if end not in self.nodes:
                    self.nodes[end] = {"entity_type": "UNKNOWN", "description": edge["description"], "file_path": edge["file_path"], "truncate": "", "source_id": ""}
                self.known[end] = list(dict.fromkeys(self.known.get(end, []) + self.capped(self.known_pairs[pair], self.cap)))
                self.nodes[end]["source_id"] = SEP.join(self.capped(self.known[end], self.cap))

    def rows(self):
        return self.nodes, self.edges


def records_of(seed, n=260):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)] + ["hub"] * 8
    entities, relations = [], []
    for place in range(n):
        chunk = r.randrange(60)
        common = {"source_id": f"c{chunk}", "file_path": f"f{chunk % 9}", "time": chunk // 4, "place": place}
        if r.random() < 0.6:
            entities.append({"entity_id": r.choice(names), "entity_type": r.choice("xyz"), "description": r.choice(["", "short", f"told {place % 30}", f"a longer text {place}"]), **common})
        else:
            relations.append({"src": r.choice([*names, "only1", "only2"]), "tgt": r.choice([*names, "only3"]), "weight": float(r.randrange(1, 5)), "keywords": r.choice(["", "b, a", "c", "a,,c"]), "description": r.choice(["", f"link {place % 20}"]), **common})
    return entities, relations


def frames(spark, entities, relations):
    return spark.createDataFrame(entities, ENTITY).repartition(3), spark.createDataFrame(relations, RELATION).repartition(3)


def got(graph):
    nodes = {r.entity_id: {k: v for k, v in r.asDict().items() if k != "entity_id"} for r in graph["nodes"].collect()}
    edges = {(r.src, r.tgt): {k: v for k, v in r.asDict().items() if k not in ("src", "tgt")} for r in graph["edges"].collect()}
    return nodes, edges


def rules(cap, paths, method, cut=40):
    return state.Rules(cap, paths, method, joined_and_cut(cut))


@pytest.mark.parametrize("cap, paths, method", [(5, 3, "KEEP"), (5, 3, "FIFO")])
def test_batches(spark, cap, paths, method):
    plain, graph = Plain(cap, paths, method), state.empty_graph(spark)
    for batch in range(2):
        entities, relations = records_of(batch)
        plain.merge(entities, relations)
        graph = state.applied(graph, state.merge_batch(graph, *frames(spark, entities, relations), batch, rules(cap, paths, method)))
    assert got(graph) == plain.rows()
    tracked = {}
    for r in graph["entity_chunks"].orderBy("seen", "source_id").collect():
        tracked.setdefault(r.entity_id, []).append(r.source_id)
    assert tracked == {k: v for k, v in plain.known.items() if v}


def test_batches_split_by_time_equal_one(spark):
    """Where no description comes twice and types agree, two batches in the order of time give what one gives, but for what nodes that only edges name took from their first; one commit is run twice."""
    entities, relations = records_of(5)
    for r in [*entities, *relations]:
        r["description"] = f"text {r['place']}"
        r["time"] = r["place"]
        r["entity_type" if "entity_id" in r else "keywords"] = "t"
    few = state.Rules(300, 100, "KEEP", joined_and_cut(40), {"force": 10_000, "limit": 10**6})
    store = state.graph_store(spark, fresh_path(spark, "graph"), 4)
    done = []
    for batch, part in ((0, lambda r: r["place"] < 130), (1, lambda r: r["place"] >= 130), (1, lambda r: r["place"] >= 130)):
        graph = {n: store.read(n) for n in state.SCHEMAS}
        done.append(store.commit(batch, state.merge_batch(graph, *frames(spark, list(filter(part, entities)), list(filter(part, relations))), batch, few)))
    assert done == [True, True, False]
    once = state.merge_batch(state.empty_graph(spark), *frames(spark, entities, relations), 0, few)
    both = {n: store.read(n) for n in ("nodes", "edges", "entity_texts", "relation_texts")}
    nodes, edges = got(both)
    want_nodes, want_edges = got(once)
    assert edges == want_edges
    unordered = lambda x: {k: {c: sorted(v.split(SEP)) if c in ("source_id", "file_path") else v for c, v in row.items() if c not in ("description", "file_path") or row["entity_type"] != "UNKNOWN"} for k, row in x.items()}
    assert unordered(nodes) == unordered(want_nodes)
    assert {r.entity_id for r in both["entity_texts"].collect()} == set(nodes) and {(r.src, r.tgt) for r in both["relation_texts"].collect()} == set(edges)


def test_store(spark):
    store = state.graph_store(spark, fresh_path(spark, "store"), 3)
    row = lambda *ids: spark.createDataFrame([(i, f"d{i}", "p") for i in ids], state.SCHEMAS["chunks"])
    assert store.read("chunks").collect() == [] and store.last_batch() == -1
    assert store.commit(0, {"chunks": row(*"abcdef")})
    before = store.read("chunks")
    # a commit that died before its manifest leaves files that nobody reads
    row("zz").write.parquet(f"{store.root}/chunks/at=2/bucket=0")
    assert store.read("chunks").count() == 6
    assert store.commit(1, {"chunks": row("g")}, {"chunks": row("a", "b")})
    assert sorted(r.chunk_id for r in store.read("chunks").collect()) == list("cdefg") and before.count() == 6
    assert not store.commit(1, {"chunks": row("h")}) and store.commit(2, {}, {"chunks": row(*"cdefg")})
    assert store.read("chunks").collect() == [] and store.last_batch() == 2
    assert store.commit(3, {"chunks": row("a")}) and store.read("chunks").count() == 1


def outputs(seed):
    """Chunks and cached outputs, some chunks with two."""
    r = random.Random(seed)
    chunks = [(f"c{i}", f"d{i % 7}", f"file{i % 7}") for i in range(40)]
    cache = []
    for i in range(40):
        for turn in range(1 + (i % 3 == 0)):
            lines = [f"entity<|#|>n{r.randrange(12)}<|#|>kind {r.randrange(3)}<|#|>told {'x' * r.randrange(9)} {r.randrange(30)}" for _ in range(3)]
            lines += [f"relation<|#|>n{r.randrange(12)}<|#|>m{r.randrange(6)}<|#|>k{r.randrange(3)},z<|#|>linked {'y' * r.randrange(9)}" for _ in range(3)]
            cache.append((f"c{i}", "\n".join(lines) + "\n<|COMPLETE|>", 2 * i + turn))
    return chunks, cache


def built(spark, chunks, cache, limits):
    graph = state.empty_graph(spark) | {"chunks": spark.createDataFrame(chunks, state.SCHEMAS["chunks"]), "cache": spark.createDataFrame(cache, state.SCHEMAS["cache"])}
    return state.applied(graph, state.merge_batch(graph, *state.cached_records(graph["cache"], graph["chunks"]), 0, limits))


@pytest.mark.parametrize("gone", [["d0", "d2", "d3", "d4", "nobody"]])
def test_deletion_equals_building_without(spark, gone):
    chunks, cache = outputs(4)
    limits = rules(300, 100, "KEEP")
    graph = built(spark, chunks, cache, limits)
    after = state.applied(graph, *state.delete_documents(graph, spark.createDataFrame([(d,) for d in gone], "doc_id string"), limits, orphans="built"))
    left = [c for c in chunks if c[1] not in gone]
    want = built(spark, left, [c for c in cache if c[0] in {x[0] for x in left}], limits)
    for name in state.SCHEMAS:
        assert sorted(map(tuple, after[name].collect())) == sorted(map(tuple, want[name].collect())), name


def test_orphans_are_told_of_by_their_edges(spark):
    chunks = [("c1", "d1", "f1"), ("c2", "d2", "f2")]
    cache = [("c1", "entity<|#|>A<|#|>kind<|#|>known\nrelation<|#|>A<|#|>B<|#|>k<|#|>first", 1), ("c2", "relation<|#|>A<|#|>C<|#|>k<|#|>second", 2)]
    graph = built(spark, chunks, cache, rules(300, 100, "KEEP"))
    after = state.applied(graph, *state.delete_documents(graph, spark.createDataFrame([("d1",)], "doc_id string"), rules(300, 100, "KEEP")))
    nodes, edges = got(after)
    assert set(nodes) == {"A", "C"} and set(edges) == {("A", "C")}
    assert nodes["A"] == {"entity_type": "kind", "description": "second", "source_id": "c2", "file_path": "f2", "truncate": ""}


def test_longest_of_several_outputs(spark):
    chunks = spark.createDataFrame([("c", "d", "f")], state.SCHEMAS["chunks"])
    cache = [("c", "entity<|#|>A<|#|>x<|#|>short\nentity<|#|>B<|#|>x<|#|>same 1", 1), ("c", "entity<|#|>A<|#|>y<|#|>much longer\nentity<|#|>A<|#|>y<|#|>b\nentity<|#|>B<|#|>z<|#|>same 2", 2)]
    rows, none = state.cached_records(spark.createDataFrame(cache, state.SCHEMAS["cache"]), chunks)
    assert sorted((r.entity_id, r.entity_type, r.description) for r in rows.collect()) == [("A", "y", "b"), ("A", "y", "much longer"), ("B", "x", "same 1")] and none.count() == 0


def test_empty_batch(spark):
    changes = state.merge_batch(state.empty_graph(spark), *(spark.createDataFrame([], s) for s in (ENTITY, RELATION)), 0)
    assert all(df.count() == 0 for df in changes.values())
