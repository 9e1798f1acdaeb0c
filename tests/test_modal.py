"""Described blocks: nulls, repeats, clashing columns, hot documents, empty tables."""

from graphloom.operators import modal

SCHEMA = "full_doc_id long, chunk_order_index long, file_path string, type string, img_path string, captions array<string>, footnotes array<string>, body string, text_format string, description string, summary string, entity_name string, entity_type string, page_idx int, content string"
ROWS = [
    (1, 0, "a/b/c.pdf", "image", "x.png", ["one", "two"], [], None, None, "seen", None, "x (image)", "image", None, "clash"),
    (1, 1, "c.pdf", "image", "x.png", ["one", "two"], None, None, None, "seen", "sum", "x (image)", None, 3, "clash"),
    (2, 0, None, "table", None, None, ["f"], "|a|b|", None, None, None, None, None, 1, "clash"),
    (None, None, "n.pdf", None, None, None, None, None, None, None, None, "n", None, None, None),
    (2, 2, "d.pdf", "equation", None, None, None, "100 % of x_{1}", "latex", "100 %s", None, "eq", None, 0, None),
]


def test_chunks_and_entities(spark):
    blocks = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.content: r for r in modal.modal_chunks(blocks).collect()}
    image = "\nImage Content Analysis:\nImage Path: x.png\nCaptions: one, two\nFootnotes: None\n\nVisual Analysis: seen"
    table = "Table Analysis:\nImage Path: \nCaption: None\nStructure: |a|b|\nFootnotes: f\n\nAnalysis: "
    other = "Generic Content Analysis:\nContent: \n\nAnalysis: "
    equation = "Mathematical Equation Analysis:\nEquation: 100 % of x_{1}\nFormat: latex\n\nMathematical Analysis: 100 %s"
    assert set(got) == {image, table, other, equation}
    assert (got[image].chunk_order_index, got[image].file_path, got[image].page_idx, got[other].page_idx, got[other].original_type) == (1, "c.pdf", 3, 0, "generic")
    mains = {r.entity_name: r for r in modal.main_entities(blocks).collect()}
    assert set(mains) == {"x (image)", "n", "eq"} and mains["x (image)"].content == "sum" and mains["x (image)"].entity_type == "image"
    assert mains["eq"].source_id == got[equation].chunk_id and mains["n"].content is None
    assert modal.modal_chunks(blocks.limit(0)).count() == modal.main_entities(blocks.limit(0)).count() == 0


def test_lists_of_documents(spark):
    known = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "z", 1)], "full_doc_id long, chunk_id string, place long")
    new = [(1, "b", 0), (1, "c", 5), (1, "d", 3), (1, "c", 9), (2, "a", 1), (None, "z", 0), (None, "y", None)] + [(3, f"h{i:03}", i // 2) for i in range(300)]
    chunks = spark.createDataFrame(new, "full_doc_id long, chunk_id string, chunk_order_index long").repartition(3)
    got = modal.appended_chunks(known, chunks).collect()
    assert {(r.full_doc_id, r.chunk_id, r.place) for r in got if r.full_doc_id != 3} == {(1, "a", 1), (1, "b", 2), (1, "d", 3), (1, "c", 4), (2, "a", 1), (None, "z", 1), (None, "y", 2)}
    assert sorted((r.place, r.chunk_id) for r in got if r.full_doc_id == 3) == [(i + 1, f"h{i:03}") for i in range(300)]
    assert modal.appended_chunks(known, chunks.limit(0)).count() == 3


def test_completion(spark):
    status = spark.createDataFrame([(1, "processed"), (2, "processed"), (3, None), (4, "failed")], "doc_id long, status string")
    listed = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "full_doc_id long, chunk_id string, place long")
    blocks = listed.drop("place").union(spark.createDataFrame([(2, "c")], "full_doc_id long, chunk_id string"))
    got = modal.completion(status, listed, blocks, listed.drop("place")).collect()
    assert {tuple(r) for r in got} == {(1, "processed", 2, True, True), (2, "processed", 0, False, False), (3, None, 0, True, False), (4, "failed", 0, True, False)}
