"""The tokenizer hook with byte-level tokens, and numbered markers against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chunking, markers

TOKENIZERS = "/opt/tokenizers"
TEXTS = ["größe 北京 Hello 😀😀 naïve", "", None, "a", "😀" * 50, "  plain words\n\nand a line\n", "日本語" * 30 + "\n" + "x y " * 40]


class Bytes:
    def encode(self, text):
        return list(text.encode())

    def decode_bytes(self, tokens):
        return bytes(tokens)


def byte_pairs(path):
    """A factory that tasks can call without this module."""

    def make():
        import base64
        import sys

        import tiktoken

        sys.path.insert(0, path)
        import public_tokenizers as P

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
        made = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

        class Pairs:
            encode = staticmethod(made.encode_ordinary)
            decode_bytes = staticmethod(made.decode_bytes)

        return Pairs()

    return make


def docs(spark):
    return spark.createDataFrame([(i, t, f"old {i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, content string")


@pytest.mark.parametrize("size", [1, 2, 5, 7])
def test_bytes_without_overlap_restore_the_text(size):
    for text in filter(None, TEXTS):
        ids = list(text.encode())
        parts = [chunking.window(Bytes(), ids, s, size) for s in range(0, len(ids), size)]
        assert "".join(parts) == text and "�" not in "".join(parts)


def test_byte_pairs(spark):
    """Windows by ids; every chunk's text lies whole in its document, and the counts are those of the ids."""
    got = chunking.token_chunks(docs(spark), byte_pairs(TOKENIZERS), size=6, overlap=2).collect()
    own = byte_pairs(TOKENIZERS)()
    for i, text in enumerate(TEXTS):
        rows = sorted((r.chunk_order_index, r.tokens, r.content) for r in got if r.doc_id == i)
        ids = own.encode(text or "")
        assert [r[:2] for r in rows] == [(k, min(6, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 4))]
        assert all(c in text and "�" not in c for _, _, c in rows)
        for (k, _, c), s in zip(rows, range(0, len(ids), 4)):
            raw = own.decode_bytes(ids[s : s + 6])
            assert raw.decode("utf-8", "ignore").strip() in c
    assert got[0].asDict().keys() == {"doc_id", "text", "chunk_order_index", "tokens", "content"}


def test_split_by_character(spark):
    only = chunking.token_chunks(docs(spark), size=3, overlap=1, split_by="\n", split_only=True).filter("doc_id in (1, 2, 5, 6)").collect()
    assert sorted((r.doc_id, r.chunk_order_index, r.tokens, r.content) for r in only) == [(1, 0, 0, ""), (5, 0, 2, "plain words"), (5, 1, 0, ""), (5, 2, 3, "and a line"), (5, 3, 0, ""), (6, 0, 1, "日本語" * 30), (6, 1, 80, ("x y " * 40).strip())]
    cut = chunking.token_chunks(docs(spark), size=3, overlap=1, split_by="\n").filter("doc_id = 6").orderBy("chunk_order_index").collect()
    assert [r.tokens for r in cut] == [1] + [3] * 39 + [2] and cut[1].content == "x y x" and cut[-1].content == "x y"
    with pytest.raises(ValueError):
        chunking.token_chunks(docs(spark), size=3, overlap=3)
    assert chunking.token_chunks(docs(spark).limit(0)).count() == 0


CHUNKS = [
    (None, 1, "a", "Image Path: x.png and image path: x.png, Image Path: y.jpg", "image"),
    (None, 1, "b", "Image Path: z.gif Image Path: x.png", "table"),
    (None, 2, "c", "Image Path: w.png", "text"),
    ("q", 1, "a", "\nImage Path:  x.PNG\n tail [$1]", "image"),
    ("q", 2, "b", "", "image"),
    ("q", 3, "c", None, "image"),
    ("q", 4, "d", "no image", None),
    ("q", 5, "e", "IMAGE PATH: deep/name with blanks.webp", "image"),
    ("q", 6, "f", "Image Path: unreadable.png then Image Path: x.png, Image Path: x.PNG", "table"),
]


def by_hand(rows, readable):
    seen, out, found = {}, {}, set()
    for key, ord_, chunk, content, modality in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if content and modality in markers.IMAGE_MODALITIES:
            own = seen.setdefault(key, {})

            def mark(m):
                path = m[1].strip()
                if path in own or path not in readable:
                    return m[0]
                own[path] = len(own) + 1
                found.add((key, path, chunk, own[path]))
                return f"Image Path: {path}\n[VLM_IMAGE_{own[path]}]"

            content = re.sub(markers.IMAGE_PATH, mark, content)
        out[key, chunk] = content
    return out, found


def test_markers(spark):
    rows = CHUNKS + [("hot", i, f"h{i}", f"Image Path: i{i * 7 % 300}.png Image Path: j{i % 90}.png", "image") for i in range(400)]
    paths = {m[1].strip() for r in rows for m in re.finditer(markers.IMAGE_PATH, r[3] or "")} - {"unreadable.png"}
    chunks = spark.createDataFrame(rows, "topic string, ord long, chunk_id string, content string, modality string").repartition(3)
    found = markers.images(chunks, ["topic"], spark.createDataFrame([(p,) for p in paths], "path string"))
    texts, numbers = by_hand(rows, paths)
    assert {(r.topic, r.path, r.chunk_id, r.marker_num) for r in found.collect()} == numbers
    assert {(r.topic, r.chunk_id): r.content for r in markers.marked(chunks, found, ["topic"]).collect()} == texts
    assert markers.marked(chunks.limit(0), found.limit(0), ["topic"]).count() == 0


def test_markers_in_one_order(spark):
    """Without keys all chunks make one order, dealt over ranges."""
    chunks = spark.createDataFrame([(i, f"c{i}", f"Image Path: {i % 70}.png", "image") for i in range(200)], "ord long, chunk_id string, content string, modality string")
    found = markers.images(chunks, [])
    assert sorted((r.marker_num, r.path) for r in found.collect()) == [(i + 1, f"{i}.png") for i in range(70)]
    assert markers.marked(chunks, found, []).filter(F.col("content").contains("VLM")).count() == 70


def test_image_path(spark):
    rows = [("Image Path: a b.png x.jpg tail",), ("image path:c.TIFF",), ("nothing",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(markers.image_path(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == ["a b.png x.jpg", "c.TIFF", None, None]
