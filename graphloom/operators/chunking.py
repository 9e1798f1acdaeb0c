"""Chunks of texts by any tokenizer, through a Python table function that is joined laterally to its row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "chunk_order_index int, tokens int, content string"


class Tokenizer(Protocol):
    """What a hook gives: tokens of a text, and the UTF-8 bytes of some of them. Byte-level tokens may end within a character."""

    def encode(self, text: str) -> Sequence: ...

    def decode_bytes(self, tokens: Sequence) -> bytes: ...


class Words:
    """The default: runs between ASCII white space, told with one blank between them."""

    def encode(self, text: str) -> list[str]:
        return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]

    def decode_bytes(self, tokens: Sequence) -> bytes:
        return " ".join(tokens).encode()


def _continued(data: bytes) -> int:
    """How many leading bytes belong to a character that began before."""
    n = 0
    while n < len(data) and n < 3 and data[n] & 0xC0 == 0x80:
        n += 1
    return n


def window(tokenizer: Tokenizer, ids: Sequence, start: int, size: int) -> str:
    """Text of ``ids[start : start + size]``; a character that tokens split belongs to the windows that hold its first byte."""
    body = tokenizer.decode_bytes(ids[start : start + size])
    body = body[_continued(body) :] if start else body
    after = tokenizer.decode_bytes(ids[start + size : start + size + 3]) if start + size < len(ids) else b""
    if body and after:
        body += after[: _continued(after)]
    return body.decode("utf-8", "replace")


def cut(tokenizer: Tokenizer, text: str, size: int, overlap: int, split_by: str | None, split_only: bool) -> Iterator[tuple[int, str]]:
    """Token counts and trimmed contents of a text's chunks, in order."""
    for part in text.split(split_by) if split_by else [text]:
        ids = tokenizer.encode(part)
        if split_by and (split_only or len(ids) <= size):
            yield len(ids), part.strip()
        else:
            for start in range(0, len(ids), size - overlap):
                yield min(size, len(ids) - start), window(tokenizer, ids, start, size).strip()


def token_chunks(docs: DataFrame, make: Callable[[], Tokenizer] = Words, *, size: int = 1200, overlap: int = 100, split_by: str | None = None, split_only: bool = False) -> DataFrame:
    """``docs`` with a row for each chunk of ``text``: ``chunk_order_index, tokens, content`` replace columns of these names.

    ``make`` is called once in each task and must be importable there, or be a function within a function, which is sent along.
    Windows of ``size`` tokens start every ``size - overlap``; a last window of overlap alone is a chunk too. With ``split_by``
    texts are cut there first, and only parts of more than ``size`` tokens are cut into windows, with ``split_only`` none;
    empty parts are chunks without tokens. Contents are trimmed and hold whole characters only; without overlap no character is lost or
    comes twice. A null text has no chunk, an empty one none either, unless ``split_by`` makes it one empty part.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    class Chunker:
        def __init__(self):
            self.tokenizer = make()

        def eval(self, text: str):
            if text is not None:
                for i, (n, content) in enumerate(cut(self.tokenizer, text, size, overlap, split_by, split_only)):
                    yield i, n, content

    kept = docs.drop("chunk_order_index", "tokens", "content")
    return kept.lateralJoin(F.udtf(Chunker, returnType=CHUNK, useArrow=True)(F.col("text").outer()))
