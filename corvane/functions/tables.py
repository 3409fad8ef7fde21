"""Parsers and chunkers as table functions, for SQL.

``SELECT * FROM document_pages(...)`` is a lateral join: one JSON array of pages in, its pages out.
``SELECT * FROM chunk_pages(TABLE(pages) PARTITION BY (doc) ORDER BY (page), 4000)`` makes a document's chunks in the task
that holds it, as :func:`corvane.operators.corpus.chunk_pages` does. :func:`register` makes both known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corvane.operators.corpus import BLANK, SEPARATOR
from corvane.sources.files import json_pages


@udtf(returnType="page int, text string, failure string")
class DocumentPages:
    """Pages of a JSON array of (page, text); faults are rows with their code."""

    def eval(self, raw: str) -> Iterator[tuple]:
        yield from json_pages(raw)


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("page", "start", "stop")])


class _Chunk:
    def __init__(self, section: str | None) -> None:
        self.section, self.pages, self.texts, self.size, self.causes = section, [], [], 0, []

    def add(self, page: int, text: str) -> None:
        self.size += len(text) + (len(SEPARATOR) if self.texts else 0)
        self.pages.append(page)
        self.texts.append(text)

    def row(self, doc: Any, number: int) -> tuple:
        spans, at = [], 0
        for i, (page, text) in enumerate(zip(self.pages, self.texts, strict=True)):
            stop = at + len(text) + (len(SEPARATOR) if i + 1 < len(self.texts) else 0)
            spans.append((page, at, stop))
            at = stop
        return doc, number, self.pages[0], self.pages[-1], self.section, SEPARATOR.join(self.texts), spans, self.causes


class _ChunkPages:
    """Takes a document's pages one by one and holds one open chunk; what is full is given out at once, but for causes that
    still belong to it."""

    @staticmethod
    def analyze(pages: AnalyzeArgument, max_characters: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pages.isTable:
            raise ValueError("the first argument is a table: TABLE(pages) PARTITION BY (doc) ORDER BY (page)")
        kinds = {f.name: f.dataType for f in pages.dataType.fields}
        missing = {"doc", "page", "section", "provenance", "text"} - kinds.keys()
        if missing:
            raise ValueError(f"pages lack the columns {sorted(missing)}")
        if max_characters is not None and (not max_characters.isConstantExpression or (max_characters.value or 0) <= 0):
            raise ValueError("the largest number of characters is a positive constant")
        schema = T.StructType([T.StructField("doc", kinds["doc"])])
        for name in ("chunk_index", "page_start", "page_end"):
            schema = schema.add(name, T.IntegerType())
        schema = schema.add("section", T.StringType()).add("text", T.StringType())
        return AnalyzeResult(schema.add("spans", T.ArrayType(_SPAN)).add("boundaries", T.ArrayType(T.StringType())))

    def __init__(self) -> None:
        self.open: _Chunk | None = None
        self.done: _Chunk | None = None  # closed, but blank pages after it may still be the last
        self.waiting: list[str] = []
        self.before: tuple | None = None
        self.number, self.doc = 0, None

    def _close(self) -> Iterator[tuple]:
        if self.done:
            yield self.done.row(self.doc, self.number)
            self.number += 1
        self.done, self.open = self.open, None

    def eval(self, row: T.Row, max_characters: int = 4000) -> Iterator[tuple]:
        self.doc = row["doc"]
        text, page = row["text"] or "", row["page"]
        if BLANK.match(text):
            if self.open:
                self.open.causes.append("blank-page")
                yield from self._close()
            else:
                self.waiting.append("blank-page")
            self.before = None
            return
        breaks = []
        if self.before:
            breaks += ["section-title-change"] * (row["section"] != self.before[1])
            breaks += ["page-gap"] * (page != self.before[0] + 1)
            breaks += ["parser-provenance-change"] * (row["provenance"] != self.before[2])
        if self.open:
            over = self.open.size + len(SEPARATOR) + len(text) > max_characters
            if breaks or over:
                self.open.causes += [*breaks, *(["max-characters"] if over else [])]
                yield from self._close()
        if not self.open:
            self.open = _Chunk(row["section"])
            self.open.causes, self.waiting = self.waiting, []
        self.open.add(page, text)
        self.before = (page, row["section"], row["provenance"])
        if self.open.size >= max_characters:
            self.open.causes.append("max-characters")
            yield from self._close()

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield from self._close()
        if self.done:
            self.done.causes += self.waiting
            yield from self._close()


ChunkPages = udtf(_ChunkPages)


def register(spark: SparkSession) -> None:
    """Make both functions known to a session."""
    spark.udtf.register("document_pages", DocumentPages)
    spark.udtf.register("chunk_pages", ChunkPages)
