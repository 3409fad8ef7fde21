"""The query surface over a table of publications."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.functions import text as X
from corvane.operators import search as S

_DATE, _YEAR = "publication_date", "filename_year"


@dataclass(frozen=True)
class Filters:
    """Types must be among those given, some author must contain one of the labels, dates must lie in the range."""

    types: Sequence[str] = ()
    authors: Sequence[str] = ()
    start: str | None = None
    end: str | None = None

    def column(self) -> Column:
        fits = F.lit(True)
        if self.types:
            fits = fits & F.col("publication_type").isin(*self.types)
        if self.authors:
            labels = [unicodedata.normalize("NFC", a).casefold() for a in self.authors]
            # One string, for an array's elements cannot go to Python one by one; no label holds the separator.
            fits = fits & X.contains_any(X.fold(X.composed(F.array_join("authors", "\x00"))), labels)
        if self.start or self.end:
            fits = fits & D.in_range(F.col(_DATE), F.col(_YEAR), self.start, self.end)
        return fits


class Publications:
    """Queries on (publication_id, publication_type, title, abstract, keywords, content, authors, publication_date,
    filename_year). Every method returns a lazy table; a search writes its term counts at the call."""

    def __init__(self, publications: DataFrame) -> None:
        self.rows = publications

    def fields(self) -> dict[str, Column]:
        return {
            "title": F.col("title"),
            "abstract": F.col("abstract"),
            "keywords": F.array_join("keywords", " "),
            "content": F.col("content"),
        }

    def get(self, publication_id: str) -> DataFrame:
        return self.rows.filter(F.col("publication_id") == publication_id)

    def search(self, query: str, filters: Filters | None = None, limit: int = 10) -> DataFrame:
        allowed = (filters or Filters()).column()
        return S.lexical_search(self.rows, query, self.fields(), "publication_id", limit, allowed)

    def find_similar(self, title: str, abstract: str = "", limit: int = 10) -> DataFrame:
        return self.search(f"{title} {abstract}", limit=limit)

    def find_related_by_keywords(self, keywords: Sequence[str], limit: int = 10) -> DataFrame:
        return self.search(" ".join(dict.fromkeys(keywords)), limit=limit)

    def recent(self, limit: int, filters: Filters | None = None) -> DataFrame:
        rows = self.rows.filter((filters or Filters()).column())
        day = D.effective_day(F.col(_DATE), F.col(_YEAR))
        return rows.withColumn("__day", day).orderBy(F.desc("__day"), "publication_id").limit(max(limit, 0)).drop("__day")

    def distribution(self, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
        """Counts by type and year; a null year is unknown."""
        year = D.effective_year(F.col(_DATE), F.col(_YEAR))
        rows = self.rows.withColumn("year", year)
        if start_year is not None or end_year is not None:
            rows = rows.filter(F.col("year").between(start_year or 1, end_year or 9999))
        return rows.groupBy("publication_type", "year").agg(F.count("*").alias("n"))
