"""Text expressions: folding, tokens, term counts and character classes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT = "0-9a-z가-힣"
#: All other characters, as ranges: Java matches the negated class several times slower.
OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x{ABFF}\x{D7A4}-\x{10FFFF}]+"
#: Characters for which lower case and sharp s are not enough: combining marks, single letters of Hangul syllables, and
#: letters that NFC and full case folding make kept ones.
UNSETTLED = "[\u0149\u017f\u01f0\u0300-\u036f\u1100-\u11ff\u1e96-\u1e9a\ufb00-\ufb06]"


def fold(c: Column) -> Column:
    """NFC and case folding for text that is in NFC already: lower case, with sharp s as ss. In the JVM."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """NFC and full case folding of any text."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).casefold())


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def composed(c: Column) -> Column:
    """NFC of any text. Only rows with combining marks or single letters of Hangul syllables go to Python; all others are
    in the form already as far as kept characters go."""
    return F.coalesce(nfc(F.when(c.rlike("[\u0300-\u036f\u1100-\u11ff]"), c)), c)


def search_text(c: Column) -> Column:
    """Folded text in which every run of other characters is one space."""
    return F.trim(F.regexp_replace(fold(c), OTHERS, " "))


def canonical_text(c: Column) -> Column:
    """Folded text without any other characters."""
    return F.regexp_replace(fold(c), OTHERS, "")


def canonical_exact(c: Column) -> Column:
    """As :func:`canonical_text`, of any text. Only rows for which the form makes a difference go to Python."""
    return F.regexp_replace(F.coalesce(fold_exact(F.when(c.rlike(UNSETTLED), c)), fold(c)), OTHERS, "")


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order of first use."""
    folded = unicodedata.normalize("NFC", query).casefold()
    return list(dict.fromkeys(re.findall(f"[{KEPT}]+", folded)))


def term_count(text: Column, term: str) -> Column:
    """Non-overlapping places of ``term`` in ``text``, inside words too."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))
    return F.floor(gone / F.lit(len(term)))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def metadata_text(c: Column) -> Column:
    """Control and format characters and white space made single spaces."""
    return F.trim(F.regexp_replace(c, r"(?U)[\p{Cc}\p{Cf}\s]+", " "))


def content_tokens(c: Column, stop_words: Sequence[str] = (), least: int = 2) -> Column:
    """Distinct runs of Latin letters and digits, or of Hangul, without short ones and stop words."""
    tokens = F.regexp_extract_all(fold(c), F.lit(r"[0-9a-z]+|[가-힣]+"), F.lit(0))
    kept = F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= least))
    return F.array_except(kept, F.array(*[F.lit(w) for w in stop_words])) if stop_words else kept


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either set is empty."""
    both = F.size(F.array_union(a, b))
    either = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(either, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(both > 0, both))


def without(c: Column, pattern: str) -> Column:
    """Characters of ``c`` that match ``pattern``, counted."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t\r]]"
TRAILING_JAMO = r"[ᄀ-ᇿ㄰-㆏ꥠ-꥿ힰ-퟿]$"


def control_count(c: Column) -> Column:
    return without(c, CONTROL)


def hangul_count(c: Column) -> Column:
    return without(c, "[가-힣]")


def unprintable_count(c: Column) -> Column:
    return without(c, UNPRINTABLE)


def contains_any(c: Column, markers: Sequence[str]) -> Column:
    return reduce(lambda a, m: a | c.contains(m), markers, F.lit(False))


def csv_safe(c: Column) -> Column:
    """A leading formula sign is quoted."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def html_safe(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def table_cell(c: Column) -> Column:
    return F.replace(html_safe(c), F.lit("|"), F.lit("\\|"))


def snippet(text: Column, term: str, width: int = 80) -> Column:
    """The part of ``text`` around the first place of ``term``; its start if there is none."""
    at = F.greatest(F.instr(text, term) - width // 2, F.lit(1))
    return F.substring(text, at, F.lit(width))


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; Spark has no built-in form of it."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def round_half_even(s: pd.Series, digits: pd.Series) -> pd.Series:
    """Correctly rounded, ties of the binary value to even."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(s, digits, strict=True)], dtype=float)
