"""Quality rules: counts with fixed limits, then distribution divergence.

Each document gives two histograms: its characters by class and its common words. A reference for each
language is the mean of those of all its documents that the fixed limits let pass, each document
weighing the same, so that a few long ones do not set it. A document is
rejected if the Jensen-Shannon distance (base 2, 0 to 1) of a histogram to its language's reference is
over a limit, where the document is long enough for the distance to mean something.

References are a table of one row a language, of about 120 numbers, that is joined by language. It is broadcast while it
has at most ``BROADCAST_LANGUAGES`` rows; beyond that it is an equi-join, with the same result.

Edge cases: a null, empty or blank text has no words and fails the limit on words. A null language is a
language of its own. A language without documents that pass is judged by the reference of all; if
none pass, nothing is judged. Repeated rows are judged alike. Extra columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.storage import materialise

#: Common words, by language.
COMMON_WORDS = {
    "en": "the of and to in is that it as was for with be by on not he at this are or from an had which".split(),
    "fr": "le la de les des et est une un que qui dans pour pas sur au par avec ce ne se plus il en du".split(),
    "de": "der die das und ist nicht mit sich auf den dem ein eine zu von im für als auch es an werden aus er".split(),
    "es": "el la de que y en los un una por con no para se del las su al lo como más pero sus le".split(),
}
WORD_BINS = {w.encode(): i for i, w in enumerate(sorted({w for words in COMMON_WORDS.values() for w in words}))}
#: One bin for each common word, one for all other words.
N_WORD_BINS = len(WORD_BINS) + 1
#: Character classes: a-z, A-Z, digits, blanks, newlines, sentence marks, other ASCII marks, beyond ASCII, control.
N_CLASSES = 9
BROADCAST_LANGUAGES = 1024
#: Distances above which a document is rejected, and what it needs to be judged.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.325
MIN_CHARS = 250
MIN_WORDS = 80


def _class_of(byte: int) -> int:
    char = chr(byte)
    if byte >= 0x80:
        return 7 if byte >= 0xC0 else N_CLASSES  # a continuation byte is no character
    if char.islower() or char.isupper() or char.isdigit():
        return 0 if char.islower() else 1 if char.isupper() else 2
    if char in " \t\x0b\x0c\r":
        return 3
    if char == "\n":
        return 4
    if char in ".,;:!?'\"-()":
        return 5
    return 6 if 0x20 < byte < 0x7F else 8


_CLASS = np.array([_class_of(b) for b in range(256)])
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_BLANKS = [0x20, *range(0x09, 0x0E)]

#: Bins of each histogram.
_HISTOGRAMS = {"classes": N_CLASSES, "common": N_WORD_BINS}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in _COUNTS]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("classes", "common")]
)
_TYPE = pa.struct(
    [(n, pa.int64()) for n in _COUNTS]
    + [("classes", pa.list_(pa.int32())), ("common", pa.list_(pa.int32()))]
)


def measure(text: str | None) -> tuple:
    """The values of FEATURES for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, counts, N_CLASSES + 1)[:N_CLASSES].astype(np.int32)
    chars = int(counts[:0x80].sum() + counts[0xC0:].sum())
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        again = np.zeros(n, bool)
        hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        for i in range(3):
            again[i : i + len(hit)] |= hit
        repeated = int(again.sum())
    bins = [WORD_BINS[w] for w in words if w in WORD_BINS]
    common = np.bincount(np.array(bins, np.int64), minlength=N_WORD_BINS).astype(np.int32)
    common[-1] = n - len(bins)
    return (
        n,
        chars - int(counts[_BLANKS].sum()),
        int(counts[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeated,
        classes,
        common,
    )


def _measure_all(texts: pa.Array) -> pa.Array:
    columns = list(zip(*(measure(t.as_py()) for t in texts), strict=True)) or [[] for _ in range(7)]
    pa.default_memory_pool().release_unused()  # a worker waits for other tasks with what it holds
    arrays = [pa.array(c, t.type) for c, t in zip(columns, _TYPE, strict=True)]
    return pa.StructArray.from_arrays(arrays, fields=list(_TYPE))


#: Called nondeterministic so that the optimiser does not work it out again for a filter on its result.
_features = F.arrow_udf(_measure_all, FEATURES).asNondeterministic()


def base_failed(f: str) -> Column:
    return (F.col(f"{f}.n_words") < 50) | (F.col(f"{f}.n_repeat_words") * 100 > F.col(f"{f}.n_words") * 50)


def language_references(featured: DataFrame, lang: str, f: str) -> DataFrame:
    """Rows (lang_key, classes, common): summed shares of the documents of each language that pass the counts."""
    passing = featured.filter(~base_failed(f))
    # Shares in millionths: every document weighs the same, and whole numbers add up alike in any order.
    total = lambda name: F.aggregate(F.col(f"{f}.{name}"), F.lit(0).cast("long"), lambda a, v: a + v)
    passing = passing.withColumns({f"__{name}": F.greatest(total(name), F.lit(1)) for name in _HISTOGRAMS})
    share = lambda name, i: F.round(F.col(f"{f}.{name}")[i] * 1e6 / F.col(f"__{name}")).cast("long")
    sums = [F.array(*[F.sum(share(name, i)) for i in range(size)]).alias(name) for name, size in _HISTOGRAMS.items()]
    return materialise(passing.groupBy(_lang_key(lang).alias("lang_key")).agg(*sums), "quality-references")


def _lang_key(lang: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("null"))


def _shares(values: Column) -> Column:
    """A histogram as shares; null if it is empty."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
    shares = F.transform(
        F.filter(F.array(F.struct(total.alias("t"), values.alias("v"))), lambda s: s["t"] > 0),
        lambda s: F.transform(s["v"], lambda v: v / s["t"]),
    )
    return F.get(shares, F.lit(0))


def judge(featured: DataFrame, references: DataFrame, lang: str = "lang", f: str = "f") -> DataFrame:
    """Add base_failed, class_distance, word_distance and kept."""
    own = references.select("lang_key", F.col("classes").alias("__classes"), F.col("common").alias("__common"))
    pooled = references.agg(
        F.count("*").alias("n"),
        *[F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(name) for name, size in _HISTOGRAMS.items()],
    ).first()
    rest = [F.lit(None).cast("array<bigint>")] * 2
    if pooled["n"]:
        rest = [F.array(*[F.lit(v).cast("long") for v in pooled[k]]) for k in _HISTOGRAMS]
    if pooled["n"] <= BROADCAST_LANGUAGES:
        own = F.broadcast(own)
    joined = featured.join(own, _lang_key(lang) == F.col("lang_key"), "left")
    n_chars = F.aggregate(F.col(f"{f}.classes"), F.lit(0), lambda a, v: a + v)

    def distance(name: str, pooled_sums: Column) -> Column:
        doc = F.transform(F.col(f"{f}.{name}"), lambda v: v.cast("long"))
        p, q = _shares(doc), _shares(F.coalesce(F.col(f"__{name}"), pooled_sums))
        part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
        terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
        divergence = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2
        return F.sqrt(F.when(divergence > 0, divergence).when(divergence.isNotNull(), 0.0))

    far = ((n_chars >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col(f"{f}.n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    return (
        joined.withColumn("class_distance", distance("classes", rest[0]))
        .withColumn("word_distance", distance("common", rest[1]))
        .withColumn("base_failed", base_failed(f))
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
        .drop("lang_key", "__classes", "__common")
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were. Text is measured once, and written with what was
    measured, for the references and the verdict both need it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    featured = materialise(docs.select(row, F.col(f"`{lang}`").alias("__lang"), _features(F.col(f"`{text}`")).alias("__f")), "quality-features")
    judged = judge(featured, language_references(featured, "__lang", "__f"), "__lang", "__f")
    return judged.filter("kept").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    featured = materialise(docs.select("doc_id", "lang", _features(F.col("text")).alias("f")), "quality-features")
    judged = judge(featured, language_references(featured, "lang", "f"))
    return judged.select(
        "doc_id", *[f"f.{c}" for c in _COUNTS], "base_failed", "kept", "class_distance", "word_distance"
    )


#: The distances add up in an order that SQL does not fix; tests/llm holds the query against a brute-force version.
ORACLE_SQL = None
