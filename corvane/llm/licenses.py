"""License scans by diagonal voting.

All rolling word pairs of every text are joined by their hash to the pairs of a table of templates. A
pair at word p of the text that is pair q of a template votes for the diagonal p - q: the place where
the template would begin. Votes are added up by diagonal where the text is read, before anything
moves. Neighbouring diagonals, a word dropped or put in, are merged, and a span is accepted if it
holds enough of its template. Votes count only if the words are equal, not just their hash, so a
diagonal with all its pairs is the whole phrase, word for word.

The templates are constants of this module or of the caller's, of two words or more: a phrase, or a whole license text.
They are broadcast: at most ``MAX_PAIRS`` pairs, a proven bound, beyond which they are joined by an exchange. Before pairs are
put together, words that no template's pair begins with are left out: a text without any costs no strings.

Edge cases: a null text is empty: no words, no places. Overlapping places all count. Repeated rows get
equal results. Words are letters, digits and everything beyond ASCII, with A-Z lower-cased, so ``CC-BY``
is the words cc and by. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
#: (label, phrase) of the phrases that are counted by place.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: (label, text) of the notices that the method adds.
NOTICES = (
    ("apache", "licensed under the apache license version"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
)
#: Share of a notice's pairs that a span must hold, and words by which neighbouring diagonals may differ.
LEAST_SHARE = 0.8
MAX_SHIFT = 2
#: Pairs of templates up to which they are broadcast, and first words up to which they are a literal set.
MAX_PAIRS, MAX_FIRST = 200_000, 2000
_END = "\x00"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_rows(phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> list[tuple]:
    """Rows (pair, template, place, label, n_pairs, base); template -1 is the end of every text."""
    rows = [(_END, -1, 0, "", 1, False)]
    for number, (label, text) in enumerate([*phrases, *notices]):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {text}")
        pairs = [" ".join(p) for p in zip(words, words[1:], strict=False)]
        rows += [(p, number, i, label, len(pairs), number < len(phrases)) for i, p in enumerate(pairs)]
    return rows


def words_of(text: Column) -> Column:
    # lower() also folds letters beyond ASCII, which no template holds; only the Kelvin sign would become ASCII.
    low = F.when(text.contains("\u212a"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(WORD), F.lit(0))


def word_pairs(words: Column, first: Sequence[str]) -> Column:
    """Structs (at, said): each word of ``first`` with the next word, then a closing mark whose position is the number
    of words. Without ``first``, all words."""
    join = lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit("")))
    pair = lambda a, b: F.when(a.isin(list(first)), join(a, b)) if first else join(a, b)
    # Arrays go through lambdas as arguments, worked out once; an array that a lambda mentions is made for every element.
    said = F.concat(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), pair), F.array(F.lit(_END)))
    placed = F.transform(said, lambda p, i: F.when(p.isNotNull(), F.struct(i.alias("at"), p.alias("said"))))
    return F.filter(placed, lambda p: p.isNotNull())


def scan_licenses(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Columns (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of
    ``docs``. ``score`` is the largest share of a template's pairs that a span holds."""
    spark = docs.sparkSession
    table = _template_rows(phrases, notices)
    templates = spark.createDataFrame(
        table, "pair string, template int, place int, label string, n_pairs int, base boolean"
    ).withColumn("hash", F.xxhash64("pair"))
    # Words are a column of their own: a generator would work out its argument once for each mention.
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("own"), words_of(F.col(text)).alias("words"))
    begins = {r[0].split(" ")[0] for r in table[1:]}
    begins = sorted(begins) if len(begins) <= MAX_FIRST else []
    pairs = split.withColumn("pairs", word_pairs(F.col("words"), begins))
    # Never empty; the outer form, because a plain explode has its argument worked out again for a filter on its size.
    pairs = pairs.select("id", "own", F.explode_outer("pairs").alias("p"))
    rows = pairs.select("id", "own", "p.at", "p.said")
    known = templates if len(table) > MAX_PAIRS else F.broadcast(templates)
    votes = (
        rows.join(known, F.xxhash64("said") == F.col("hash"))
        .filter("said = pair")
        .select(
            "id",
            "own",
            "template",
            (F.col("at") - F.col("place")).alias("diagonal"),
            F.shiftright("place", 6).alias("word"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63))).alias("bit"),
        )
    )
    # The places of a template that a diagonal holds, 64 to a word.
    diagonals = votes.groupBy("id", "own", "template", "diagonal", "word").agg(
        F.bit_or("bit").alias("held"), F.count("*").alias("n")
    )
    about = templates.select("template", "label", "n_pairs", "base").distinct()
    placed = diagonals.repartition("id", "own").join(F.broadcast(about), "template")
    one = Window.partitionBy("id", "own", "template")
    along, whole = one.orderBy("diagonal"), Window.partitionBy("id", "own", "template", "diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MAX_SHIFT, F.lit(True))
    words = (
        placed.withColumn("new", apart.cast("int"))
        .withColumn("span", F.sum("new").over(along))
        .withColumn("whole", (F.sum(F.bit_count("held")).over(whole) == F.col("n_pairs")) & F.col("base") & (F.col("word") == 0))
        .groupBy("id", "own", "template", "span", "label", "n_pairs", "base", "word")
        .agg(
            F.bit_or("held").alias("held"),
            F.count_if("whole").alias("places"),
            F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first"),
            F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last"),
            F.max("diagonal").alias("diagonal"),
            F.max("n").alias("n"),
        )
    )
    spans = words.groupBy("id", "own", "template", "span", "label", "n_pairs", "base").agg(
        F.sum(F.bit_count("held")).alias("held"),
        *[how(c).alias(c) for how, c in ((F.sum, "places"), (F.min, "first"), (F.max, "last"), (F.max, "diagonal"), (F.max, "n"))],
    )
    end = F.col("template") == -1
    share = F.when(end, 0.0).otherwise(F.col("held") / F.col("n_pairs"))
    held = F.when(F.col("base"), F.col("places") > 0).otherwise(~end & (share >= LEAST_SHARE))
    joined = lambda what: F.array_join(F.array_sort(F.collect_set(F.when(what, F.col("label")))), ",")
    found = spans.groupBy("id", "own").agg(
        F.max(F.when(end, F.col("diagonal"))).cast("long").alias("n_words"),
        F.max(F.when(end, F.col("n"))).alias("copies"),
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(F.col("base") & held).alias("base_labels"),
        joined(held).alias("labels"),
        F.max(share).alias("score"),
    )
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: SQL would repeat the voting itself; tests/llm holds the query against a brute-force version.
ORACLE_SQL = None
