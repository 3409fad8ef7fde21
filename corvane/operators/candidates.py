"""Near-duplicate candidates: title and question both near those of a candidate kept before.

Two texts with a Ratcliff-Obershelp ratio of r have matching blocks of M characters in all, 2M >= r (a + b) for lengths a
and b; what is left over parts them into at most (1 - r)(a + b) + 1 blocks. A block of n characters holds n - 2 pieces of
three, so near texts share at least ``(a + b)(r/2 - 2(1 - r)) - 2`` pieces, numbered by occurrence, or are equal. Of
texts that must share k of their n pieces, the n - k + 1 rarest of each hold a common one. Distinct titles are joined on such
pieces; then candidates of near titles are joined on title and rare piece of the question, so a title that
very many share does not pair them all. Lengths and counts of characters rule out most of what is found before a
ratio is worked out. Pairs whose shorter text has up to 64 characters are found by bits instead, in blocks (see
:mod:`corvane.operators.short_texts`): so short texts share most of their pieces with very many others.

Which candidates stay depends on their order: one stays unless an earlier one that stayed is near. It is settled
in rounds over the table of near pairs: who has no earlier unsettled neighbour stays, and settles those after it. No task
walks a group.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X
from corvane.operators.short_texts import WORD, possible_pairs
from corvane.storage import materialise

#: Fixed value: the ratio from which two titles, and two questions, are near.
NEAR = 0.9
PIECE = 3
#: Up to this length only equal texts have a ratio of 0.9.
EQUAL_ONLY = 4


@F.pandas_udf(T.DoubleType())
def ratio_from(later: pd.Series, earlier: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio of two texts, or null where it is below ``least``; upper bounds come first."""

    def one(a: str, b: str, r: float) -> float | None:
        if a == b:
            return 1.0
        m = SequenceMatcher(None, a, b)
        if m.real_quick_ratio() < r or m.quick_ratio() < r:
            return None
        found = m.ratio()
        return found if found >= r else None

    return pd.Series([one(a, b, r) for a, b, r in zip(later, earlier, least, strict=True)], dtype=float)


# So that a filter on the ratio does not have it worked out twice.
ratio_from = ratio_from.asNondeterministic()


def _needed(n: Column) -> Column:
    """How many pieces a text of length ``n`` shares with any near one at least, and one at the least: the bound at a ratio
    of 0.9, for the shortest partner that this ratio allows."""
    shortest = F.floor((9 * n + 10) / 11)
    return F.greatest(F.lit(1), F.floor((n + shortest - 5) / 4)).cast("int")


def _rare_pieces(texts: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """(key, out): hashes of each text's rarest pieces, as many as one that it shares with any near text must be among."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), n - (PIECE - 1))
    cut = F.when(n > EQUAL_ONLY, F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(PIECE)))).otherwise(
        F.array(F.concat(F.lit("="), F.col(text)))
    )
    counted = texts.select(key, n.alias("n"), F.explode(cut).alias("piece")).groupBy(key, "n", "piece").agg(F.count("*").alias("times"))
    numbered = counted.select(key, "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: F.xxhash64("piece", i))).alias("piece"))
    numbered = materialise(numbered, "candidate-pieces")
    common = numbered.groupBy("piece").agg(F.count("*").alias("texts"))
    listed = numbered.join(common, "piece").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("texts", "piece"))).alias("all"))
    kept = F.when(F.col("n") > EQUAL_ONLY, F.size("all") - _needed(F.col("n")) + 1).otherwise(1)
    return listed.select(key, F.slice(F.col("all.piece"), F.lit(1), F.greatest(kept, F.lit(1))).alias(out))


def _close(a: Column, b: Column, least: float) -> Column:
    """Whether lengths allow the ratio."""
    whole = F.length(a) + F.length(b)
    return (whole == 0) | (2.0 * F.least(F.length(a), F.length(b)) >= least * whole)


def near_pairs(heads: DataFrame, least: float = NEAR) -> DataFrame:
    """(earlier, later, title_ratio, question_ratio) of rows (place, t, q) whose t and q are both near; ``place`` is unique
    and orders them. ``least`` must be 0.9 or more."""
    if least < NEAR:
        raise ValueError("pieces are counted for ratios of 0.9 or more only")
    heads = materialise(heads.withColumn("id", F.monotonically_increasing_id()), "candidate-heads")
    titles = materialise(near_titles(heads.select("t").distinct(), least), "candidate-titles")
    links = titles.select(F.least("t", "of").alias("ga"), F.greatest("t", "of").alias("gb")).distinct()
    short = possible_pairs(heads.select("id", F.col("t").alias("g"), F.col("q").alias("text")), links, least)
    side = lambda s: heads.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("place", "t", "q")])
    sides = short.join(side("a"), "a").join(side("b"), "b")
    first = F.col("place_a") < F.col("place_b")
    turned = lambda c, name, away: F.when(first != F.lit(away), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(name)
    found = sides.select(
        turned("place", "earlier", False), turned("t", "of", False), turned("q", "xq", False), turned("place", "later", True), turned("t", "t", True), turned("q", "yq", True)
    )
    found = found.join(titles, ["t", "of"]).select("earlier", "later", "xq", "yq", "title_ratio")
    near = found.union(_long_pairs(heads, titles, least)).withColumn("question_ratio", ratio_from(F.col("yq"), F.col("xq"), F.lit(least)))
    return near.filter("question_ratio IS NOT NULL").select("earlier", "later", "title_ratio", "question_ratio")


def _long_pairs(heads: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """(earlier, later, xq, yq, title_ratio) of rows of near titles that share a rare piece of their long questions."""
    heads = heads.filter(F.length("q") > WORD)
    question = _rare_pieces(heads.select("q").distinct(), "q", "q", "qp")
    rows = materialise(heads.join(question, "q"), "candidate-rare")
    earlier = rows.select(F.col("place").alias("earlier"), F.col("t").alias("of"), F.col("q").alias("xq"), F.col("qp").alias("xp"), F.explode("qp").alias("piece"))
    later = rows.join(titles, "t").select(
        F.col("place").alias("later"), "of", "title_ratio", F.col("q").alias("yq"), F.col("qp").alias("yp"), F.explode("qp").alias("piece")
    )
    # A pair is found at each piece that it shares and taken at the first.
    first = F.col("piece") == F.array_min(F.array_intersect("xp", "yp"))
    able = (F.col("earlier") < F.col("later")) & _close(F.col("xq"), F.col("yq"), least)
    return earlier.join(later, ["of", "piece"]).filter(able & first).select("earlier", "later", "xq", "yq", "title_ratio")


def near_titles(titles: DataFrame, least: float) -> DataFrame:
    """(t, of, title_ratio): for each title those that it is near to, itself among them. A ratio may change with the order
    of the two texts, so both orders are looked at."""
    numbered = materialise(titles.withColumn("id", F.monotonically_increasing_id()), "title-numbers")
    alone = titles.sparkSession.range(1).select(F.lit(0).alias("ga"), F.lit(0).alias("gb"))
    short = possible_pairs(numbered.select("id", F.lit(0).alias("g"), F.col("t").alias("text")), alone, least)
    side = lambda i, name: numbered.select(F.col("id").alias(i), F.col("t").alias(name))
    short = short.join(side("a", "x"), "a").join(side("b", "y"), "b")
    short = short.select(F.explode(F.array(F.struct(F.col("x").alias("t"), F.col("y").alias("of")), F.struct(F.col("y").alias("t"), F.col("x").alias("of")))).alias("p"))
    keyed = _rare_pieces(titles.filter(F.length("t") > WORD), "t", "t", "tp").select("t", F.explode("tp").alias("piece"))
    long = keyed.join(keyed.withColumnRenamed("t", "of"), "piece").filter((F.col("t") != F.col("of")) & _close(F.col("t"), F.col("of"), least))
    pairs = short.select("p.*").union(long.select("t", "of").distinct()).withColumn("title_ratio", ratio_from(F.col("t"), F.col("of"), F.lit(least)))
    own = titles.select("t", F.col("t").alias("of"), F.lit(1.0).alias("title_ratio"))
    return pairs.filter("title_ratio IS NOT NULL").union(own)


def settle(pairs: DataFrame) -> DataFrame:
    """(place): all that do not stay, of pairs (earlier, later). Each round settles whoever has no unsettled neighbour
    before it, which stays, and those after it, which go; a pair is forgotten when one of its ends is settled."""
    left = materialise(pairs.select("earlier", "later"), "candidate-pairs")
    gone = left.select(F.col("later").alias("place")).limit(0)
    while not left.isEmpty():
        heads = left.select(F.col("earlier").alias("place")).join(left.select(F.col("later").alias("place")), "place", "left_anti").distinct()
        heads = materialise(heads, "candidate-stay")
        out = left.join(heads.withColumnRenamed("place", "earlier"), "earlier", "left_semi").select(F.col("later").alias("place")).distinct()
        out = materialise(out, "candidate-gone")
        gone = gone.union(out)
        # Pairs of one that stays are all of one that goes, too.
        rest = left.join(out.withColumnRenamed("place", "later"), "later", "left_anti")
        left = materialise(rest.join(out.withColumnRenamed("place", "earlier"), "earlier", "left_anti"), "candidate-pairs")
    return gone


def owners(pairs: DataFrame) -> DataFrame:
    """(place, owner) of all that do not stay, of stored pairs (earlier, later): the first that stays and is near."""
    gone = materialise(settle(pairs), "candidate-out")
    stay = pairs.join(gone.withColumnRenamed("place", "earlier"), "earlier", "left_anti").groupBy(F.col("later").alias("place"))
    return stay.agg(F.min("earlier").alias("owner")).join(gone, "place", "left_semi")


def drop_near_duplicates(
    candidates: DataFrame, id_col: str, title: str, question: str, order: list[str], least: float = NEAR
) -> DataFrame:
    """(id_col, kept, duplicate_of): candidates in the order of ``order`` and then of their id; each stays unless title and question both
    have a ratio of ``least`` or more with those of one that stayed before. ``duplicate_of`` is the first such one.

    Null texts are empty; two empty texts are equal. Ids are unique and not null. Null order values come first. Candidates whose canonical texts are equal are
    settled by the first of them. An empty table gives an empty result; other columns are not read.
    """
    # A place that orders rows by itself: the order's values and the id, compared as a struct.
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"))
    text = lambda c: X.canonical_text(F.coalesce(F.col(c), F.lit("")))
    rows = materialise(candidates.select(place.alias("place"), text(title).alias("t"), text(question).alias("q")), "candidates")
    firsts = rows.groupBy("t", "q").agg(F.min("place").alias("place"))
    pairs = materialise(near_pairs(firsts, least), "candidate-near")
    heads = firsts.join(owners(pairs), "place", "left").select("t", "q", F.col("place").alias("head"), F.coalesce("owner", "place").alias("owner"))
    judged = rows.join(heads, ["t", "q"])
    stays = F.col("place") == F.col("owner")
    return judged.select(
        F.col("place.id").alias(id_col), stays.alias("kept"), F.when(~stays, F.col("owner.id")).alias("duplicate_of")
    )
