"""Tools for golden question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as X
from corvane.sources.tables import pieces
from corvane.storage import materialise


#: Bytes of pages that are counted in one task, about: each page makes a row for every question that it shares a token with.
PAGES = 4 << 20
#: Members of a class that meet those of another in one row, about.
MEMBERS = 1 << 10


def jaccard_pairs(items: DataFrame, id_col: str, tokens: str, least: float) -> DataFrame:
    """Pairs (a, b, jaccard) with a < b. Items of equal sets are one class, and only classes are compared (see
    :func:`near_sets`); pairs of members are made last, from blocks of ``MEMBERS`` of both classes, so that the rows of a large
    class spread over the tasks."""
    sets = items.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("s")).filter((F.size("s") > 0) & F.col("id").isNotNull())
    sets = materialise(sets, "jaccard-sets")
    classes = materialise(sets.groupBy("s").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "jaccard-classes")
    near = near_sets(classes, least)
    own = classes.filter("n > 1").select(F.col("rep").alias("ra"), F.col("rep").alias("rb"), F.lit(1.0).alias("jaccard"))
    # One class of MEMBERS or more in each MEMBERS items at most.
    large = F.broadcast(classes.filter(F.col("n") > MEMBERS).select("rep", "n"))
    named = sets.join(classes.select("s", "rep"), "s").join(large, "rep", "left")
    block = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / MEMBERS)), F.lit(0))
    members = materialise(named.groupBy("rep", block.alias("block")).agg(F.collect_list("id").alias("ids")), "jaccard-members")
    side = lambda s: members.select(F.col("rep").alias(f"r{s}"), F.col("block").alias(f"block{s}"), F.col("ids").alias(f"ids{s}"))
    met = near.union(own).join(side("a"), "ra").join(side("b"), "rb").filter((F.col("ra") != F.col("rb")) | (F.col("blocka") <= F.col("blockb")))
    dealt = met.repartition("ra", "blocka", "rb", "blockb")
    each = dealt.select("jaccard", (F.col("ra") == F.col("rb")) & (F.col("blocka") == F.col("blockb")), F.explode("idsa").alias("x"), "idsb")
    each = each.toDF("jaccard", "same", "x", "idsb").select("jaccard", "same", "x", F.explode("idsb").alias("y"))
    return each.filter("x < y OR (NOT same AND x > y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def near_sets(classes: DataFrame, least: float) -> DataFrame:
    """(ra, rb, jaccard) of distinct sets (rep, s), ra < rb. Sets of Jaccard t share one of the rarest n - ceil(t n) + 1 tokens of each,
    so only these are joined on. Of sizes x and y they share t (x + y) / (1 + t) tokens or more: where a token stands in each
    tells how many there can be from it on. Nothing is lost."""
    each = classes.select("rep", F.size("s").alias("size"), F.explode("s").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    # Tokens by number, rare ones first: (count, number) orders them.
    counts = materialise(counts.select("token", F.struct("n", F.monotonically_increasing_id().alias("k")).alias("mark")), "jaccard-tokens")
    ranked = each.join(counts, "token").groupBy("rep", "size").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    ranked = materialise(ranked.select("rep", "size", F.transform("marks", lambda m: m["k"]).alias("r")), "jaccard-ranked")
    width = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9).cast("int") + 1
    heads = ranked.select("rep", "size", F.posexplode(F.slice("r", F.lit(1), width)).alias("at", "token"))
    side = lambda s: heads.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "size", "at")])
    # Up to the first common token all are different.
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    able = rest >= F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(least / (1 + least)) - 1e-6)
    found = side("a").join(side("b"), "token").filter((F.col("rep_a") < F.col("rep_b")) & able)
    pairs = found.select(F.col("rep_a").alias("ra"), F.col("rep_b").alias("rb")).distinct()
    sets = lambda s: ranked.select(F.col("rep").alias(f"r{s}"), F.col("r").alias(f"s{s}"))
    scored = pairs.join(sets("a"), "ra").join(sets("b"), "rb").withColumn("jaccard", X.jaccard(F.col("sa"), F.col("sb")))
    return scored.filter(F.col("jaccard") >= least).select("ra", "rb", "jaccard")


def page_proposals(questions: DataFrame, pages: DataFrame, top: int) -> DataFrame:
    """The pages that share most tokens with each question: (question, page, hits, place). Both sides have an id and
    ``tokens``; pages have ``size``. Shared tokens are counted after an equi-join on tokens. Pages are dealt out in pieces first,
    equal ones together: where the questions are small enough to be sent to them, all of a page is counted in the task that
    has it, a task counts its piece, however many there are, and only the best of each piece meet."""
    asked = questions.select("question", F.explode(F.array_distinct("tokens")).alias("token"))
    sets = pages.select("page", "size", F.array_distinct("tokens").alias("tokens"))
    dealt = sets.repartition(pieces(pages, PAGES), "page", "size")
    held = dealt.select("page", "size", F.explode("tokens").alias("token"))
    hits = held.join(asked, "token").groupBy("question", "page", "size").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("question").orderBy(F.desc("hits"), F.desc("size"), "page")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def map_labels(labels: DataFrame, known: DataFrame, label: str, name: str) -> DataFrame:
    """Names for labels: an equal one, else the only one that begins with the label or that the label begins with.

    (label, name, how): how is exact, prefix, ambiguous or unmapped. Prefixes are joined by their first ``key``
    characters, then compared."""
    asked = labels.select(F.col(label).alias("label"), X.canonical_text(F.col(label)).alias("l")).distinct()
    names = known.select(F.col(name).alias("name"), X.canonical_text(F.col(name)).alias("n")).filter("n <> ''").distinct()
    key = 3
    exact = asked.join(names, F.col("l") == F.col("n")).groupBy("label").agg(
        F.min("name").alias("name"), F.count_distinct("n").alias("k")
    )
    rest = asked.join(exact.select("label"), "label", "left_anti").filter(F.length("l") >= key)
    long_names = names.filter(F.length("n") >= key)
    both = rest.join(
        long_names,
        (F.substring("l", 1, key) == F.substring("n", 1, key))
        & (F.col("n").startswith(F.col("l")) | F.col("l").startswith(F.col("n"))),
    )
    prefix = both.groupBy("label").agg(F.min("name").alias("name"), F.count_distinct("n").alias("k"))
    found = exact.withColumn("how", F.lit("exact")).unionByName(
        prefix.withColumn("how", F.when(F.col("k") == 1, "prefix").otherwise("ambiguous"))
    )
    return asked.select("label").distinct().join(found, "label", "left").select(
        "label",
        F.when(F.col("how") != "ambiguous", F.col("name")).alias("name"),
        F.coalesce("how", F.lit("unmapped")).alias("how"),
    )
