"""Mixing sources to target weights with a time-varying curriculum.

Each source gets a target number of words. Its documents form a stream in hash order that is passed
over up to ``max_epochs`` times, until the target is met. The source's weight over training time
u in [0, 1] is a piecewise linear schedule; its integral is the source's cumulative demand. A copy
that starts at word c of its source's stream is trained on when cumulative demand reaches c, so the
inverse of the integral gives its training position, and a range sort by position gives the order of
training. The schedules shape when a source is read, its target how much of it.

Whole documents are taken. In the last pass a document is taken if its middle lies before the end of
the target, so a source's words differ from its target by at most half of one document.

Edge cases: a null text has size 0; a null source is a source of its own, the last one; a null id is
hashed like an empty one. Rows with the same id are separate documents, told apart by source and text; rows equal in
all three meet the plan in the order of a hash of all their columns. Documents of size 0 take no
words. Empty tables give empty results; extra columns pass through ``mix_documents`` untouched. Targets are made in one
task from one row a source: fit for sources in the thousands, not for every host as a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.prefix_sums import hash_digits, running_total
from corvane.storage import materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: (time, weight) knots by the order of the sources, repeating: read early, evenly, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, demand: tuple[int, int] = (3, 2), max_epochs: int = 2
) -> DataFrame:
    """Targets per source from columns (source_key, size): demand[0] / demand[1] of all sizes shared
    by weight, no target above ``max_epochs`` times its source's size, the excess reshared by weight.

    With sources in rising order of cap / weight, let share_i be what a unit of weight gets if the
    sources before i stop at their caps. It rises while the next source is capped and falls after
    that, so the largest share is the final one. One row per source; sums are whole numbers, so
    each target is one exactly rounded division.
    """
    up, down = demand
    by_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), order % len(weights) + 1)
    sources = by_source.withColumn("source_order", order).withColumn("weight", weight)
    cap = F.col("source_size") * max_epochs
    by_need = Window.orderBy(cap / F.col("weight"), "source_key")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = sources.withColumn(
        "left_over",
        F.sum("source_size").over(whole) * up - F.coalesce(F.sum(cap).over(before), F.lit(0)) * down,
    ).withColumn("unit", F.sum("weight").over(onward) * down)
    share = F.max_by(F.struct("left_over", "unit"), F.col("left_over") / F.col("unit")).over(whole)
    level = (F.col("weight") * F.col("share.left_over")).cast("double") / F.col("share.unit")
    return shares.withColumn("share", share).select(
        "source_key",
        "source_order",
        "source_size",
        F.least(cap.cast("double"), level).alias("target"),
    )


def time_of(demand_share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Training time at which a piecewise linear schedule has given ``demand_share`` of its area."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total = sum(areas)
    if total <= 0 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from time 0 to 1 and has a positive area")
    found, done = None, 0.0
    for (start, left), (stop, right), area in zip(knots, knots[1:], areas, strict=False):
        slope = (right - left) / (stop - start) / total
        rest = F.greatest(demand_share - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit((left / total) ** 2) + F.lit(2 * slope) * rest, F.lit(0.0)))
        below = F.lit(left / total) + root
        inside = F.lit(start) + F.when(below > 0, F.lit(2.0) * rest / below).otherwise(F.lit(0.0))
        done += area / total
        here = F.when(demand_share <= F.lit(done), inside)
        found = here if found is None else F.coalesce(found, here)
    return F.least(F.coalesce(found, F.lit(1.0)), F.lit(1.0))


def plan_mix(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    demand: tuple[int, int] = (3, 2),
    max_epochs: int = 2,
) -> DataFrame:
    """Columns (doc_id, source, size, mark, ...) of ``sizes`` with source_size, target, copies, taken and
    positions (one for each copy). ``sizes`` is narrow: it holds no text. ``mark`` is a hexadecimal
    hash that orders a source's stream."""
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    rows = materialise(sizes.withColumn("source_key", key), "mix-sizes")
    targets = source_targets(rows, weights, demand, max_epochs)
    placed = running_total(
        rows, ["source_key"], "mark", ["doc_id", "size"], F.col("size"), "offset", hash_digits(rows.count())
    )
    joined = placed.join(targets, "source_key")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    extra = (F.col("offset") * 2 + F.col("size")).cast("double") <= rest * 2
    copies = F.least(F.col("passes") + F.when(extra & (F.col("size") > 0), 1).otherwise(0), F.lit(max_epochs))
    order = F.col("source_order") % len(schedules)

    def position(share: Column) -> Column:
        found = F.when(order == 0, time_of(share, schedules[0]))
        for i, knots in enumerate(schedules[1:], 1):
            found = found.when(order == i, time_of(share, knots))
        return found

    words = F.col("offset").cast("double") + F.col("size") / F.lit(2.0)
    share = lambda copy: F.least((copy * F.col("source_size") + words) / F.col("target"), F.lit(1.0))
    positions = F.when(
        F.col("copies") > 0,
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda copy: position(share(copy))),
    ).otherwise(F.array().cast("array<double>"))
    return (
        joined.withColumn("passes", passes)
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .withColumn("positions", positions)
        .drop("source_key", "source_order", "offset", "passes")
    )


def _mark(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as the mix takes it, sorted
    by training position. The plan is made from a narrow table; text moves twice, to meet the plan
    and to be sorted."""
    own = F.xxhash64(F.col("text"))
    narrow = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        own.alias("__own"),
        _mark(F.col("doc_id"), own).alias("mark"),
    )
    # Both sides number equal rows alike: all of them, before any is dropped, by a total order.
    key = [F.col("__id"), F.col("__own")]
    planned = plan_mix(narrow, **options).select(F.struct("doc_id", "source").alias("__id"), "__own", "copies", "positions")
    plan = planned.withColumn(
        "__row", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies"), "positions"))
    ).filter("copies > 0")
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumns({"__id": F.struct("doc_id", "source"), "__own": own}).withColumn(
        "__row", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*hashable)))
    )
    # Rows equal in id, source and text are told apart by number; as a residual condition it needs no other exchange.
    mixed = rows.alias("d").join(
        plan.alias("p"),
        (F.col("d.__id") == F.col("p.__id"))
        & (F.col("d.__own") == F.col("p.__own"))
        & (F.col("d.__row") <= F.col("p.__row"))
        & (F.col("d.__row") >= F.col("p.__row")),
    )
    copies = mixed.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode("p.positions").alias("__position"))
    return copies.orderBy("__position", "doc_id").drop("__position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, by its first training position."""
    size = word_count(F.col("text"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", size.alias("size"))
    plan = plan_mix(docs.withColumn("mark", _mark(F.col("doc_id"), F.col("size"))))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9)
    result = plan.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"))
    return result.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
marked AS (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS mark FROM sizes),
by_source AS (
  SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) - 1 AS o FROM sizes GROUP BY k),
weighted AS (SELECT *, [5, 2, 1][(o % 3 + 1)::INT]::BIGINT AS w FROM by_source),
shares AS (
  SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY (2.0::DOUBLE * source_size) / w, k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         2 * sum(w) OVER (ORDER BY (2.0::DOUBLE * source_size) / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM weighted),
level AS (SELECT arg_max(left_over, left_over::DOUBLE / unit) AS l, arg_max(unit, left_over::DOUBLE / unit) AS u FROM shares),
targets AS (
  SELECT k, o, source_size, least((2 * source_size)::DOUBLE, (w * l)::DOUBLE / u::DOUBLE) AS target FROM shares, level),
placed AS (
  SELECT m.*, t.o, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY k ORDER BY mark, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM marked m JOIN targets t USING (k)),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS p FROM placed),
taken AS (
  SELECT *, least(p + CASE WHEN size > 0 AND (off * 2 + size)::DOUBLE <= (target - p * source_size) * 2 THEN 1 ELSE 0 END, 2)::BIGINT AS copies
  FROM passed),
timed AS (
  SELECT *, CASE WHEN copies > 0 THEN least((off::DOUBLE + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) END AS q,
         CASE o % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a FROM taken)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
       CASE WHEN copies > 0 THEN round(least(
         2.0::DOUBLE * q / (a + sqrt(a * a + 2.0::DOUBLE * (2.0::DOUBLE - 2.0::DOUBLE * a) * q)), 1.0::DOUBLE), 9) END AS first_position
FROM timed
"""
