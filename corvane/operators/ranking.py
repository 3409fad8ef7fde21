"""Ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.storage import materialise


def rank_all(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Add contiguous ranks from 1 by a total order. Rows are range-sorted and numbered within their range; a table of
    one row a range gives where each range starts. A plain window would sort everything in one task."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.orderBy(*order).select("*", F.spark_partition_id().alias("__range"), local.alias("__local"))
    placed = materialise(placed, "ranked")
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = placed.join(F.broadcast(starts), "__range")
    return joined.withColumn(out, F.col("__start") + F.col("__local") + 1).drop("__range", "__local", "__start")


def cumulated_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, lo, hi) of each distinct value that is not null: how many rows are below it, and how many are not above
    it. Rows are counted by value, values are range-sorted, and a table of one row a range gives where each range starts: no
    task holds all values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("__n"))
    placed = materialise(counts.repartitionByRange("value").withColumn("__range", F.spark_partition_id()), "value-counts")
    sizes = placed.groupBy("__range").agg(F.sum("__n").alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    upto = F.sum("__n").over(Window.partitionBy("__range").orderBy("value"))
    inside = placed.withColumn("__upto", upto).join(starts, "__range")
    hi = F.col("__start") + F.col("__upto")
    return inside.select("value", (hi - F.col("__n")).alias("lo"), hi.alias("hi"))


def values_at(df: DataFrame, column: str, places: list[Column]) -> DataFrame:
    """(place, value): for each of ``places`` (from 0, expressions of ``n``) the value of the sorted column there. ``n`` is
    the number of rows whose value is not null; without any there is no row."""
    counts = materialise(cumulated_counts(df, column), "cumulated")
    total = counts.agg(F.max("hi").alias("n"))
    asked = total.filter("n > 0").select(F.posexplode(F.array(*[p.cast("long") for p in places])).alias("place", "at"))
    # One row a place: a few, whatever the table.
    return counts.join(F.broadcast(asked), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("place", "value")


def top_ranked(df: DataFrame, order: list[Column], limit: int, out: str = "rank") -> DataFrame:
    """The first ``limit`` rows with ranks from 1: each task keeps its own first rows, so the window sees few."""
    return df.orderBy(*order).limit(limit).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def best_per_group(df: DataFrame, group: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group by ``order``, as an aggregate that combines before the shuffle. ``order`` holds
    ascending, non-null expressions."""
    return df.groupBy(*group).agg(
        F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__best")
    ).select(*group, "__best.*")
