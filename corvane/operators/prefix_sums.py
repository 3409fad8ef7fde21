"""Running totals inside groups of any size.

A plain window over a group sorts the whole group in one task. Here each group is cut into buckets
by the leading digits of a uniform hexadecimal hash; bucket totals are added up over a table of a
few rows per group, and only the rows of one bucket are ever sorted together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_digits(n_rows: int, rows_per_bucket: int = 20_000, least: int = 2) -> int:
    """Leading hexadecimal digits that leave about ``rows_per_bucket`` rows in a bucket."""
    if n_rows <= rows_per_bucket:
        return least
    return max(least, math.ceil(math.log(n_rows / rows_per_bucket, 16)))


def running_total(
    df: DataFrame,
    group: list[str],
    hash_col: str,
    order: list[str],
    value: Column,
    out: str,
    digits: int,
    compact: DataFrame | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come earlier by
    (``hash_col``, ``order``). Group columns and the hash must not be null. ``compact`` may be a
    narrower version of ``df`` with the same rows, from which the bucket totals are taken. ``bucket`` may stand for the
    leading digits: it rises with ``hash_col`` and holds few rows of a group."""
    bucket = F.substring(F.col(hash_col), 1, digits) if bucket is None else bucket
    totals = (
        (compact if compact is not None else df)
        .groupBy(*group, bucket.alias("__bucket"))
        .agg(F.sum(value).alias("__total"))
    )
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = (
        Window.partitionBy(*group, "__bucket").orderBy(hash_col, *order).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = df.withColumn("__bucket", bucket).withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.join(bases, [*group, "__bucket"])
    return joined.withColumn(out, F.col("__base") + F.col("__inside")).drop("__bucket", "__base", "__inside")
