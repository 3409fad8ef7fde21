"""Invariants as tables of the rows that break them; an empty table means that all hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENTITY_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
CHECKSUM = r"^[0-9a-f]{64}$"


def broken(df: DataFrame, name: str, holds: Column) -> DataFrame:
    return df.filter(~F.coalesce(holds, F.lit(False))).withColumn("expectation", F.lit(name))


def valid_ids(df: DataFrame, column: str) -> DataFrame:
    return broken(df, f"{column} is an id", F.col(column).rlike(ENTITY_ID))


def in_bounds(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return broken(df, f"{column} lies in [{low}, {high}]", F.col(column).between(low, high))


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that come more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1").withColumn("expectation", F.lit("unique key"))


def covered(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Values that the known table lacks."""
    return df.join(known.select(F.col(known_column).alias(column)), column, "left_anti").withColumn(
        "expectation", F.lit(f"{column} is known")
    )


def spans_cover(df: DataFrame, spans: str, text: str) -> DataFrame:
    """Half-open spans follow each other from 0 to the end of the text."""
    starts, stops = F.col(f"{spans}.start"), F.col(f"{spans}.stop")
    joined = F.concat(F.array(F.lit(0)), stops)
    expect = F.concat(starts, F.array(F.length(text)))
    return broken(df, "spans cover the text", joined == expect)


def increasing(df: DataFrame, group: Sequence[str], column: str, by: Sequence[str]) -> DataFrame:
    """Rows whose value is not above the one before, in the order of ``by`` within the group; null values do not count."""
    order = Window.partitionBy(*group).orderBy(*by)
    before = df.withColumn("__before", F.lag(column).over(order))
    return before.filter(F.col("__before") >= F.col(column)).drop("__before").withColumn("expectation", F.lit("strict order"))


def require(violations: DataFrame) -> None:
    row = violations.limit(1).collect()
    if row:
        raise ValueError(f"{row[0]['expectation']}: {row[0].asDict()}")
