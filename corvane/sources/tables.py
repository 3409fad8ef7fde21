"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes below which a table is dealt out evenly after the scan.
SMALL = 256 << 20
#: Bytes of a file that one task gets where a larger table is dealt out, about.
PIECE = 16 << 20
#: Pieces of a table; estimates that are none.
MOST_PIECES, UNKNOWN = 1 << 15, 1 << 50


def pieces(df: DataFrame, size: int) -> int:
    """The number of pieces of about ``size`` bytes of a table by the planner's estimate: one a core at least, ``MOST_PIECES`` at
    most. Where the planner knows no size, the number of shuffle partitions."""
    total = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if total >= UNKNOWN:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_PIECES, max(df.sparkSession.sparkContext.defaultParallelism, -(-total // size)))


def spread(df: DataFrame) -> DataFrame:
    """A table over all cores. A row group is read by one task, which would then work on it alone. Small files often have one;
    so may large ones, which the number of rows in each split of the scan tells: it comes from the footers. A large table with
    row groups enough is left as it is. Filters and columns still reach the scan."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size < SMALL:
        return df.repartition(cores)
    splits = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count("*").alias("n"))
    most, rows = splits.agg(F.max("n"), F.sum("n")).first()
    uneven = rows and most * cores > 2 * rows
    return df.repartition(max(cores, -(-size // PIECE))) if uneven else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
