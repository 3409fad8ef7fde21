"""SparkSession factory used by tests, the benchmark and the entry module."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them (``__`` stands for a dot)."""
    builder = SparkSession.builder.master(master).appName("corvane")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}
    settings |= {key.replace("__", "."): value for key, value in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
