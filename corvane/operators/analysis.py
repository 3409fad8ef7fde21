"""The fixed set of statistical questions about a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.ranking import values_at

OPERATIONS = ("row_count", "describe_numeric", "group_count", "group_mean", "pearson_correlation")
OPERATORS = ("equals", "not_equals", "less_than", "less_than_or_equal", "greater_than", "greater_than_or_equal")


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: object


@dataclass(frozen=True)
class Request:
    operation: str
    value_column: str | None = None
    second_value_column: str | None = None
    group_by: str | None = None
    filters: Sequence[Filter] = field(default_factory=tuple)


def _numeric(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.NumericType):
        raise ValueError(f"non_numeric_column: {column}")


def check(df: DataFrame, request: Request) -> None:
    """Reject unknown operations and columns, and columns of the wrong type, before anything runs."""
    if request.operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {request.operation}")
    named = [request.value_column, request.second_value_column, request.group_by, *[f.column for f in request.filters]]
    missing = sorted({n for n in named if n and n not in df.columns})
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")
    needs = {
        "row_count": (),
        "describe_numeric": ("value_column",),
        "group_count": ("group_by",),
        "group_mean": ("group_by", "value_column"),
        "pearson_correlation": ("value_column", "second_value_column"),
    }[request.operation]
    absent = [n for n in needs if getattr(request, n) is None]
    if absent:
        raise ValueError(f"{request.operation} needs {', '.join(absent)}")
    for n in needs:
        if n != "group_by":
            _numeric(df, getattr(request, n))
    for f in request.filters:
        if f.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {f.operator}")
        if f.operator not in ("equals", "not_equals"):
            _numeric(df, f.column)
            if isinstance(f.value, bool) or not isinstance(f.value, (int, float)):
                raise ValueError(f"ordering filter for {f.column} requires numeric values")


def condition(f: Filter) -> Column:
    """Null equals null; an ordering filter on a null value is an error."""
    c, value = F.col(f.column), F.lit(f.value)
    if f.operator == "equals":
        return c.eqNullSafe(value)
    if f.operator == "not_equals":
        return ~c.eqNullSafe(value)
    test = {
        "less_than": c < value,
        "less_than_or_equal": c <= value,
        "greater_than": c > value,
        "greater_than_or_equal": c >= value,
    }[f.operator]
    error = F.raise_error(F.lit(f"ordering filter for {f.column} requires numeric values")).cast("boolean")
    return F.when(c.isNotNull(), test).otherwise(error)


def analyse(df: DataFrame, request: Request) -> DataFrame:
    """The answer to ``request`` as rows."""
    check(df, request)
    rows = df
    for f in request.filters:
        rows = rows.filter(condition(f))
    value = F.col(request.value_column).cast("double") if request.value_column else None
    if request.operation == "row_count":
        return rows.agg(F.count("*").alias("row_count"))
    if request.operation == "describe_numeric":
        sums = rows.agg(
            F.count(value).alias("count"),
            F.count_if(value.isNull()).alias("missing_count"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("population_standard_deviation"),
        )
        # The two middle values, which are one if the count is odd: an exact median would gather all values in one buffer.
        last = F.col("n") - 1
        middle = values_at(rows.select(value.alias("value")), "value", [F.floor(last / 2), F.ceil(last / 2)])
        both = sums.crossJoin(middle.agg(F.avg("value").alias("median")))  # one row each
        return both.select("count", "missing_count", "minimum", "maximum", "mean", "median", "population_standard_deviation")
    if request.operation == "group_count":
        return rows.groupBy(F.col(request.group_by).alias("group")).agg(F.count("*").alias("count"))
    if request.operation == "group_mean":
        return rows.groupBy(F.col(request.group_by).alias("group")).agg(
            F.count(value).alias("count"), F.count_if(value.isNull()).alias("missing_count"), F.avg(value).alias("mean")
        )
    second = F.col(request.second_value_column).cast("double")
    both = value.isNotNull() & second.isNotNull()
    pair = lambda c: F.when(both, c)
    found = rows.agg(
        F.count_if(both).alias("paired_count"),
        F.count_if(~both).alias("missing_pair_count"),
        F.var_pop(pair(value)).alias("__v1"),
        F.var_pop(pair(second)).alias("__v2"),
        F.covar_pop(pair(value), pair(second)).alias("__c"),
    )
    fault = (
        F.when(F.col("paired_count") < 2, "insufficient_data")
        .when((F.col("__v1") == 0) | (F.col("__v2") == 0), "zero_variance")
    )
    return found.select(
        "paired_count",
        "missing_pair_count",
        F.when(fault.isNull(), F.try_divide("__c", F.sqrt(F.col("__v1")) * F.sqrt(F.col("__v2")))).alias("pearson_correlation"),
        fault.alias("error"),
    )
