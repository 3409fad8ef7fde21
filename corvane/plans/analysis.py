"""Statistical questions and repository filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import dates as D
from corvane.operators.analysis import Filter, Request, analyse
from corvane.plans.catalogue import register
from corvane.repository import Filters, Publications
from corvane.sources.tables import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("analysis_row_count", "SELECT count(*)::BIGINT AS row_count FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(table(spark, sf_dir, "lineitem"), Request("row_count"))


@register(
    "analysis_describe",
    """SELECT count(l_extendedprice)::BIGINT AS count, count(*) FILTER (WHERE l_extendedprice IS NULL)::BIGINT AS missing_count,
  round(min(l_extendedprice), 3) AS minimum, round(max(l_extendedprice), 3) AS maximum, round(avg(l_extendedprice), 3) AS mean,
  round(median(l_extendedprice), 3) AS median, round(stddev_pop(l_extendedprice), 3) AS population_standard_deviation FROM lineitem""",
)
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyse(table(spark, sf_dir, "lineitem"), Request("describe_numeric", "l_extendedprice")), 3)


@register("analysis_group_count", 'SELECT l_returnflag AS "group", count(*)::BIGINT AS count FROM lineitem GROUP BY 1')
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(table(spark, sf_dir, "lineitem"), Request("group_count", group_by="l_returnflag"))


@register(
    "analysis_group_mean",
    """SELECT l_linestatus AS "group", count(l_discount)::BIGINT AS count, count(*) FILTER (WHERE l_discount IS NULL)::BIGINT AS missing_count,
  round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1""",
)
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyse(table(spark, sf_dir, "lineitem"), Request("group_mean", "l_discount", group_by="l_linestatus")))


@register(
    "analysis_pearson",
    """SELECT count(*) FILTER (WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL)::BIGINT AS paired_count,
  count(*) FILTER (WHERE p_size IS NULL OR p_retailprice IS NULL)::BIGINT AS missing_pair_count,
  round(corr(p_size, p_retailprice), 6) AS pearson_correlation, NULL::VARCHAR AS error FROM part""",
)
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyse(table(spark, sf_dir, "part"), Request("pearson_correlation", "p_size", "p_retailprice")))


for _name, _operator, _sql, _value in (
    ("eq", "equals", "=", 17.0),
    ("ne", "not_equals", "<>", 17.0),
    ("lt", "less_than", "<", 17.0),
    ("le", "less_than_or_equal", "<=", 17.0),
    ("gt", "greater_than", ">", 17.0),
    ("ge", "greater_than_or_equal", ">=", 17.0),
):

    @register(
        f"analysis_filter_{_name}",
        f"""SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM lineitem
WHERE l_quantity {_sql} {_value} AND l_linestatus = 'O' GROUP BY 1""",
    )
    def filtered(spark: SparkSession, sf_dir: str, operator: str = _operator, value: float = _value) -> DataFrame:
        filters = (Filter("l_quantity", operator, value), Filter("l_linestatus", "equals", "O"))
        rows = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate").cast("string"))
        return analyse(rows, Request("group_count", group_by="day", filters=filters)).toDF("day", "n")


def _publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated publications: every third one has only its year, every eleventh no date."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate")
    key = F.col("o_orderkey")
    dated = orders.select(
        key.alias("publication_id"),
        F.col("o_orderpriority").alias("publication_type"),
        F.col("o_custkey"),
        F.when((key % 3 != 0) & (key % 11 != 0), day).alias("published"),
        F.when(key % 11 != 0, F.year(day)).alias("filename_year"),
    )
    return dated.join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author")), "o_custkey")


_PUBLICATIONS = """publications AS (
  SELECT o_orderkey AS publication_id, o_orderpriority AS publication_type, c_name AS author,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS published,
    CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate)::INT END AS filename_year
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _repository(spark: SparkSession, sf_dir: str) -> Publications:
    rows = _publications(spark, sf_dir).withColumnRenamed("published", "publication_date")
    return Publications(rows.withColumn("authors", F.array("author")))


@register(
    "filter_authors_types_dates",
    f"""WITH {_PUBLICATIONS} SELECT publication_id, author FROM publications
WHERE publication_type IN ('1-URGENT', '2-HIGH') AND (contains(lower(author), '00001') OR contains(lower(author), '#000000042'))
  AND CASE WHEN published IS NOT NULL THEN published BETWEEN DATE '1996-03-15' AND DATE '1998-06-30'
      ELSE coalesce(filename_year BETWEEN 1996 AND 1998, FALSE) END""",
)
def filter_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Filters(["1-URGENT", "2-HIGH"], ["00001", "#000000042"], "1996-03-15", "1998-06-30")
    return _repository(spark, sf_dir).rows.filter(wanted.column()).select("publication_id", F.col("authors")[0].alias("author"))


@register(
    "recent_publications",
    f"""WITH {_PUBLICATIONS}, dated AS (SELECT *, coalesce(published - DATE '1970-01-01', make_date(filename_year, 1, 1) - DATE '1970-01-01', -1)::INT AS day FROM publications)
SELECT publication_id, publication_type, day FROM dated ORDER BY day DESC, publication_id LIMIT 50""",
)
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = D.effective_day(F.col("publication_date"), F.col("filename_year"))
    return _repository(spark, sf_dir).recent(50).select("publication_id", "publication_type", day.alias("day"))


@register(
    "distribution_by_year_type",
    f"""WITH {_PUBLICATIONS}, y AS (SELECT *, coalesce(year(published), filename_year)::INT AS y FROM publications)
SELECT 'year' AS kind, y::VARCHAR AS key, count(*)::BIGINT AS n FROM y WHERE y IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'type', publication_type, count(*)::BIGINT FROM y GROUP BY ALL
UNION ALL SELECT 'unknown_year', NULL, count(*)::BIGINT FROM y WHERE y IS NULL""",
)
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_both = _repository(spark, sf_dir).distribution().withColumnRenamed("year", "y")  # one pass over the data
    part = lambda kind, key, kept: (
        by_both.filter(kept).groupBy(F.lit(kind).alias("kind"), key.cast("string").alias("key")).agg(F.sum("n").alias("n"))
    )
    unknown = by_both.agg(F.coalesce(F.sum(F.when(F.col("y").isNull(), F.col("n"))), F.lit(0)).alias("n"))
    return (
        part("year", F.col("y"), F.col("y").isNotNull())
        .unionByName(part("type", F.col("publication_type"), F.lit(True)))
        .unionByName(unknown.select(F.lit("unknown_year").alias("kind"), F.lit(None).cast("string").alias("key"), "n"))
    )


@register(
    "temporal_backtest",
    f"""WITH {_PUBLICATIONS}, y AS (SELECT *, coalesce(year(published), filename_year)::INT AS y FROM publications)
SELECT count(*) FILTER (WHERE y <= 1998)::BIGINT AS input_count, count(*) FILTER (WHERE y > 1998)::BIGINT AS future_count,
  count(*) FILTER (WHERE y IS NULL)::BIGINT AS unknown_count, count(*) FILTER (WHERE y <= 1998 AND y > 1998)::BIGINT AS leaked_count FROM y""",
)
def temporal_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = D.effective_year(F.col("published"), F.col("filename_year"))
    side = F.when(y <= 1998, "input").when(y > 1998, "future").otherwise("unknown")
    rows = _publications(spark, sf_dir).select(y.alias("y"), side.alias("side"))
    return rows.agg(
        F.count_if(F.col("side") == "input").alias("input_count"),
        F.count_if(F.col("side") == "future").alias("future_count"),
        F.count_if(F.col("side") == "unknown").alias("unknown_count"),
        F.count_if((F.col("side") == "input") & (F.col("y") > 1998)).alias("leaked_count"),
    )


@register(
    "stratified_pool",
    """WITH s AS (SELECT o_orderkey, o_orderpriority AS p, year(o_orderdate)::INT AS y, o_totalprice FROM orders),
c AS (SELECT p, y, count(*) AS n, sum(count(*)) OVER () AS t FROM s GROUP BY p, y),
q AS (SELECT p, y, greatest(1, round_even(200.0::DOUBLE * n / t, 0))::BIGINT AS quota FROM c),
r AS (SELECT s.*, quota, row_number() OVER (PARTITION BY s.p, s.y ORDER BY o_totalprice DESC, o_orderkey) AS k FROM s JOIN q ON s.p = q.p AND s.y = q.y)
SELECT p AS stratum, y AS year, o_orderkey, quota FROM r WHERE k <= quota""",
)
def stratified_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proportional quota of each stratum, at least one, the largest first."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("stratum"), F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice"
    )
    sizes = rows.groupBy("stratum", "year").agg(F.count("*").alias("n"))
    total: Column = F.sum("n").over(Window.partitionBy(F.lit(0)))
    quota = F.greatest(F.lit(1), F.bround(F.lit(200.0) * F.col("n") / total)).cast("long")
    quotas = sizes.select("stratum", "year", quota.alias("quota"))
    order = Window.partitionBy("stratum", "year").orderBy(F.desc("o_totalprice"), "o_orderkey")
    # The constant bound lets each task drop rows beyond it before the shuffle.
    numbered = rows.withColumn("k", F.row_number().over(order)).filter("k <= 200")
    return numbered.join(quotas, ["stratum", "year"]).filter("k <= quota").select("stratum", "year", "o_orderkey", "quota")
