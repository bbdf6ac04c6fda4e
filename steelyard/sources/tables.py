"""The given tables, and the annual facts that the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY

METRICS = ("revenue", "operating_cost", "income_tax", "steel_sales_volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's customers in a year: ``project_id, period``, exact sums of the lines ordered, and
    ``comparable``, which holds while at most a third of the lines came back."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    ext, disc, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    total = lambda x: F.sum(x).cast(MONEY)
    return lines.groupBy(F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("project_id"), F.year("o_orderdate").cast("string").alias("period")).agg(
        total(ext).alias("revenue"), total(ext * (1 - disc)).alias("operating_cost"), total(ext * tax).alias("income_tax"),
        total(F.col("l_quantity").cast("decimal(12,2)")).alias("steel_sales_volume"),
        (F.count_if(F.col("l_returnflag") == "R") * 3 <= F.count("*")).alias("comparable"),
    )


#: The same in SQL, as a common table expression.
ANNUAL_SQL = """
lines AS (SELECT 'P' || c_nationkey AS project_id, CAST(year(o_orderdate) AS VARCHAR) AS period, CAST(l_extendedprice AS DECIMAL(12,2)) AS ext,
                 CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax, CAST(l_quantity AS DECIMAL(12,2)) AS qty, l_returnflag
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
annual AS (SELECT project_id, period, CAST(sum(ext) AS DECIMAL(20,6)) AS revenue, CAST(sum(ext * (1 - disc)) AS DECIMAL(20,6)) AS operating_cost,
                  CAST(sum(ext * tax) AS DECIMAL(20,6)) AS income_tax, CAST(sum(qty) AS DECIMAL(20,6)) AS steel_sales_volume,
                  count(*) FILTER (l_returnflag = 'R') * 3 <= count(*) AS comparable
           FROM lines GROUP BY 1, 2)"""


def facts(wide: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Long facts of :func:`annual`: ``fact_id, project_id, metric_key, period, value, comparable, status``.

    The volume of every seventh project and year isn't reported.
    """
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    out = wide.selectExpr("project_id", "period", "comparable", f"stack({len(metrics)}, {pairs}) AS (metric_key, value)")
    hidden = (F.col("metric_key") == "steel_sales_volume") & ((F.substring("project_id", 2, 9).cast("int") + F.col("period").cast("int")) % 7 == 0)
    out = out.where(~hidden).withColumn("fact_id", F.concat_ws("-", "project_id", "metric_key", "period"))
    return out.select("fact_id", "project_id", "metric_key", "period", "value", "comparable", F.lit("validated").alias("status"))


FACTS_SQL = ANNUAL_SQL + """,
facts AS (SELECT project_id || '-' || metric_key || '-' || period AS fact_id, project_id, metric_key, period, value, comparable, 'validated' AS status
          FROM (SELECT project_id, period, comparable, unnest(['revenue', 'operating_cost', 'income_tax', 'steel_sales_volume']) AS metric_key,
                       unnest([revenue, operating_cost, income_tax, steel_sales_volume]) AS value FROM annual)
          WHERE NOT (metric_key = 'steel_sales_volume' AND (CAST(substr(project_id, 2) AS INT) + CAST(period AS INT)) % 7 = 0))"""


def projects(wide: DataFrame) -> DataFrame:
    """Each project with its declared years: all from the first of the table to the last."""
    bounds = wide.agg(F.min(F.col("period").cast("int")).alias("a"), F.max(F.col("period").cast("int")).alias("b"))
    years = F.transform(F.sequence("a", "b"), lambda y: y.cast("string"))
    return wide.select("project_id").distinct().crossJoin(F.broadcast(bounds)).select("project_id", years.alias("fiscal_years"))
