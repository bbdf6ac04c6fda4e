"""Queries on facts: grid, growth, ratios, derived metrics, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY
from steelyard.operators import checks, derived, grid, ratios
from steelyard.sources.tables import ANNUAL_SQL, FACTS_SQL, METRICS, annual, facts, projects, table


def _double(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = annual(spark, sf_dir)
    metrics = spark.createDataFrame([(m,) for m in METRICS], "metric_key string")
    found = facts(wide).withColumns({"restated": F.lit(False), "created_at": F.lit("")})
    return grid.grid(projects(wide), metrics, found)


def fact_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.grid_growth(_cells(spark, sf_dir))
    return out.select("project_id", "metric_key", "period", "value", "comparable", "status", *_double("change"), "change_dir", "change_refused")


GRID_SQL = FACTS_SQL + """,
years AS (SELECT CAST(unnest(range(min(CAST(period AS INT)), max(CAST(period AS INT)) + 1)) AS VARCHAR) AS period FROM annual),
cells AS (SELECT p.project_id, m.metric_key, y.period, f.value, coalesce(f.comparable, true) AS comparable, coalesce(f.status, 'not_found') AS status
          FROM (SELECT DISTINCT project_id FROM annual) p CROSS JOIN (SELECT unnest(['revenue', 'operating_cost', 'income_tax', 'steel_sales_volume']) AS metric_key) m
          CROSS JOIN years y LEFT JOIN facts f ON f.project_id = p.project_id AND f.metric_key = m.metric_key AND f.period = y.period)"""
FACT_GRID_SQL = f"""
WITH {GRID_SQL},
l AS (SELECT *, lag(value) OVER w AS p, lag(period) OVER w AS pp, lag(comparable) OVER w AS pc FROM cells WINDOW w AS (PARTITION BY project_id, metric_key ORDER BY period)),
r AS (SELECT *, CASE WHEN NOT comparable OR NOT coalesce(pc, true) THEN 'incomparable' WHEN p IS NULL OR value IS NULL THEN 'missing'
                     WHEN CAST(period AS INT) - CAST(pp AS INT) <> 1 THEN 'gap' WHEN p = 0 THEN 'zero_base' WHEN p < 0 THEN 'negative_base' END AS code FROM l),
c AS (SELECT *, CASE WHEN pp IS NOT NULL AND code IS NULL THEN round_even(CAST((value - p) / abs(p) AS DECIMAL(38,18)), 4) END AS ch FROM r)
SELECT project_id, metric_key, period, value, comparable, status, CAST(ch AS DOUBLE) AS change,
       CASE WHEN abs(ch) <= 0.01 THEN 'flat' WHEN ch > 0 THEN 'up' WHEN ch < 0 THEN 'down' END AS change_dir,
       CASE WHEN pp IS NOT NULL THEN code END AS change_refused FROM c
"""


def verified_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.verified(facts(annual(spark, sf_dir))).select("fact_id", "value")


def filled_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.filled_years(_cells(spark, sf_dir))


def period_gap_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth against the previous year that is there, with each project's every fourth year left out."""
    wide = annual(spark, sf_dir).where((F.substring("project_id", 2, 9).cast("int") + F.col("period").cast("int")) % 4 != 0)
    out = ratios.series_yoy(wide.select("project_id", "period", F.col("revenue").alias("value")), ["project_id"])
    return out.select("project_id", "period", "value", F.col("yoy.value").cast("double").alias("yoy"), F.col("yoy.refused").alias("refused"))


GAP_SQL = f"""
WITH {ANNUAL_SQL},
s AS (SELECT project_id, period, revenue AS value FROM annual WHERE (CAST(substr(project_id, 2) AS INT) + CAST(period AS INT)) % 4 <> 0),
l AS (SELECT *, lag(value) OVER w AS p, lag(period) OVER w AS q FROM s WINDOW w AS (PARTITION BY project_id ORDER BY period)),
r AS (SELECT *, CASE WHEN q IS NULL THEN 'first' WHEN CAST(period AS INT) - CAST(q AS INT) <> 1 THEN 'gap' WHEN p = 0 THEN 'zero_base' WHEN p < 0 THEN 'negative_base' END AS refused FROM l)
SELECT project_id, period, value, CAST(CASE WHEN refused IS NULL THEN round_even(CAST((value - p) / abs(p) AS DECIMAL(38,18)), 4) END AS DOUBLE) AS yoy, refused FROM r
"""


def ratio_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax by quantity that came back, in each project and year; where nothing came back it is refused."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = lines.groupBy(F.col("l_suppkey").alias("project_id"), F.year("o_orderdate").cast("string").alias("period")).agg(
        F.sum(F.col("l_tax").cast("decimal(4,2)")).cast(MONEY).alias("num"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("decimal(12,2)")).otherwise(0)).cast(MONEY).alias("den"))
    r = ratios.ratio(F.col("num"), F.col("den"), "tax / returned", 100)
    return sums.select("project_id", "period", r["value"].cast("double").alias("value"), r["refused"].alias("refused"))


RATIO_SQL = """
WITH s AS (SELECT l_suppkey AS project_id, CAST(year(o_orderdate) AS VARCHAR) AS period, sum(CAST(l_tax AS DECIMAL(4,2))) AS num,
                  sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(12,2)) ELSE 0 END) AS den
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT project_id, period, CAST(CASE WHEN den <> 0 THEN round_even(CAST(num / den AS DECIMAL(38,18)) * 100, 4) END AS DOUBLE) AS value,
       CASE WHEN den = 0 THEN 'zero_denominator' END AS refused FROM s
"""


def margin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margins; odd years disclose the profit, even ones leave it to revenue less cost."""
    wide = annual(spark, sf_dir).withColumn("gross_profit", F.when(F.col("period").cast("int") % 2 == 1, F.col("revenue") - F.col("operating_cost")).cast(MONEY))
    out = ratios.margin_series(wide, ["project_id", "period"])
    return out.select("project_id", "period", "profit", "origin", F.col("margin.value").cast("double").alias("margin"), F.col("margin.refused").alias("refused"))


MARGIN_SQL = f"""
WITH {ANNUAL_SQL}
SELECT project_id, period, CAST(revenue - operating_cost AS DECIMAL(20,6)) AS profit, CASE WHEN CAST(period AS INT) % 2 = 1 THEN 'disclosed' ELSE 'derived' END AS origin,
       CAST(CASE WHEN revenue > 0 THEN round_even(CAST((revenue - operating_cost) / revenue AS DECIMAL(38,18)) * 100, 4) END AS DOUBLE) AS margin,
       CASE WHEN revenue < 0 THEN 'negative_revenue' WHEN revenue = 0 THEN 'zero_denominator' END AS refused FROM annual
"""


def derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derived.derive(grid.verified(facts(annual(spark, sf_dir))))
    return out.select("project_id", "period", "metric_key", "unit", *_double("value"), "refused")


_REFUSED = {s.key: s.refused or "missing" for s in derived.SPECS if s.key not in ("gross_profit", "gross_margin", "steel_gross_profit_per_ton")}
_UNITS = {s.key: s.unit for s in derived.SPECS}
DERIVED_SQL = f"""
WITH {FACTS_SQL},
w AS (SELECT project_id, period, max(value) FILTER (metric_key = 'revenue') AS revenue, max(value) FILTER (metric_key = 'operating_cost') AS cost,
             max(value) FILTER (metric_key = 'steel_sales_volume') AS tons FROM facts WHERE comparable GROUP BY 1, 2),
d AS (SELECT project_id, period, 'gross_profit' AS metric_key, 'million' AS unit, CAST(revenue - cost AS DOUBLE) AS value, NULL AS refused FROM w
      UNION ALL SELECT project_id, period, 'gross_margin', 'percent', CAST(CASE WHEN revenue <> 0 THEN round_even(CAST((revenue - cost) / revenue AS DECIMAL(38,18)) * 100, 6) END AS DOUBLE),
             CASE WHEN revenue = 0 THEN 'zero_denominator' END FROM w
      UNION ALL SELECT project_id, period, 'steel_gross_profit_per_ton', 'yuan_per_ton', CAST(CASE WHEN tons <> 0 THEN round_even(CAST((revenue - cost) / tons AS DECIMAL(38,18)) * 1000000, 6) END AS DOUBLE),
             CASE WHEN tons IS NULL THEN 'missing' WHEN tons = 0 THEN 'zero_denominator' END FROM w
      {" ".join(f"UNION ALL SELECT project_id, period, '{k}', '{_UNITS[k]}', NULL, '{v}' FROM w" for k, v in _REFUSED.items())})
SELECT * FROM d
"""


def derived_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of profits, disclosed in odd years alone, with empty cells filled where that is possible."""
    wide = annual(spark, sf_dir)
    profit = wide.where("cast(period AS int) % 2 = 1").select("project_id", F.lit("gross_profit").alias("metric_key"), "period", (F.col("revenue") - F.col("operating_cost")).cast(MONEY).alias("value"), F.lit("validated").alias("status"), F.lit(True).alias("comparable"), F.lit("f").alias("fact_id"), F.lit(False).alias("restated"), F.lit("").alias("created_at"))
    cells = grid.grid(projects(wide), spark.createDataFrame([("gross_profit",)], "metric_key string"), profit)
    out = derived.fill(cells, derived.derive(grid.verified(facts(wide)), ["gross_profit"]))
    return out.select("project_id", "metric_key", "period", "value", "status")


DERIVED_GRID_SQL = f"""
WITH {GRID_SQL}
SELECT c.project_id, 'gross_profit' AS metric_key, c.period,
       CASE WHEN CAST(c.period AS INT) % 2 = 1 OR a.comparable THEN CAST(a.revenue - a.operating_cost AS DECIMAL(20,6)) END AS value,
       CASE WHEN a.revenue IS NULL THEN 'not_found' WHEN CAST(c.period AS INT) % 2 = 1 THEN 'validated' WHEN a.comparable THEN 'derived' ELSE 'not_found' END AS status
FROM cells c LEFT JOIN annual a ON a.project_id = c.project_id AND a.period = c.period WHERE c.metric_key = 'revenue'
"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by customer and year whose identities hold for some and fail for others."""
    orders = table(spark, sf_dir, "orders")
    total = F.col("o_totalprice").cast("decimal(12,2)")
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, total)).cast(MONEY)
    return orders.groupBy(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").cast("string").alias("period")).agg(
        F.sum(total).cast(MONEY).alias("total_assets"), part("F").alias("total_liabilities"), part("O").alias("equity_parent"), part("P").alias("minority_interest"),
        F.min(total).cast(MONEY).alias("cash_begin"), (F.max(total) - F.min(total)).cast(MONEY).alias("cash_net_increase"), F.max(total).cast(MONEY).alias("cash_end"),
        (F.min("o_orderpriority") < "4").alias("total_assets_ok"))


def reconcile_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checks.run_checks(_statements(spark, sf_dir), ["company_id", "period"])
    return out.select("company_id", "period", "rule_key", "severity", "status", "lhs", "rhs", "diff", "tolerance", F.array_join("inputs", "+").alias("inputs"))


RECONCILE_CTE = """
s AS (SELECT o_custkey AS company_id, CAST(year(o_orderdate) AS VARCHAR) AS period, CAST(sum(t) AS DECIMAL(20,6)) AS assets, CAST(sum(t) FILTER (o_orderstatus = 'F') AS DECIMAL(20,6)) AS debt,
             CAST(sum(t) FILTER (o_orderstatus = 'O') AS DECIMAL(20,6)) AS own, CAST(sum(t) FILTER (o_orderstatus = 'P') AS DECIMAL(20,6)) AS minority,
             CAST(min(t) AS DECIMAL(20,6)) AS c0, CAST(max(t) - min(t) AS DECIMAL(20,6)) AS c1, CAST(max(t) AS DECIMAL(20,6)) AS c2, min(o_orderpriority) < '4' AS ok
      FROM (SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS t FROM orders) GROUP BY 1, 2),
b AS (SELECT company_id, period, 'balance_sheet' AS rule_key, 'error' AS severity, assets AS lhs, CAST(debt + own + minority AS DECIMAL(20,6)) AS rhs,
             CAST(greatest(abs(assets), abs(debt), abs(own + minority)) * 0.005 AS DECIMAL(20,6)) AS tolerance, ok,
             'total_assets+total_liabilities' || CASE WHEN own + minority IS NOT NULL THEN '+equity_parent+minority_interest' ELSE '' END AS inputs FROM s
      UNION ALL SELECT company_id, period, 'cash_rollforward', 'error', CAST(c0 + c1 AS DECIMAL(20,6)), c2, CAST(greatest(abs(c0), abs(c1), abs(c2)) * 0.005 AS DECIMAL(20,6)), true, 'cash_begin+cash_net_increase+cash_end' FROM s
      UNION ALL SELECT company_id, period, 'cash_components', 'warn', NULL, NULL, NULL, true, 'cash_net_increase+cfo+cfi+cff' FROM s
      UNION ALL SELECT company_id, period, 'gross_profit', 'info', NULL, NULL, NULL, true, 'gross_profit+revenue+operating_cost' FROM s),
c AS (SELECT *, CASE WHEN lhs IS NULL OR rhs IS NULL THEN 'skipped_missing_data' WHEN NOT ok THEN 'skipped_incomparable' WHEN abs(lhs - rhs) <= tolerance THEN 'passed' ELSE 'failed' END AS status FROM b)"""
RECONCILE_SQL = f"""
WITH {RECONCILE_CTE}
SELECT company_id, period, rule_key, severity, status, CASE WHEN status IN ('passed', 'failed') THEN lhs END AS lhs, CASE WHEN status IN ('passed', 'failed') THEN rhs END AS rhs,
       CASE WHEN status IN ('passed', 'failed') THEN CAST(lhs - rhs AS DECIMAL(20,6)) END AS diff, CASE WHEN status IN ('passed', 'failed') THEN tolerance END AS tolerance, inputs FROM c
"""


def checks_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.summary(checks.run_checks(_statements(spark, sf_dir), ["company_id", "period"]), ["period"])


SUMMARY_SQL = f"""
WITH {RECONCILE_CTE}
SELECT period, count(*) AS total, count(*) FILTER (status IN ('passed', 'failed')) AS evaluable, count(*) FILTER (status = 'passed') AS passed,
       count(*) FILTER (status = 'failed' AND severity = 'error') AS failed_hard, count(*) FILTER (status = 'failed' AND severity <> 'error') AS failed_soft,
       count(*) FILTER (status = 'skipped_missing_data') AS skipped_missing, count(*) FILTER (status = 'skipped_incomparable') AS skipped_incomparable FROM c GROUP BY period
"""


def reconcile_order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's price against the sum of its lines, within half a percent of the larger."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast(MONEY).alias("rhs"))
    out = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lhs = F.col("o_totalprice").cast(MONEY)
    diff, allowed, holds = checks.compare(lhs, F.col("rhs"), [lhs, F.col("rhs")], checks.TOLERANCE)
    status = F.when(F.col("rhs").isNull(), checks.MISSING).when(holds, checks.PASSED).otherwise(checks.FAILED)
    return out.select("o_orderkey", diff.alias("diff"), F.when(F.col("rhs").isNotNull(), allowed).alias("allowed"), status.alias("status"))


ORDER_SQL = """
WITH l AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(20,6)) AS rhs FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,6)) AS lhs, rhs FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, CAST(lhs - rhs AS DECIMAL(20,6)) AS diff, CASE WHEN rhs IS NOT NULL THEN CAST(greatest(abs(lhs), abs(rhs)) * 0.005 AS DECIMAL(20,6)) END AS allowed,
       CASE WHEN rhs IS NULL THEN 'skipped_missing_data' WHEN abs(lhs - rhs) <= CAST(greatest(abs(lhs), abs(rhs)) * 0.005 AS DECIMAL(20,6)) THEN 'passed' ELSE 'failed' END AS status FROM o
"""


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def unreadable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as if they were figures, and sizes that are: what can't be read is reported."""
    part = table(spark, sf_dir, "part")
    shown = part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("raw"))
    return checks.unreadable(shown, "raw")


QUERIES = {
    "fact_grid": (fact_grid, FACT_GRID_SQL),
    "verified_view": (verified_view, f"WITH {FACTS_SQL} SELECT fact_id, value FROM facts WHERE status = 'validated' AND comparable"),
    "filled_years": (filled_years, f"WITH {GRID_SQL} SELECT project_id, metric_key, count(value) AS filled, count(*) AS declared FROM cells GROUP BY 1, 2"),
    "period_gap_refusal": (period_gap_refusal, GAP_SQL),
    "ratio_guarded": (ratio_guarded, RATIO_SQL),
    "margin_series": (margin_series, MARGIN_SQL),
    "derived_metrics": (derived_metrics, DERIVED_SQL),
    "derived_grid": (derived_grid, DERIVED_GRID_SQL),
    "reconcile_statements": (reconcile_statements, RECONCILE_SQL),
    "checks_summary": (checks_summary, SUMMARY_SQL),
    "reconcile_order_total": (reconcile_order_total, ORDER_SQL),
    "duplicate_keys": (duplicate_keys, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "unreadable_values": (unreadable_values, "SELECT p_partkey, p_name AS raw FROM part WHERE p_partkey % 5 = 0"),
}
