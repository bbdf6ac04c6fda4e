"""Queries on quantiles, cycle normalization, quality, verdicts, index and scenarios."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY
from steelyard.operators import index, quality, quantiles, verdicts
from steelyard.sources.tables import ANNUAL_SQL, annual, table


def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts of each part type at a quarter, half and three quarters of the quantity."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select("p_type", F.col("l_discount").cast("decimal(4,2)").alias("v"), (F.col("l_quantity").cast("decimal(12,2)") - 3).alias("w"))
    return quantiles.weighted_quantiles(x, ["p_type"], "v", "w", {"p25": "0.25", "mid": "0.5", "p75": "0.75"})


WEIGHTED_SQL = """
WITH x AS (SELECT p_type, CAST(l_discount AS DECIMAL(4,2)) AS v, sum(CAST(l_quantity AS DECIMAL(12,2)) - 3) AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 3 GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY p_type ORDER BY v) AS c, sum(w) OVER (PARTITION BY p_type) AS t FROM x)
SELECT p_type, min(v) FILTER (c >= 0.25 * t) AS p25, min(v) FILTER (c >= 0.5 * t) AS mid, min(v) FILTER (c >= 0.75 * t) AS p75 FROM c GROUP BY 1
"""


def interpolated_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return quantiles.interpolated_quantile(x, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "mid": 0.5, "p90": 0.9})


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ext, disc = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    swing = (F.dayofmonth("o_orderdate") % 10 - 4) * F.lit("0.01").cast("decimal(4,2)")
    return lines.groupBy(F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("project_id"), (2015 + F.dayofmonth("o_orderdate") % 10).cast("string").alias("period")).agg(
        F.sum(ext).cast(MONEY).alias("revenue"), F.sum(ext * (disc + swing)).cast(MONEY).alias("ebit"), (F.count_if(F.col("l_returnflag") == "R") * 100 <= F.count("*") * 38).alias("comparable"))


CYCLE_SQL = """
lines AS (SELECT 'P' || c_nationkey AS project_id, day(o_orderdate) % 10 AS k, CAST(l_extendedprice AS DECIMAL(12,2)) AS ext, CAST(l_discount AS DECIMAL(4,2)) AS disc, l_returnflag
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
y AS (SELECT project_id, 2015 + k AS y, CAST(sum(ext) AS DECIMAL(20,6)) AS revenue, CAST(sum(ext * (disc + (k - 4) * CAST(0.01 AS DECIMAL(4,2)))) AS DECIMAL(20,6)) AS ebit,
             count(*) FILTER (l_returnflag = 'R') * 100 <= count(*) * 38 AS comparable FROM lines GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN revenue > 0 THEN round_even(CAST(ebit / revenue AS DECIMAL(38,18)), 6) END AS margin, max(y) OVER (PARTITION BY project_id) AS last FROM y)"""


def cycle_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantiles.normalize(_cycle(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("double") for c in ("mid", "p25", "p75")}).drop("variant")


NORMALIZE_SQL = f"""
WITH {CYCLE_SQL},
a AS (SELECT * FROM (VALUES ('primary_8y', 0, 8, 7), ('fallback_10y', 1, 10, 8)) t(mode, k, span, need)),
w AS (SELECT m.*, mode, k, need, comparable AND margin IS NOT NULL AS inc FROM m JOIN a ON last - y < span),
c AS (SELECT project_id, mode, margin, sum(revenue) OVER (PARTITION BY project_id, mode ORDER BY margin) AS c, sum(revenue) OVER (PARTITION BY project_id, mode) AS t FROM w WHERE inc),
q AS (SELECT project_id, mode, min(margin) FILTER (c >= 0.5 * t) AS mid, min(margin) FILTER (c >= 0.25 * t) AS p25, min(margin) FILTER (c >= 0.75 * t) AS p75 FROM c GROUP BY 1, 2),
s AS (SELECT w.project_id, w.mode, k, need, CAST(min(y) AS INT) AS start, CAST(max(y) AS INT) AS "end", count(*) AS years, count(*) FILTER (inc) AS comparable_years,
             count(*) FILTER (inc AND margin >= mid + 0.02) AS high, count(*) FILTER (inc AND margin <= mid - 0.02) AS low, any_value(mid) AS mid, any_value(p25) AS p25, any_value(p75) AS p75
      FROM w LEFT JOIN q ON q.project_id = w.project_id AND q.mode = w.mode GROUP BY 1, 2, 3, 4),
v AS (SELECT *, CASE WHEN comparable_years < need THEN 'insufficient_data' WHEN high = 0 OR low = 0 THEN 'incomplete_cycle' ELSE 'normalized' END AS status FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN status = 'normalized' THEN k ELSE 100 - k END) AS n FROM v)
SELECT project_id, mode, start, "end", years, comparable_years, high, low, status, CAST(CASE WHEN status = 'normalized' THEN mid END AS DOUBLE) AS mid,
       CAST(CASE WHEN status = 'normalized' THEN p25 END AS DOUBLE) AS p25, CAST(CASE WHEN status = 'normalized' THEN p75 END AS DOUBLE) AS p75 FROM b WHERE n = 1
"""


def cycle_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quantiles.cycle_years(_cycle(spark, sf_dir), 8)
    return out.withColumns({c: F.col(c).cast("double") for c in ("margin", "weight")})


CYCLE_YEARS_SQL = f"""
WITH {CYCLE_SQL},
w AS (SELECT *, comparable AND margin IS NOT NULL AS included FROM m WHERE last - y < 8),
c AS (SELECT project_id, margin, sum(revenue) OVER (PARTITION BY project_id ORDER BY margin) AS c, sum(revenue) OVER (PARTITION BY project_id) AS t FROM w WHERE included),
q AS (SELECT project_id, min(margin) FILTER (c >= 0.5 * t) AS mid FROM c GROUP BY 1)
SELECT w.project_id, CAST(y AS VARCHAR) AS period, CAST(margin AS DOUBLE) AS margin, included,
       CAST(CASE WHEN included THEN round_even(CAST(revenue / sum(CASE WHEN included THEN revenue END) OVER (PARTITION BY w.project_id) AS DECIMAL(38,18)), 6) END AS DOUBLE) AS weight,
       CASE WHEN included THEN CASE WHEN margin >= mid + 0.02 THEN 'high' WHEN margin <= mid - 0.02 THEN 'low' ELSE 'normal' END END AS phase
FROM w LEFT JOIN q ON q.project_id = w.project_id
"""


def two_period_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a year's average tax balance over its revenue."""
    x = annual(spark, sf_dir)
    w = Window.partitionBy("project_id").orderBy("period")
    days = quality.turnover_days(F.col("income_tax"), F.lag("income_tax").over(w), F.col("revenue"))
    return x.select("project_id", "period", days.cast("double").alias("days"))


def _receivables(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = annual(spark, sf_dir)
    status = F.when(F.col("comparable"), "confirmed").otherwise("pending")
    return x.select("project_id", "period", F.col("income_tax").alias("receivable"), (F.col("revenue") - F.col("operating_cost")).cast(MONEY).alias("over_one_year"), (F.col("revenue") / 100).cast(MONEY).alias("revenue"), status.alias("status"))


def pairwise_deterioration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.receivables(_receivables(spark, sf_dir), ["project_id"])
    return out.select("project_id", "period", *[F.col(c).cast("double").alias(c) for c in ("days", "days_before", "share", "share_before")], "blocked", "triggered")


RECEIVABLES_CTE = f"""{ANNUAL_SQL},
x AS (SELECT project_id, period, income_tax AS r, CAST(revenue - operating_cost AS DECIMAL(20,6)) AS o, CAST(revenue / 100 AS DECIMAL(20,6)) AS f, CASE WHEN comparable THEN 'confirmed' ELSE 'pending' END AS status FROM annual),
l AS (SELECT *, lag(r) OVER w AS r1, coalesce(lag(r, 2) OVER w, lag(r) OVER w) AS r2, lag(o) OVER w AS o1, lag(f) OVER w AS f1, lag(period) OVER w AS p1, lag(status) OVER w AS s1 FROM x WINDOW w AS (PARTITION BY project_id ORDER BY period)),
d AS (SELECT *, CASE WHEN f > 0 THEN round_even(CAST(CAST((r + r1) / 2 * 365 AS DECIMAL(20,6)) / f AS DECIMAL(38,18)), 6) END AS days, CASE WHEN f1 > 0 THEN round_even(CAST(CAST((r1 + r2) / 2 * 365 AS DECIMAL(20,6)) / f1 AS DECIMAL(38,18)), 6) END AS days_before,
             CASE WHEN r > 0 THEN round_even(CAST(o / r AS DECIMAL(38,18)), 6) END AS share, CASE WHEN r1 > 0 THEN round_even(CAST(o1 / r1 AS DECIMAL(38,18)), 6) END AS share_before FROM l),
b AS (SELECT *, CASE WHEN p1 IS NULL OR CAST(period AS INT) - CAST(p1 AS INT) <> 1 THEN 'no_prior' WHEN status <> 'confirmed' OR s1 <> 'confirmed' THEN 'not_confirmed'
                     WHEN days IS NULL OR days_before IS NULL OR share IS NULL OR share_before IS NULL THEN 'no_figures' END AS blocked FROM d)"""
PAIRWISE_SQL = f"""
WITH {RECEIVABLES_CTE}
SELECT project_id, period, CAST(days AS DOUBLE) AS days, CAST(days_before AS DOUBLE) AS days_before, CAST(share AS DOUBLE) AS share, CAST(share_before AS DOUBLE) AS share_before, blocked,
       CASE WHEN blocked IS NULL THEN days - days_before > 10 AND share - share_before > 0.005 END AS triggered FROM b
"""


def quality_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist of each project from its pairs of years; an item that isn't confirmed leaves it open."""
    pairs = quality.receivables(_receivables(spark, sf_dir), ["project_id"]).where("coalesce(blocked, '') <> 'no_prior'")
    state = F.when(F.col("triggered"), "triggered").when(F.col("blocked").isNull(), "clear").when(F.col("period").cast("int") % 2 == 0, "not_applicable").otherwise("insufficient")
    out = quality.checklist(pairs.select("project_id", F.concat(F.lit("q"), F.col("period").cast("int") % 3).alias("item"), state.alias("state")), ["project_id"])
    return out.select("project_id", "component.numerator", "component.denominator", F.col("component.value").cast("double").alias("value"), "component.verified")


QUALITY_SQL = f"""
WITH {RECEIVABLES_CTE},
s AS (SELECT project_id, 'q' || CAST(period AS INT) % 3 AS item, CASE WHEN blocked IS NULL THEN CASE WHEN days - days_before > 10 AND share - share_before > 0.005 THEN 3 ELSE 1 END WHEN CAST(period AS INT) % 2 = 0 THEN 0 ELSE 2 END AS k
      FROM b WHERE blocked IS NULL OR blocked <> 'no_prior'),
i AS (SELECT project_id, item, max(k) AS k FROM s GROUP BY 1, 2),
g AS (SELECT project_id, count(*) FILTER (k = 3) AS numerator, count(*) FILTER (k IN (1, 3)) AS denominator, count(*) FILTER (k = 2) AS p FROM i GROUP BY 1)
SELECT project_id, numerator, denominator, CAST(CASE WHEN denominator > 0 AND p = 0 THEN round_even(CAST(numerator / denominator AS DECIMAL(38,18)), 6) END AS DOUBLE) AS value, denominator > 0 AND p = 0 AS verified FROM g
"""


def inventory_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = annual(spark, sf_dir).select("project_id", "period", F.col("income_tax").alias("inventory"), (F.col("operating_cost") / 100).cast(MONEY).alias("cost"), F.col("steel_sales_volume").alias("volume"))
    out = quality.inventory(x, ["project_id"])
    return out.select("project_id", *[F.col(c).cast("double").alias(c) for c in ("days", "days_before", "volume_change")], "state")


INVENTORY_SQL = f"""
WITH {ANNUAL_SQL},
r AS (SELECT project_id, income_tax AS i, CAST(operating_cost / 100 AS DECIMAL(20,6)) AS c, steel_sales_volume AS v, row_number() OVER (PARTITION BY project_id ORDER BY period DESC) AS n FROM annual),
x AS (SELECT project_id, max(i) FILTER (n = 1) AS i1, max(i) FILTER (n = 2) AS i2, max(i) FILTER (n = 3) AS i3, max(c) FILTER (n = 1) AS c1, max(c) FILTER (n = 2) AS c2, max(v) FILTER (n = 1) AS v1, max(v) FILTER (n = 2) AS v2, count(*) FILTER (n <= 3) AS years FROM r GROUP BY 1),
d AS (SELECT *, CASE WHEN c1 > 0 THEN round_even(CAST(CAST((i1 + i2) / 2 * 365 AS DECIMAL(20,6)) / c1 AS DECIMAL(38,18)), 2) END AS days, CASE WHEN c2 > 0 THEN round_even(CAST(CAST((i2 + i3) / 2 * 365 AS DECIMAL(20,6)) / c2 AS DECIMAL(38,18)), 2) END AS before,
             CASE WHEN v2 > 0 THEN round_even(CAST((v1 - v2) / v2 AS DECIMAL(38,18)), 6) END AS ch FROM x)
SELECT project_id, CAST(days AS DOUBLE) AS days, CAST(before AS DOUBLE) AS days_before, CAST(ch AS DOUBLE) AS volume_change,
       CASE WHEN years < 3 THEN 'insufficient' WHEN ch IS NULL THEN 'not_applicable' WHEN days IS NULL OR before IS NULL THEN 'insufficient' WHEN days - before > 10 AND ch < -0.01 THEN 'triggered' ELSE 'clear' END AS state FROM d
"""


def cash_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' runs of years with falling sales beside a positive balance."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("s"))
    w = Window.partitionBy("o_custkey").orderBy("y")
    x = o.withColumn("cfo", F.col("s") - F.lag("s").over(w)).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return quality.cash_streak(x, ["o_custkey"], "y", "cfo", "c_acctbal")


STREAK_SQL = """
WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS s FROM orders GROUP BY 1, 2),
x AS (SELECT o_custkey, y, s - lag(s) OVER (PARTITION BY o_custkey ORDER BY y) AS cfo FROM o),
f AS (SELECT x.*, cfo < 0 AND c_acctbal > 0 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS i FROM x JOIN customer ON c_custkey = o_custkey WHERE cfo IS NOT NULL AND c_acctbal IS NOT NULL),
g AS (SELECT *, i - sum(CAST(f AS INT)) OVER (PARTITION BY o_custkey ORDER BY y ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT o_custkey, max(n) AS longest, max(n) >= 2 AS triggered FROM (SELECT o_custkey, g, count(*) FILTER (f) AS n FROM g GROUP BY 1, 2) GROUP BY 1
"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that the orders make about each project's years, joined with the facts they speak of."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(k / n) % len(xs) + 1).cast("int"))
    claims = o.select(
        k.alias("claim_id"), F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("project_id"),
        F.when(k % 11 == 0, None).otherwise(pick(1, "revenue", "operating_cost", "income_tax")).alias("primary_metric"), F.when(k % 13 == 0, None).otherwise(F.year("o_orderdate").cast("string")).alias("period_norm"),
        pick(3, "up", "down", "improve", "deteriorate", "unclear").alias("direction"), F.when(k % 4 == 0, (k % 17).cast("decimal(20,6)")).alias("magnitude_value"),
        pick(2, "%", "亿元", "个百分点").alias("magnitude_unit"), pick(5, "exact", "at_least", "at_most", "about").alias("bound"), (k % 8 == 0).alias("is_plan"), F.lit("amount").alias("metric_kind"))
    wide = annual(spark, sf_dir)
    f = wide.selectExpr("project_id", "period", "comparable", "stack(3, 'revenue', revenue, 'operating_cost', operating_cost, 'income_tax', income_tax) AS (metric, value)")
    side = lambda name, shift: f.select(F.col("project_id"), F.col("metric").alias("primary_metric"), (F.col("period").cast("int") + shift).cast("string").alias("period_norm"), F.col("value").alias(f"{name}_value"), F.col("comparable").alias(f"{name}_comparable"), F.col("period").alias(f"{name}_period"))
    on = ["project_id", "primary_metric", "period_norm"]
    return claims.join(side("current", 0), on, "left").join(side("base", 1), on, "left")


CLAIMS_CTE = f"""{ANNUAL_SQL},
f AS (SELECT project_id, CAST(period AS INT) AS y, comparable, unnest(['revenue', 'operating_cost', 'income_tax']) AS m, unnest([revenue, operating_cost, income_tax]) AS v FROM annual),
k AS (SELECT o_orderkey AS claim_id, 'P' || c_nationkey AS project_id, CASE WHEN o_orderkey % 11 <> 0 THEN ['revenue', 'operating_cost', 'income_tax'][o_orderkey % 3 + 1] END AS m, CASE WHEN o_orderkey % 13 <> 0 THEN year(o_orderdate) END AS y,
             ['up', 'down', 'improve', 'deteriorate', 'unclear'][(o_orderkey // 3) % 5 + 1] AS dir, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 17 END AS mag, ['%', '亿元', '个百分点'][(o_orderkey // 2) % 3 + 1] AS unit,
             ['exact', 'at_least', 'at_most', 'about'][(o_orderkey // 5) % 4 + 1] AS bound, o_orderkey % 8 = 0 AS plan FROM orders JOIN customer ON o_custkey = c_custkey),
j AS (SELECT k.*, a.v AS cv, a.comparable AS cc, a.y AS cy, b.v AS bv, b.comparable AS bc, b.y AS b_y FROM k LEFT JOIN f a ON a.project_id = k.project_id AND a.m = k.m AND a.y = k.y LEFT JOIN f b ON b.project_id = k.project_id AND b.m = k.m AND b.y = k.y - 1),
t AS (SELECT *, mag IS NOT NULL AND (unit IN ('%', '个百分点') OR bound IN ('at_least', 'at_most') OR plan) AS target, unit IN ('%', '个百分点') AS rate,
             CASE WHEN m = 'operating_cost' THEN CASE dir WHEN 'improve' THEN 'down' WHEN 'deteriorate' THEN 'up' WHEN 'unclear' THEN 'unknown' ELSE dir END ELSE CASE dir WHEN 'improve' THEN 'up' WHEN 'deteriorate' THEN 'down' WHEN 'unclear' THEN 'unknown' ELSE dir END END AS expected,
             CASE WHEN bv > 0 THEN round_even(CAST((cv - bv) / bv AS DECIMAL(38,18)), 8) END AS actual, CASE WHEN bv > 0 THEN CASE WHEN abs((cv - bv) / bv) <= 0.01 THEN 'flat' WHEN cv > bv THEN 'up' ELSE 'down' END END AS ch FROM j),
d AS (SELECT *, round_even(CAST(actual - CASE WHEN dir = 'down' THEN -1 ELSE 1 END * mag / 100.0 AS DECIMAL(20,8)), 6) AS dev FROM t),
v AS (SELECT *, CASE WHEN m IS NULL OR y IS NULL OR cy IS NULL THEN 'unverifiable' WHEN NOT cc OR NOT coalesce(bc, true) THEN 'incomparable' WHEN target AND bound = 'about' AND rate THEN 'needs_review' WHEN target AND NOT rate THEN 'needs_review'
       WHEN target AND coalesce(bv <= 0, true) THEN 'needs_review'
       WHEN target THEN CASE WHEN CASE bound WHEN 'exact' THEN abs(dev) <= 0.005 WHEN 'at_least' THEN CASE WHEN dir = 'down' THEN dev <= 0 ELSE dev >= 0 END WHEN 'at_most' THEN CASE WHEN dir = 'down' THEN dev >= 0 ELSE dev <= 0 END ELSE false END THEN 'supported' ELSE 'contradicted' END
       WHEN b_y IS NULL OR ch IS NULL OR expected = 'unknown' THEN 'needs_review' WHEN ch = 'flat' THEN 'neutral' WHEN ch = expected THEN 'supported' ELSE 'contradicted' END AS verdict FROM d)"""


def direction_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.judge(_claims(spark, sf_dir)).select("claim_id", "verdict", F.col("deviation").cast("double").alias("deviation"))


VERDICT_SQL = f"WITH {CLAIMS_CTE} SELECT claim_id, verdict, CAST(CASE WHEN target AND rate AND cy IS NOT NULL AND cc AND coalesce(bc, true) THEN dev END AS DOUBLE) AS deviation FROM v"


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.summary(verdicts.judge(_claims(spark, sf_dir)), ["project_id"])


VERDICT_SUMMARY_SQL = f"""
WITH {CLAIMS_CTE} SELECT project_id, count(*) AS total, count(*) FILTER (verdict IN ('supported', 'neutral', 'contradicted')) AS n, count(*) FILTER (verdict NOT IN ('unverifiable', 'incomparable')) AS possible,
       count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'neutral') AS neutral, count(*) FILTER (verdict = 'contradicted') AS contradicted, count(*) FILTER (verdict = 'needs_review') AS needs_review FROM v GROUP BY 1
"""


def narrative_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.narrative_judge(_claims(spark, sf_dir)).select("claim_id", "change", "verdict")


NARRATIVE_SQL = f"""
WITH {CLAIMS_CTE}, x AS (SELECT claim_id, dir, CASE WHEN cv > bv THEN 'up' WHEN cv < bv THEN 'down' WHEN cv = bv THEN 'flat' END AS change FROM j)
SELECT claim_id, change, CASE WHEN change IS NULL THEN 'missing' WHEN change = 'flat' THEN 'incomparable' WHEN dir = change THEN 'consistent' WHEN dir IN ('up', 'down') THEN 'conflict' ELSE 'undirected' END AS verdict FROM x
"""


def absolute_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _claims(spark, sf_dir).withColumns({"metric_unit_kind": F.when(F.col("primary_metric") == "income_tax", "ton").otherwise("currency"), "target_metric_aligned": F.col("claim_id") % 3 != 0, "metric_sign": F.when(F.col("primary_metric") == "operating_cost", "cost").otherwise("gain")})
    return verdicts.absolute_variance(x.where("magnitude_value IS NOT NULL")).select("claim_id", "target", "variance", "side", "refused")


ABSOLUTE_SQL = f"""
WITH {CLAIMS_CTE}, x AS (SELECT *, CASE WHEN m = 'income_tax' THEN 'ton' ELSE 'currency' END AS kind, CASE WHEN coalesce(m, '') <> 'income_tax' AND unit = '亿元' THEN CAST(mag * 100 AS DECIMAL(20,6)) END AS target FROM j WHERE mag IS NOT NULL),
r AS (SELECT *, CASE WHEN claim_id % 3 = 0 THEN 'not_aligned' WHEN target IS NULL THEN 'unit_factor' WHEN cv IS NULL THEN 'no_fact' END AS refused FROM x)
SELECT claim_id, target, CASE WHEN refused IS NULL THEN CAST(cv - target AS DECIMAL(21,6)) END AS variance, CASE WHEN refused IS NULL THEN CASE WHEN cv = target THEN 'met' WHEN (cv > target) <> coalesce(m = 'operating_cost', false) THEN 'better' ELSE 'worse' END END AS side, refused FROM r
"""


def budget_attainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _claims(spark, sf_dir).withColumns({"enabled": F.col("claim_id") % 5 != 0, "report_period": F.col("period_norm"), "current_unit": F.lit("亿元")}).where("is_plan")
    return verdicts.budget_attainment(x, "1996").select("claim_id", "variance", "refused", "verdict")


BUDGET_SQL = f"""
WITH {CLAIMS_CTE}, r AS (SELECT *, CASE WHEN claim_id % 5 = 0 THEN 'not_enabled' WHEN y <= 1996 THEN 'transition_year' WHEN cv IS NULL THEN 'pending' WHEN unit <> '亿元' THEN 'unit' END AS refused FROM j WHERE plan)
SELECT claim_id, CASE WHEN refused IS NULL THEN CAST(cv - mag AS DECIMAL(21,6)) END AS variance, refused, CASE WHEN refused IS NULL THEN CASE WHEN cv >= mag THEN 'supported' ELSE 'contradicted' END WHEN refused = 'transition_year' THEN 'incomparable' WHEN refused = 'pending' THEN 'unverifiable' ELSE 'needs_review' END AS verdict FROM r
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = verdicts.judge(_claims(spark, sf_dir))
    return judged.withColumns({"score": verdicts.score(F.col("verdict")), "bucket": index.bucket(F.col("period_norm"), F.when(F.col("claim_id") % 3 == 0, F.lit("1996")).otherwise(F.lit("2002")))})


def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = index.history_current(_scores(spark, sf_dir), ["project_id"])
    return out.select("project_id", F.col("h").cast("double").alias("h"), F.col("c").cast("double").alias("c"), "n")


BUCKET_CTE = f"""{CLAIMS_CTE},
s AS (SELECT project_id, CASE verdict WHEN 'supported' THEN 1 WHEN 'neutral' THEN 0 WHEN 'contradicted' THEN -1 END AS s, CASE WHEN y > CASE WHEN claim_id % 3 = 0 THEN 1996 ELSE 2002 END THEN 'H' ELSE 'C' END AS b, verdict FROM v),
hc AS (SELECT project_id, CAST(round_even(CAST(sum(s) FILTER (b = 'H') / count(s) FILTER (b = 'H') AS DECIMAL(38,18)), 6) AS DECIMAL(20,6)) AS h, CAST(round_even(CAST(sum(s) FILTER (b = 'C') / count(s) FILTER (b = 'C') AS DECIMAL(38,18)), 6) AS DECIMAL(20,6)) AS c, count(s) AS n,
              count(*) FILTER (verdict NOT IN ('unverifiable', 'incomparable')) AS total FROM s GROUP BY 1)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scores(spark, sf_dir)
    total = scored.groupBy("project_id").agg(F.count_if(~F.col("verdict").isin("unverifiable", "incomparable")).alias("total"))
    k = F.substring("project_id", 2, 9).cast("int")
    x = index.history_current(scored, ["project_id"]).join(total, "project_id")
    x = x.withColumns({"r": (k % 5) / F.lit(4).cast("decimal(4,1)"), "p": F.when(k % 9 == 0, None).otherwise((k % 3) / F.lit(2).cast("decimal(4,1)")), "q": (k % 4) / F.lit(4).cast("decimal(4,1)")})
    return index.scenario_weights(index.diagnosis(x))


def index_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _index(spark, sf_dir)
    failed = F.array_join(F.transform(F.filter("gates", lambda g: ~g["passed"]), lambda g: g["gate"]), ",")
    return out.select("project_id", F.col("score").cast("double").alias("score"), "grade", failed.alias("failed"))


INDEX_CTE = f"""{BUCKET_CTE},
x AS (SELECT *, CAST(substr(project_id, 2) AS INT) AS k FROM hc),
i AS (SELECT *, coalesce(total > 0 AND n >= 0.6 * total, false) AS g1, n >= 5 AS g2, h IS NOT NULL AND c IS NOT NULL AS g3, k % 9 <> 0 AS g4, 50 + 20 * h + 20 * c + 5 * ((k % 5) / 4.0) - 10 * ((k % 3) / 2.0) - 15 * ((k % 4) / 4.0) AS raw FROM x),
o AS (SELECT *, CASE WHEN g1 AND g2 AND g3 AND g4 THEN round(least(greatest(CAST(raw AS DOUBLE), 0), 100), 6) END AS score FROM i),
r AS (SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score < 45 THEN 'low' WHEN score IS NOT NULL THEN 'medium' ELSE 'insufficient' END AS grade FROM o)"""
INDEX_SQL = f"WITH {INDEX_CTE} SELECT project_id, score, grade, concat_ws(',', CASE WHEN NOT g1 THEN 'coverage' END, CASE WHEN NOT g2 THEN 'observations' END, CASE WHEN NOT g3 THEN 'claims' END, CASE WHEN NOT g4 THEN 'components' END) AS failed FROM r"


def scenario_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("project_id", "grade", "base", "optimistic", "stress")


SCENARIO_SQL = f"""
WITH {INDEX_CTE}, w AS (SELECT * FROM (VALUES ('high', 0.60, 0.25, 0.15), ('medium', 0.50, 0.20, 0.30), ('low', 0.35, 0.15, 0.50)) t(grade, base, optimistic, stress))
SELECT project_id, r.grade, CAST(base AS DECIMAL(4,2)) AS base, CAST(optimistic AS DECIMAL(4,2)) AS optimistic, CAST(stress AS DECIMAL(4,2)) AS stress FROM r LEFT JOIN w ON w.grade = r.grade
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    return d.select("source", (k % 6 != 0).alias("applicable"), F.when(F.col("quality").isNull() & (k % 50 == 0), None).when(k % 3 == 0, "insufficient").otherwise("sufficient").alias("conclusion"), F.when(k % 12 == 0, " ").otherwise("e").alias("evidence"), (k % 2 == 0).alias("is_substantive"), (F.col("toxic") == 1).alias("is_template"))


def _component(df: DataFrame) -> DataFrame:
    return df.select("source", "component.numerator", "component.denominator", F.col("component.value").cast("double").alias("value"), "component.verified")


ITEMS_SQL = """
d AS (SELECT d.doc_id AS k, source, CASE WHEN quality IS NULL AND d.doc_id % 50 = 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN 'insufficient' ELSE 'sufficient' END AS c, coalesce(toxic = 1, false) AS tpl FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_VALUE = "CAST(CASE WHEN denominator > 0 AND p = 0 THEN round_even(CAST(numerator / denominator AS DECIMAL(38,18)), 6) END AS DOUBLE) AS value, denominator > 0 AND p = 0 AS verified"


def risk_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component(quality.risk(_items(spark, sf_dir), ["source"]))


RISK_SQL = f"""WITH {ITEMS_SQL}, g AS (SELECT source, count(*) FILTER (k % 6 <> 0 AND c = 'sufficient') AS numerator, count(*) FILTER (k % 6 <> 0 AND c IS NOT NULL) AS denominator, count(*) FILTER ((k % 6 <> 0 AND c IS NULL) OR k % 12 = 0) AS p FROM d GROUP BY 1)
SELECT source, numerator, denominator, {_VALUE} FROM g"""


def template_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _component(quality.template(_items(spark, sf_dir), ["source"]))


TEMPLATE_SQL = f"""WITH {ITEMS_SQL}, g AS (SELECT source, count(*) FILTER (c IS NOT NULL AND k % 2 = 0 AND tpl) AS numerator, count(*) FILTER (c IS NOT NULL AND k % 2 = 0) AS denominator, count(*) FILTER (c IS NULL) AS p FROM d GROUP BY 1)
SELECT source, numerator, denominator, {_VALUE} FROM g"""


def component_drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows behind the components, five-way, counted by component and detail."""
    claims = _scores(spark, sf_dir).where("score IS NOT NULL").select("bucket", F.col("claim_id").cast("string").alias("key"), F.col("score").alias("detail"))
    items = _items(spark, sf_dir)
    risks = items.where("applicable").select(F.col("source").alias("key"), F.col("conclusion").alias("detail"))
    templates = items.where("is_substantive").select(F.col("source").alias("key"), F.col("conclusion").alias("detail"))
    pairs = quality.receivables(_receivables(spark, sf_dir), ["project_id"]).select(F.concat_ws("-", "project_id", "period").alias("key"), F.coalesce("blocked", F.col("triggered").cast("string")).alias("detail"))
    return index.drill_down(claims, risks, templates, pairs).groupBy("component", "detail").agg(F.count("*").alias("rows"), F.min("key").alias("first"))


def _renamed(sql: str, *names: str) -> str:
    """The expressions with another prefix, so that two lists of them can stand together."""
    for n in names:
        sql = re.sub(rf"\b{n} AS \(", f"q_{n} AS (", sql)
        sql = re.sub(rf"\bFROM {n}\b", f"FROM q_{n}", sql)
    return sql


DRILL_SQL = f"""
WITH {BUCKET_CTE.replace("s AS (SELECT project_id, CASE verdict", "s AS (SELECT claim_id, project_id, CASE verdict")}, {_renamed(ITEMS_SQL, "d")},
{_renamed(RECEIVABLES_CTE.removeprefix(ANNUAL_SQL + ","), "x", "l", "d", "b").replace("q_d AS (SELECT *, CASE WHEN f", "r_d AS (SELECT *, CASE WHEN f").replace("END AS blocked FROM q_d", "END AS blocked FROM r_d")},
u AS (SELECT lower(b) AS component, CAST(claim_id AS VARCHAR) AS key, CAST(s AS VARCHAR) AS detail FROM s WHERE s IS NOT NULL
      UNION ALL SELECT 'r', source, c FROM q_d WHERE k % 6 <> 0 UNION ALL SELECT 'p', source, c FROM q_d WHERE k % 2 = 0
      UNION ALL SELECT 'q', project_id || '-' || period, coalesce(blocked, CAST(days - days_before > 10 AND share - share_before > 0.005 AS VARCHAR)) FROM q_b)
SELECT component, detail, count(*) AS rows, min(key) AS first FROM u GROUP BY 1, 2
"""


QUERIES = {
    "weighted_quantiles": (weighted_quantiles, WEIGHTED_SQL),
    "interpolated_quantile": (interpolated_quantile, "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem GROUP BY 1"),
    "cycle_normalization": (cycle_normalization, NORMALIZE_SQL),
    "cycle_years": (cycle_years, CYCLE_YEARS_SQL),
    "two_period_average": (two_period_average, f"WITH {ANNUAL_SQL} SELECT project_id, period, CAST(CASE WHEN revenue > 0 THEN round_even(CAST(CAST((income_tax + lag(income_tax) OVER (PARTITION BY project_id ORDER BY period)) / 2 * 365 AS DECIMAL(20,6)) / revenue AS DECIMAL(38,18)), 2) END AS DOUBLE) AS days FROM annual"),
    "pairwise_deterioration": (pairwise_deterioration, PAIRWISE_SQL),
    "quality_component": (quality_component, QUALITY_SQL),
    "inventory_gap": (inventory_gap, INVENTORY_SQL),
    "cash_streak": (cash_streak, STREAK_SQL),
    "direction_verdicts": (direction_verdicts, VERDICT_SQL),
    "verdict_summary": (verdict_summary, VERDICT_SUMMARY_SQL),
    "narrative_verdicts": (narrative_verdicts, NARRATIVE_SQL),
    "absolute_targets": (absolute_targets, ABSOLUTE_SQL),
    "budget_attainment": (budget_attainment, BUDGET_SQL),
    "score_buckets": (score_buckets, f"WITH {BUCKET_CTE} SELECT project_id, CAST(h AS DOUBLE) AS h, CAST(c AS DOUBLE) AS c, n FROM hc"),
    "index_score": (index_score, INDEX_SQL),
    "scenario_weights": (scenario_weights, SCENARIO_SQL),
    "risk_component": (risk_component, RISK_SQL),
    "template_component": (template_component, TEMPLATE_SQL),
    "component_drill_down": (component_drill_down, DRILL_SQL),
}
