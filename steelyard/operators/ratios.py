"""Growth and ratio operators that refuse rather than guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import period_gap, quotient
from steelyard.functions.refusal import guarded


def yoy_growth(prev: Column, curr: Column, prev_period: Column, curr_period: Column, prev_scope: Column | None = None, curr_scope: Column | None = None) -> Column:
    """(curr - prev) / |prev|, 4 places; refused in this order: a value is missing, scopes differ, a period
    is no year, the years aren't consecutive, the base is 0, the base is negative."""
    scopes = (prev_scope != curr_scope) if prev_scope is not None and curr_scope is not None else F.lit(False)
    gap = period_gap(prev_period, curr_period)
    reasons = [
        (prev.isNull() | curr.isNull(), "missing"), (scopes, "scope_mismatch"), (gap.isNull(), "period_unparsable"),
        (gap != 1, "gap"), (prev == 0, "zero_base"), (prev < 0, "negative_base"),
    ]
    formula = F.concat(F.lit("("), curr_period, F.lit(" - "), prev_period, F.lit(") / |"), prev_period, F.lit("|"))
    return guarded(quotient(curr - prev, F.abs(prev)), reasons, formula, {"prev": prev, "curr": curr})


def ratio(num: Column, den: Column, name: str, scale: int = 1, places: int = 4) -> Column:
    """num / den * scale; refused where either is missing or den is 0."""
    reasons = [(num.isNull() | den.isNull(), "missing"), (den == 0, "zero_denominator")]
    formula = F.lit(name + (f" x {scale}" if scale != 1 else ""))
    return guarded(quotient(num, den, places, scale), reasons, formula, {"numerator": num, "denominator": den})


def gross_margin(profit: Column, revenue: Column) -> Column:
    """Profit / revenue in percent; refused where revenue is negative, missing or 0."""
    reasons = [(revenue < 0, "negative_revenue"), (profit.isNull() | revenue.isNull(), "missing"), (revenue == 0, "zero_denominator")]
    return guarded(quotient(profit, revenue, 4, 100), reasons, F.lit("gross_profit / revenue x 100"), {"gross_profit": profit, "revenue": revenue})


def series_yoy(facts: DataFrame, by: list[str], period: str = "period", value: str = "value") -> DataFrame:
    """Add ``yoy`` against the previous available point; holes are refused as gaps, the first has ``first``."""
    w = Window.partitionBy(*by).orderBy(period)
    prev, prev_period = F.lag(value).over(w), F.lag(period).over(w)
    out = facts.withColumn("_p", prev).withColumn("_q", prev_period)
    growth = yoy_growth(F.col("_p"), F.col(value), F.col("_q"), F.col(period))
    first = F.struct(F.lit(None).cast("decimal(38,4)").alias("value"), F.lit("first").alias("refused"))
    slim = F.struct(growth["value"].cast("decimal(38,4)").alias("value"), growth["refused"].alias("refused"))
    return out.withColumn("yoy", F.when(F.col("_q").isNull(), first).otherwise(slim)).drop("_p", "_q")


def margin_series(wide: DataFrame, by: list[str]) -> DataFrame:
    """``revenue, operating_cost, gross_profit`` to ``profit``, its ``origin`` and ``margin``: the disclosed
    gross profit, else revenue less cost."""
    profit = F.coalesce(F.col("gross_profit"), F.col("revenue") - F.col("operating_cost")).cast("decimal(20,6)")
    origin = F.when(F.col("gross_profit").isNotNull(), "disclosed").when(profit.isNotNull(), "derived")
    return wide.select(*by, profit.alias("profit"), origin.alias("origin"), gross_margin(profit, F.col("revenue")).alias("margin"))
