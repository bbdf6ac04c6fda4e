"""Earnings-quality operators: streaks, turnover days, aging, and the components they feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import quantize, quotient
from steelyard.operators.relational import streaks

DAYS_GAP, SHARE_GAP, VOLUME_DROP, STREAK = 10, "0.005", "-0.01", 2


def turnover_days(now: Column, prior: Column, flow: Column, places: int = 2) -> Column:
    """Average of two balances by the flow of the year, in days; null where the flow is 0 or less, or a
    balance is missing."""
    return F.when(flow > 0, quotient((now + prior) / 2 * 365, flow, places))


def aging_share(over_one_year: Column, gross: Column) -> Column:
    return F.when(gross > 0, quotient(over_one_year, gross, 6))


def cash_streak(df: DataFrame, by: list[str], year: str, cfo: str, income: str) -> DataFrame:
    """``longest, triggered``: consecutive available years of negative cash flow beside a profit."""
    out = streaks(df.where(F.col(cfo).isNotNull() & F.col(income).isNotNull()), by, year, (F.col(cfo) < 0) & (F.col(income) > 0))
    return out.withColumn("triggered", F.col("longest") >= STREAK)


def receivables(df: DataFrame, by: list[str], *, legacy: bool = False) -> DataFrame:
    """Judge each pair of adjacent years by receivable days and the share older than a year.

    ``df`` has ``period, receivable, over_one_year, revenue, status``. Blocked in this order: no year
    before, a status other than ``confirmed``, figures that don't give days or shares. Triggered if days
    lengthen by more than 10 and the share grows by more than 0.005. Days are over the average of a
    year's balance and the one before; ``legacy`` averages the earlier year's balance with itself.
    """
    w = Window.partitionBy(*by).orderBy("period")
    lag = lambda c, n=1: F.lag(c, n).over(w)
    first = lag("receivable") if legacy else F.coalesce(lag("receivable", 2), lag("receivable"))
    x = df.select("*", turnover_days(F.col("receivable"), lag("receivable"), F.col("revenue"), 6).alias("days"), turnover_days(lag("receivable"), first, lag("revenue"), 6).alias("days_before"),
                  aging_share(F.col("over_one_year"), F.col("receivable")).alias("share"), aging_share(lag("over_one_year"), lag("receivable")).alias("share_before"),
                  lag("period").alias("_p"), lag("status").alias("_s"))
    gap = F.col("period").try_cast("int") - F.col("_p").try_cast("int")
    figures = F.col("days").isNull() | F.col("days_before").isNull() | F.col("share").isNull() | F.col("share_before").isNull()
    blocked = F.when(F.col("_p").isNull() | (gap != 1), "no_prior").when((F.col("status") != "confirmed") | (F.col("_s") != "confirmed"), "not_confirmed").when(figures, "no_figures")
    hit = (F.col("days") - F.col("days_before") > DAYS_GAP) & (F.col("share") - F.col("share_before") > F.lit(SHARE_GAP).cast("decimal(6,4)"))
    return x.select(*by, "period", "days", "days_before", "share", "share_before", blocked.alias("blocked"), F.when(blocked.isNull(), hit).alias("triggered"))


def inventory(df: DataFrame, by: list[str]) -> DataFrame:
    """The last three common years: inventory days lengthen by more than 10 while the volume falls by more
    than one percent. ``df`` has ``period, inventory, cost, volume``."""
    w = Window.partitionBy(*by).orderBy(F.col("period").desc())
    x = df.withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    at = lambda c, n: F.max(F.when(F.col("_n") == n, F.col(c)))
    x = x.groupBy(*by).agg(*[at(c, n).alias(f"{c}{n}") for c in ("inventory", "cost", "volume") for n in (1, 2, 3)], F.count("*").alias("years"))
    days, before = turnover_days(F.col("inventory1"), F.col("inventory2"), F.col("cost1")), turnover_days(F.col("inventory2"), F.col("inventory3"), F.col("cost2"))
    change = F.when(F.col("volume2") > 0, quotient(F.col("volume1") - F.col("volume2"), F.col("volume2"), 6))
    state = F.when(F.col("years") < 3, "insufficient").when(change.isNull(), "not_applicable").when(days.isNull() | before.isNull(), "insufficient").when((days - before > DAYS_GAP) & (change < F.lit(VOLUME_DROP).cast("decimal(6,4)")), "triggered").otherwise("clear")
    return x.select(*by, days.alias("days"), before.alias("days_before"), change.alias("volume_change"), state.alias("state"))


def component(numerator: Column, denominator: Column, pending: Column) -> Column:
    """``struct(numerator, denominator, value, verified)``: a share of verified items, verified if there are
    any and none is pending."""
    verified = (denominator > 0) & (pending == 0)
    return F.struct(numerator.alias("numerator"), denominator.alias("denominator"), F.when(verified, quotient(numerator, denominator, 6)).alias("value"), verified.alias("verified"))


def risk(items: DataFrame, by: list[str]) -> DataFrame:
    """Disclosed risks: ``items`` has ``applicable, conclusion, evidence``; sufficient ones by those resolved.
    Items that are not applicable need evidence for that, others a conclusion, else they are pending."""
    evidence = F.coalesce(F.length(F.trim("evidence")) > 0, F.lit(False))
    applies = F.coalesce("applicable", F.lit(True))
    done = applies & F.col("conclusion").isin("sufficient", "insufficient")
    pending = (applies & ~F.coalesce(done, F.lit(False))) | (~applies & ~evidence)
    g = items.groupBy(*by).agg(F.count_if(F.coalesce(done, F.lit(False)) & (F.col("conclusion") == "sufficient")).alias("_n"), F.count_if(F.coalesce(done, F.lit(False))).alias("_d"), F.count_if(pending).alias("_p"))
    return g.select(*by, component(F.col("_n"), F.col("_d"), F.col("_p")).alias("component"))


def template(claims: DataFrame, by: list[str]) -> DataFrame:
    """Template statements among reviewed substantive ones: ``claims`` has ``is_substantive, is_template,
    conclusion``, where a null or pending conclusion is yet to come."""
    reviewed = F.coalesce(F.col("conclusion") != "pending", F.lit(False))
    own = F.coalesce("is_substantive", F.lit(False))
    g = claims.groupBy(*by).agg(F.count_if(reviewed & own & F.coalesce("is_template", F.lit(False))).alias("_n"), F.count_if(reviewed & own).alias("_d"), F.count_if(~reviewed).alias("_p"))
    return g.select(*by, component(F.col("_n"), F.col("_d"), F.col("_p")).alias("component"))


def checklist(states: DataFrame, by: list[str], *, legacy: bool = False) -> DataFrame:
    """Triggered among verified applicable items. ``states`` has ``item, state`` in triggered, clear,
    not_applicable, insufficient. An item counts once, however often it triggers; ``legacy`` counts each."""
    one = states if legacy else states.groupBy(*by, "item").agg(F.max_by("state", F.when(F.col("state") == "triggered", 3).when(F.col("state") == "insufficient", 2).when(F.col("state") == "clear", 1).otherwise(0)).alias("state"))
    g = one.groupBy(*by).agg(F.count_if(F.col("state") == "triggered").alias("_n"), F.count_distinct(F.when(F.col("state").isin("triggered", "clear"), F.col("item"))).alias("_d"), F.count_if(F.col("state") == "insufficient").alias("_p"))
    return g.select(*by, component(F.col("_n"), F.col("_d"), F.col("_p")).alias("component"))


__all__ = ["aging_share", "cash_streak", "checklist", "component", "inventory", "quantize", "receivables", "risk", "template", "turnover_days"]
