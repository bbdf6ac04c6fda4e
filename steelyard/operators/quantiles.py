"""Weighted and interpolated quantiles, and cycle normalization built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY, quantize, quotient

#: Window spans in years with the comparable years each needs, in the order they are tried.
ATTEMPTS = (("primary_8y", 8, 7), ("fallback_10y", 10, 8))
AMPLITUDE = "0.02"
CROSSCHECK = "0.05"


#: Parts into which a group's values are cut, and how often, before any of them are put in order.
PARTS, LEVELS = 1024, 2


def _crossed(x: DataFrame, by: list[str], value: str, weight: str, reach: dict[str, Column]) -> DataFrame:
    """``by`` and for each name the first value, in order, at which the cumulative weight satisfies the
    condition on ``_c`` (that weight) and ``_t`` (the group's total).

    Values are summed by value, then by equal parts of the group's span. The running sum over at most
    ``PARTS`` parts finds the one in which each condition first holds, and that part is cut again by the span
    of its own values, so outliers that stretch the group's span leave the second cut alone. What remains is put
    in order: of a group with outliers or without a thousandth or less, but of values that crowd at every scale
    more.
    """
    x = x.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    span = x.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_w").alias("_t"))
    x = x.join(span, by).withColumns({"_p": F.lit(0).cast("long"), "_before": F.lit(0).cast(dict(x.dtypes)["_w"])})
    v, lo, hi = (F.col(c).cast("double") for c in (value, "_lo", "_hi"))
    for _ in range(LEVELS):
        part = F.coalesce(F.least(F.floor(F.try_divide(v - lo, hi - lo) * PARTS), F.lit(PARTS - 1)), F.lit(0))
        x = x.withColumn("_q", F.col("_p") * PARTS + part)
        parts = x.groupBy(*by, "_p", "_q", "_before", "_t").agg(F.sum("_w").alias("_w"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        w = Window.partitionBy(*by, "_p").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("_c", F.col("_before") + F.sum("_w").over(w))
        found = F.struct(F.col("_q").alias("_p"), (F.col("_c") - F.col("_w")).alias("_before"), "_lo", "_hi")
        hit = parts.groupBy(*by).agg(*[F.min(F.when(c, found)).alias(f"_at_{n}") for n, c in reach.items()])
        wanted = hit.select(*by, F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"_at_{n}") for n in reach])))).alias("_a")).select(*by, "_a.*")
        x = x.select(*by, value, "_w", "_t", F.col("_q").alias("_p")).join(wanted, [*by, "_p"])
    inside = Window.partitionBy(*by, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = x.withColumn("_c", F.col("_before") + F.sum("_w").over(inside))
    return near.groupBy(*by).agg(*[F.min(F.when(c, F.col(value))).alias(n) for n, c in reach.items()])


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, qs: dict[str, str]) -> DataFrame:
    """The first value, in order, whose cumulative weight reaches q of the total; weights of 0 or less drop
    out. ``qs`` maps a name to q as text."""
    x = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    return _crossed(x, by, value, weight, {n: F.col("_c") >= F.lit(q).cast("decimal(6,4)") * F.col("_t") for n, q in qs.items()})


def interpolated_quantile(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles at position q (n - 1), linear in between."""
    x = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1).cast("long"))
    spot = lambda q: F.lit(q) * (F.col("_t") - 1)
    reach = {f"{n}_{side}": F.col("_c") > f(spot(q)) for n, q in qs.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    ends = _crossed(x, by, value, "_one", reach).join(x.groupBy(*by).agg(F.count("*").alias("_t")), by)
    share = lambda q: spot(q) - F.floor(spot(q))
    return ends.select(*by, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * share(q)).alias(n) for n, q in qs.items()])


def reported_ebit(pbt: Column, interest_expense: Column, interest_income: Column) -> Column:
    return pbt + interest_expense - interest_income


def crosscheck_deviation(reported: Column, cross: Column) -> Column:
    """|reported - cross| / |reported|, 6 places; null where either is missing or reported is 0."""
    return quotient(F.abs(reported - cross), F.abs(reported), 6)


def normalize(years: DataFrame, company: str = "project_id") -> DataFrame:
    """The revenue-weighted centre of a cycle, or why there is none.

    ``years`` has ``company, period, revenue, ebit, comparable`` and perhaps ``adjusted_ebit`` and
    ``approved``: the adjusted figures are used if every year of the widest window is approved. Windows
    end at the company's last year. The first window with enough comparable years of positive revenue
    and with years at least 0.02 above and below its centre gives ``mid, p25, p75``; without one the last
    failure is returned and no centre. A label that is no year raises.
    """
    year = F.when(F.col("period").rlike("^[12][0-9]{3}$"), F.col("period").cast("int")).otherwise(F.raise_error(F.concat(F.lit("not an annual label: "), F.col("period"))).cast("int"))
    rows = years.withColumn("_y", year).withColumn("_last", F.max("_y").over(Window.partitionBy(company)))
    if "adjusted_ebit" in years.columns:
        widest = F.col("_last") - F.col("_y") < max(span for _, span, _ in ATTEMPTS)
        ok = F.min(F.when(widest, F.coalesce("approved", F.lit(False)).cast("int"))).over(Window.partitionBy(company)) == 1
        rows = rows.withColumn("_ebit", F.when(ok, F.col("adjusted_ebit")).otherwise(F.col("ebit"))).withColumn("variant", F.when(ok, "adjusted").otherwise("reported"))
    else:
        rows = rows.withColumn("_ebit", F.col("ebit")).withColumn("variant", F.lit("reported"))
    margin = F.when(F.col("revenue") > 0, quotient(F.col("_ebit"), F.col("revenue"), 6))
    rows = rows.withColumn("margin", margin).withColumn("_in", F.coalesce("comparable", F.lit(True)) & F.col("margin").isNotNull())
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("_k"), F.lit(s).alias("span"), F.lit(n).alias("need")) for k, (m, s, n) in enumerate(ATTEMPTS)])
    rows = rows.select("*", F.inline(modes)).where(F.col("_last") - F.col("_y") < F.col("span"))
    group = [company, "variant", "mode", "_k", "need"]
    centre = weighted_quantiles(rows.where("_in"), [company, "mode"], "margin", "revenue", {"mid": "0.5", "p25": "0.25", "p75": "0.75"})
    marked = rows.join(centre, [company, "mode"], "left")
    step = F.lit(AMPLITUDE).cast("decimal(6,4)")
    seen = marked.groupBy(*group).agg(
        F.count("*").alias("years"), F.count_if("_in").alias("comparable_years"), F.min("_y").alias("start"), F.max("_y").alias("end"),
        F.count_if(F.col("_in") & (F.col("margin") >= F.col("mid") + step)).alias("high"), F.count_if(F.col("_in") & (F.col("margin") <= F.col("mid") - step)).alias("low"),
        F.first("mid").alias("mid"), F.first("p25").alias("p25"), F.first("p75").alias("p75"))
    status = F.when(F.col("comparable_years") < F.col("need"), "insufficient_data").when((F.col("high") == 0) | (F.col("low") == 0), "incomplete_cycle").otherwise("normalized")
    seen = seen.withColumn("status", status)
    # the first success, else the last failure
    order = F.when(F.col("status") == "normalized", F.col("_k")).otherwise(100 - F.col("_k"))
    best = seen.groupBy(company).agg(F.min_by(F.struct(*[c for c in seen.columns if c != company]), order).alias("_b")).select(company, "_b.*")
    shown = [F.when(F.col("status") == "normalized", F.col(c)).alias(c) for c in ("mid", "p25", "p75")]
    return best.select(company, "variant", "mode", "start", "end", "years", "comparable_years", "high", "low", "status", *shown)


def cycle_years(years: DataFrame, span: int, company: str = "project_id") -> DataFrame:
    """The years of the window of ``span`` with ``margin``, share of the included revenue and phase."""
    rows = years.withColumn("_y", F.col("period").cast("int")).withColumn("_last", F.max("_y").over(Window.partitionBy(company))).where(F.col("_last") - F.col("_y") < span)
    margin = F.when(F.col("revenue") > 0, quotient(F.col("ebit"), F.col("revenue"), 6))
    rows = rows.withColumn("margin", margin).withColumn("included", F.coalesce("comparable", F.lit(True)) & F.col("margin").isNotNull())
    total = F.sum(F.when(F.col("included"), F.col("revenue"))).over(Window.partitionBy(company)).cast(MONEY)
    centre = weighted_quantiles(rows.where("included"), [company], "margin", "revenue", {"mid": "0.5"})
    step = F.lit(AMPLITUDE).cast("decimal(6,4)")
    weight = F.when(F.col("included"), quotient(F.col("revenue"), total, 6))
    phase = F.when(F.col("margin") >= F.col("mid") + step, "high").when(F.col("margin") <= F.col("mid") - step, "low").otherwise("normal")
    out = rows.withColumn("weight", weight).join(centre, company, "left")
    return out.select(company, "period", "margin", "included", "weight", F.when(F.col("included"), phase).alias("phase"))


__all__ = ["crosscheck_deviation", "cycle_years", "interpolated_quantile", "normalize", "quantize", "reported_ebit", "weighted_quantiles"]
