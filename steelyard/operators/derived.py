"""Derived metrics: one table of specifications, evaluated on a wide row and unpivoted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY, quotient
from steelyard.functions.refusal import guarded


@dataclass(frozen=True)
class Spec:
    """A derived metric: the keys it needs, its unit and formula, and its value from the columns; a
    ``refused`` one is never computed. ``prior`` keys are of the year before."""

    key: str
    needs: tuple[str, ...]
    unit: str
    formula: str
    value: Callable[[Callable[[str], Column]], Column] | None = None
    denominator: tuple[str, ...] = ()
    prior: tuple[str, ...] = ()
    refused: str | None = None


def _ebit(c):
    return c("profit_before_tax") + c("interest_expense") - c("interest_income")


def _ebitda(c):
    return _ebit(c) + c("depreciation_amortization") + c("amortization_intangible") + c("right_of_use_asset_depreciation")


def _gross(c):
    return c("revenue") - c("operating_cost")


EBIT = ("profit_before_tax", "interest_expense", "interest_income")
EBITDA = (*EBIT, "depreciation_amortization", "amortization_intangible", "right_of_use_asset_depreciation")
DEBT = ("short_term_borrowing", "long_term_borrowing", "bonds_payable", "lease_liability", "noncurrent_due_within_one_year")
WORKING = ("accounts_receivable", "notes_receivable", "inventory", "accounts_payable", "notes_payable", "contract_liabilities")


def _percent(key: str, num: Callable, den: str, needs: tuple[str, ...], formula: str) -> Spec:
    return Spec(key, (*needs, den), "percent", formula, lambda c: quotient(num(c), c(den), 6, 100), (den,))


SPECS: tuple[Spec, ...] = (
    Spec("gross_profit", ("revenue", "operating_cost"), "million", "revenue - operating_cost", _gross),
    Spec("ebit", EBIT, "million", "profit_before_tax + interest_expense - interest_income", _ebit),
    Spec("ebitda", EBITDA, "million", "ebit + depreciation and amortization", _ebitda),
    Spec("roe", ("net_income_parent", "equity_parent"), "percent", "net_income_parent / average equity_parent x 100",
         lambda c: quotient(c("net_income_parent"), (c("equity_parent") + c("prior.equity_parent")) / 2, 6, 100), ("equity_parent",), ("equity_parent",)),
    _percent("gross_margin", _gross, "revenue", ("operating_cost",), "gross_profit / revenue x 100"),
    _percent("net_margin", lambda c: c("net_income"), "revenue", ("net_income",), "net_income / revenue x 100"),
    _percent("cash_conversion", lambda c: c("cfo"), "net_income", ("cfo",), "cfo / net_income x 100"),
    _percent("nonrecurring_share", lambda c: c("non_recurring_gain_loss"), "net_income", ("non_recurring_gain_loss",), "non_recurring / net_income x 100"),
    _percent("ebit_margin", _ebit, "revenue", EBIT, "ebit / revenue x 100"),
    _percent("ebitda_margin", _ebitda, "revenue", EBITDA, "ebitda / revenue x 100"),
    Spec("interest_bearing_debt", DEBT, "million", "sum of the five borrowings", lambda c: reduce(lambda a, b: a + b, map(c, DEBT))),
    Spec("operating_working_capital", WORKING, "million", "three assets - three liabilities",
         lambda c: reduce(lambda a, b: a + b, map(c, WORKING[:3])) - reduce(lambda a, b: a + b, map(c, WORKING[3:]))),
    Spec("net_debt", (), "million", "interest_bearing_debt - cash", refused="not_defined"),
    Spec("roic", (), "percent", "nopat / invested capital", refused="needs_normalized_tax"),
    Spec("steel_gross_profit_per_ton", ("revenue", "operating_cost", "steel_sales_volume"), "yuan_per_ton", "gross_profit x 1000000 / tonnes",
         lambda c: quotient(_gross(c), c("steel_sales_volume"), 6, 1_000_000), ("steel_sales_volume",)),
    Spec("steel_ebitda_per_ton", (*EBITDA, "steel_sales_volume"), "yuan_per_ton", "ebitda x 1000000 / tonnes",
         lambda c: quotient(_ebitda(c), c("steel_sales_volume"), 6, 1_000_000), ("steel_sales_volume",)),
    Spec("steel_price_avg", (), "yuan_per_ton", "product revenue / tonnes", refused="no_product_revenue"),
    Spec("capacity_utilization", (), "percent", "output / effective capacity", refused="capacity_not_disclosed"),
    Spec("steel_spread", (), "yuan_per_ton", "price - raw material", refused="not_defined"),
    Spec("coal_price_avg", (), "yuan_per_ton", "coal revenue / tonnes", refused="not_applicable"),
    Spec("ton_coal_gross_margin", (), "yuan_per_ton", "coal gross profit / tonnes", refused="not_applicable"),
)


def derive(facts: DataFrame, keys: list[str] | None = None, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """Long facts ``project_id, metric_key, period, value`` to ``project_id, period, metric_key, unit,
    value, refused, formula, inputs``, one row per project, year and specification.

    Only validated, comparable facts are to be passed. The facts are pivoted once; ``prior`` keys come from
    the row of the year before, and only of that year. An absent input refuses the metric, never counts 0.
    """
    chosen = [s for s in specs if keys is None or s.key in keys]
    needed = sorted({k for s in chosen for k in (*s.needs, *s.prior)})
    wide = facts.groupBy("project_id", "period").pivot("metric_key", needed or ["revenue"]).agg(F.first("value"))
    before = Window.partitionBy("project_id").orderBy("period")
    prior = sorted({k for s in chosen for k in s.prior})
    follows = F.col("period").try_cast("int") - F.lag("period").over(before).try_cast("int") == 1
    wide = wide.select("*", *[F.when(follows, F.lag(k).over(before)).alias(f"prior_{k}") for k in prior])

    def column(key: str) -> Column:
        return F.col("prior_" + key[6:] if key.startswith("prior.") else key)

    structs = []
    for s in chosen:
        inputs = {k: column(k) for k in s.needs} | {f"prior {k}": column("prior." + k) for k in s.prior}
        reasons = [(F.lit(s.refused is not None), s.refused or "")]
        reasons += [(column(k).isNull(), "missing") for k in s.needs]
        reasons += [(column("prior." + k).isNull(), "no_prior") for k in s.prior]
        reasons += [(column(k) == 0, "zero_denominator") for k in s.denominator]
        value = (s.value(column) if s.value else F.lit(None)).cast(MONEY)
        shown = inputs or {"": F.lit("")}
        r = guarded(value, reasons, F.lit(s.formula), shown)
        structs.append(F.struct(F.lit(s.key).alias("metric_key"), F.lit(s.unit).alias("unit"), *[r[c].alias(c) for c in ("value", "refused", "formula", "inputs")]))
    return wide.select("project_id", "period", F.inline(F.array(*structs)))


def fill(cells: DataFrame, derived: DataFrame) -> DataFrame:
    """Give empty grid cells their derived value; disclosed figures are never replaced."""
    have = derived.where(F.col("value").isNotNull()).select("project_id", "metric_key", "period", F.col("value").alias("_d"))
    out = cells.join(have, ["project_id", "metric_key", "period"], "left")
    status = F.when(F.col("value").isNull() & F.col("_d").isNotNull(), "derived").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("value", F.coalesce("value", "_d")).drop("_d")
