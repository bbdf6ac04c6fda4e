"""Made-up statements that add up: ten years of any number of companies, from a keyed hash.

A figure is a function of key, company, year and name, so every row is made by itself, on any number of tasks, and the
same again. What the identities need is derived, never drawn: a year's opening cash is what the function gives for the
end of the year before, the flows from operations are what is left, and equity is assets less liabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY
from steelyard.sources import store

YEARS = 10
#: Companies of a task: their rows are much work for few bytes.
COMPANIES = 10_000
#: What a planted fault changes, and by which share of total assets or of the figure itself.
FAULTS = {"balance_sheet": "total_assets", "cash_rollforward": "cash_end", "cash_components": "cfi", "gross_profit": "gross_profit"}
FAULT = "0.5"
METRICS = (
    "revenue", "operating_cost", "gross_profit", "cash_begin", "cash_end", "cash_net_increase", "cfo", "cfi", "cff", "accounts_receivable", "inventory", "ppe",
    "total_assets", "total_liabilities", "total_equity", "equity_parent", "minority_interest",
)


def draw(key: str, company: Column, year: Column, name: str) -> Column:
    """A number from 0 to 1 in millionths."""
    return (F.pmod(F.xxhash64(F.lit(key), company.cast("string"), year.cast("int"), F.lit(name)), F.lit(1_000_000)) / F.lit(1_000_000)).cast("decimal(7,6)")


def statements(companies: DataFrame, company: str, last_year: int, *, key: str = "made-up", years: int = YEARS, fault: Column | None = None) -> DataFrame:
    """``company, period`` and the figures of METRICS, in millions, for the years up to ``last_year``.

    ``fault`` names for a row, by company and ``year``, the rule of :data:`steelyard.operators.checks.RULES` that it is to
    break, and is null for others: that rule's figure is half as large again. Rows without a company go; repeated
    companies have the same rows each; other columns aren't read.
    """
    x = store.spread(companies.where(F.col(company).isNotNull()).select(company), COMPANIES).select(F.col(company), F.explode(F.sequence(F.lit(last_year - years + 1), F.lit(last_year))).alias("year"))
    c, y = F.col(company), F.col("year")
    money = lambda v: F.bround(v, 2).cast(MONEY)
    between = lambda name, lo, hi, at=y: F.lit(lo).cast("decimal(6,4)") + draw(key, c, at, name) * F.lit(hi - lo).cast("decimal(6,4)")
    size = draw(key, c, F.lit(0), "size") * 90_000 + 10_000  # a company keeps its size
    revenue = lambda at: money(size * between("revenue", 0.8, 1.2, at))
    cash = lambda at: money(revenue(at) * between("cash", 0.05, 0.15, at))
    x = x.withColumns({"revenue": revenue(y), "cash_begin": cash(y - 1), "cash_end": cash(y)})
    share = lambda name, lo, hi: money(F.col("revenue") * between(name, lo, hi))
    x = x.withColumns({"operating_cost": share("cost", 0.7, 0.95), "cfi": -share("investing", 0.01, 0.1), "cff": share("financing", 0.0, 0.1) - share("dividends", 0.0, 0.1), "accounts_receivable": share("receivable", 0.05, 0.25), "inventory": share("inventory", 0.05, 0.25), "ppe": share("plant", 0.3, 0.9)})
    less = lambda a, *b: sum((-F.col(k) for k in b), F.col(a)).cast(MONEY)
    x = x.withColumns({"gross_profit": less("revenue", "operating_cost"), "cash_net_increase": less("cash_end", "cash_begin"), "total_assets": (F.col("cash_end") + F.col("accounts_receivable") + F.col("inventory") + F.col("ppe")).cast(MONEY)})
    x = x.withColumns({"cfo": less("cash_net_increase", "cfi", "cff"), "total_liabilities": money(F.col("total_assets") * between("debt", 0.4, 0.7))})
    x = x.withColumn("total_equity", less("total_assets", "total_liabilities"))
    x = x.withColumn("minority_interest", money(F.col("total_equity") * between("minority", 0.0, 0.1)))
    x = x.withColumn("equity_parent", less("total_equity", "minority_interest"))
    if fault is not None:
        x = x.withColumn("_fault", fault)
        more = {m: F.when(F.col("_fault") == rule, (F.col(m) * (1 + F.lit(FAULT).cast("decimal(4,2)"))).cast(MONEY)).otherwise(F.col(m)) for rule, m in FAULTS.items()}
        x = x.withColumns(more)
    return x.select(company, F.col("year").cast("string").alias("period"), *METRICS)
