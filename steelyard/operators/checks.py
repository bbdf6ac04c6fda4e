"""Reconciliation checks: accounting identities within a tolerance, or a stated reason not to check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY

TOLERANCE = 0.005
PASSED, FAILED, MISSING, INCOMPARABLE = "passed", "failed", "skipped_missing_data", "skipped_incomparable"


@dataclass(frozen=True)
class Rule:
    """lhs = rhs over metric keys; of ``either`` the first set of keys that is there makes the last term."""

    key: str
    severity: str
    lhs: tuple[str, ...]
    plus: tuple[str, ...] = ()
    minus: tuple[str, ...] = ()
    either: tuple[tuple[str, ...], ...] = ()


RULES = (
    Rule("balance_sheet", "error", ("total_assets",), ("total_liabilities",), (), (("total_equity",), ("equity_parent", "minority_interest"))),
    Rule("cash_rollforward", "error", ("cash_begin", "cash_net_increase"), ("cash_end",)),
    Rule("cash_components", "warn", ("cash_net_increase",), ("cfo", "cfi", "cff")),
    Rule("gross_profit", "info", ("gross_profit",), ("revenue",), ("operating_cost",)),
)


def _allowed(items: list[Column], tolerance: float) -> Column:
    sizes = [F.abs(x) for x in items]
    return ((F.greatest(*sizes) if len(sizes) > 1 else sizes[0]) * F.lit(tolerance).cast("decimal(6,4)")).cast(MONEY)


def compare(lhs: Column, rhs: Column, items: list[Column], tolerance: float) -> tuple[Column, Column, Column]:
    """Difference, allowance and verdict: |lhs - rhs| <= max |item| x tolerance."""
    allowed, diff = _allowed(items, tolerance), (lhs - rhs).cast(MONEY)
    return diff, allowed, F.abs(diff) <= allowed


def run_checks(wide: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row and rule: ``rule_key, severity, status, lhs, rhs, diff, tolerance, inputs``.

    ``wide`` has a column per metric key and perhaps ``<key>_ok``, whether it is comparable. Absent inputs
    are looked at first, then incomparable ones; neither counts as passed.
    """
    if not 0 < tolerance < 1:
        raise ValueError("the tolerance lies between 0 and 1")
    have = set(wide.columns)
    col = lambda k: F.col(k) if k in have else F.lit(None).cast(MONEY)
    ok = lambda k: F.coalesce(F.col(f"{k}_ok"), F.lit(True)) if f"{k}_ok" in have else F.lit(True)
    total = lambda xs: sum(xs[1:], xs[0])
    # columns first and rows after them: each figure is computed once, not once for each place that it is used in
    why, figures, diffs, out = {}, {}, {}, []
    for i, r in enumerate(rules):
        terms = [col(k) for k in (*r.lhs, *r.plus, *r.minus)]
        missing = [x.isNull() for x in terms]
        strange = [~ok(k) for k in (*r.lhs, *r.plus, *r.minus)]
        rhs = [col(k) for k in r.plus] + [-col(k) for k in r.minus]
        names = [F.lit(k) for k in (*r.lhs, *r.plus, *r.minus)]
        used = F.array(*names)
        if r.either:
            sums = [total([col(k) for k in keys]) for keys in r.either]
            last = F.coalesce(*sums)
            rhs.append(last)
            terms.append(last)
            missing.append(last.isNull())
            bad = [F.when(s.isNotNull(), total([(~ok(k)).cast("int") for k in keys]) > 0) for s, keys in zip(sums, r.either, strict=True)]
            strange.append(F.coalesce(*bad, F.lit(False)))
            used = F.concat(used, F.coalesce(*[F.when(s.isNotNull(), F.array(*map(F.lit, keys))) for s, keys in zip(sums, r.either, strict=True)], F.expr("cast(array() as array<string>)")))
        lhs, rhs_ = total([col(k) for k in r.lhs]).cast(MONEY), total(rhs).cast(MONEY)
        any_ = lambda xs: F.coalesce(F.array_max(F.array(*xs)), F.lit(False))
        w, x, y, d, t = (F.col(f"_{c}{i}") for c in ("why", "lhs", "rhs", "diff", "tolerance"))
        why[f"_why{i}"] = F.when(any_(missing), MISSING).when(any_(strange), INCOMPARABLE)
        figures |= {f"_{c}{i}": F.when(w.isNull(), v) for c, v in (("lhs", lhs), ("rhs", rhs_), ("tolerance", _allowed(terms, tolerance)))}
        diffs[f"_diff{i}"] = (x - y).cast(MONEY)
        status = F.coalesce(w, F.when(F.abs(d) <= t, PASSED).otherwise(FAILED))
        out.append(F.struct(F.lit(r.key).alias("rule_key"), F.lit(r.severity).alias("severity"), status.alias("status"), *[v.alias(k) for k, v in {"lhs": x, "rhs": y, "diff": d, "tolerance": t}.items()], used.alias("inputs")))
    return wide.withColumns(why).withColumns(figures).withColumns(diffs).select(*by, F.inline(F.array(*out)))


def summary(checks: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome; failures of errors are hard, others soft."""
    status, severity = F.col("status"), F.col("severity")
    return checks.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(status.isin(PASSED, FAILED)).alias("evaluable"), F.count_if(status == PASSED).alias("passed"),
        F.count_if((status == FAILED) & (severity == "error")).alias("failed_hard"), F.count_if((status == FAILED) & (severity != "error")).alias("failed_soft"),
        F.count_if(status == MISSING).alias("skipped_missing"), F.count_if(status == INCOMPARABLE).alias("skipped_incomparable"),
    )


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unreadable(df: DataFrame, text: str, kind: str = MONEY) -> DataFrame:
    """Rows whose text is there but no number: to be reported, never read as 0."""
    return df.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(text).try_cast(kind).isNull())
