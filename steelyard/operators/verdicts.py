"""Verdicts on claims: one ordered chain of conditions, whose order is the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steelyard.functions.numeric import quantize, quotient
from steelyard.functions.refusal import refusal

#: Changes up to these are no change.
BANDS = {"ratio": "0.005", "days": "3", "utilization": "0.01", "amount": "0.01"}
TARGET_BAND = "0.005"
#: Units of targets that are ratios.
RATIO_UNITS = ("%", "％", "个百分点")
#: Metrics that are better when lower.
LOWER_IS_BETTER = ("operating_cost", "selling_expense", "admin_expense", "finance_expense", "accounts_receivable", "inventory", "dso", "inventory_days")


def _d(x: str) -> Column:
    return F.lit(x).cast("decimal(10,6)")


def classify_change(kind: Column, current: Column, base: Column, bands: dict[str, str] | None = None) -> Column:
    """up, down or flat by the kind of metric; null for an amount whose base is 0 or less. A ratio or
    utilization outside 0 to 1 raises, for percentages would silence every band."""
    b = BANDS if bands is None else bands
    shares = kind.isin("ratio", "utilization")
    outside = shares & ((current < 0) | (current > 1) | (base < 0) | (base > 1))
    diff = F.abs(current - base)
    flat = F.when(kind == "ratio", diff <= _d(b["ratio"])).when(kind == "days", diff <= _d(b["days"])).when(kind == "utilization", diff <= _d(b["utilization"])).otherwise(F.abs(quotient(current - base, base, 12)) <= _d(b["amount"]))
    amount = ~kind.isin("ratio", "days", "utilization")
    return (
        F.when(outside, F.raise_error(F.lit("ratios are stored as 0 to 1")).cast("string"))
        .when(amount & (base <= 0), F.lit(None).cast("string"))
        .when(flat, "flat").when(current > base, "up").when(current < base, "down")
    )


def expected_change(direction: Column, metric: Column) -> Column:
    lower = metric.isin(*LOWER_IS_BETTER)
    return (
        F.when(direction.isin("up", "down", "flat"), direction)
        .when(direction == "improve", F.when(lower, "down").otherwise("up"))
        .when(direction == "deteriorate", F.when(lower, "up").otherwise("down"))
        .otherwise("unknown")
    )


def is_explicit_target(value: Column, unit: Column, bound: Column, is_plan: Column) -> Column:
    """A number is a target if it is a rate, has a bound or is planned; others report what happened."""
    return value.isNotNull() & (F.coalesce(unit.isin(*RATIO_UNITS), F.lit(False)) | F.coalesce(bound.isin("at_least", "at_most"), F.lit(False)) | F.coalesce(is_plan, F.lit(False)))


def judge(claims: DataFrame, *, bands: dict[str, str] | None = None, scope_break: str | None = None, legacy: bool = False) -> DataFrame:
    """Add ``verdict, reason, change, deviation`` to claims joined with their facts.

    ``claims`` has ``primary_metric, period_norm, direction, magnitude_value, magnitude_unit, bound,
    is_plan, metric_kind`` and the facts' ``current_value, current_comparable, current_period,
    base_value, base_comparable, base_period``. Targets use no band. A claimed fall of a rate is compared
    with the fall and points of percentage are scaled like percents; ``legacy`` ignores both.
    """
    c = {k: F.col(k) for k in ("primary_metric", "period_norm", "direction", "magnitude_value", "magnitude_unit", "bound", "is_plan", "metric_kind", "current_value", "current_comparable", "current_period", "base_value", "base_comparable", "base_period")}
    kind, cur, base = F.coalesce(c["metric_kind"], F.lit("amount")), c["current_value"], c["base_value"]
    absent = cur.isNull() & c["current_period"].isNull()
    strange = ~F.coalesce(c["current_comparable"], F.lit(True)) | (c["base_period"].isNotNull() & ~F.coalesce(c["base_comparable"], F.lit(True)))
    broken = (c["base_period"] <= scope_break) & (F.lit(scope_break) < c["current_period"]) if scope_break else F.lit(False)
    target = is_explicit_target(c["magnitude_value"], c["magnitude_unit"], c["bound"], c["is_plan"])
    rate = F.coalesce(c["magnitude_unit"].isin(*RATIO_UNITS), F.lit(False))
    percent = F.coalesce(c["magnitude_unit"].isin(*(RATIO_UNITS[:2] if legacy else RATIO_UNITS)), F.lit(False))
    wanted = F.when(percent, c["magnitude_value"] / 100).otherwise(c["magnitude_value"]).cast("decimal(20,8)")
    if not legacy:
        wanted = F.when(c["direction"] == "down", -wanted).otherwise(wanted)
    actual = F.when((kind == "amount") & (base > 0), quotient(cur - base, base, 8)).when(kind == "ratio", cur)
    deviation = quantize((actual - wanted).cast("decimal(20,8)"), 6)
    # a fall of at least 5 percent is met at -6: bounds turn with the sign
    turned = F.lit(False) if legacy else F.coalesce(c["direction"] == "down", F.lit(False))
    met = (
        F.when(F.coalesce(c["bound"], F.lit("exact")) == "exact", F.abs(deviation) <= _d(TARGET_BAND))
        .when(c["bound"] == "at_least", F.when(turned, deviation <= 0).otherwise(deviation >= 0))
        .when(c["bound"] == "at_most", F.when(turned, deviation >= 0).otherwise(deviation <= 0))
        .otherwise(F.lit(False))
    )
    ready = ~absent & ~target & c["base_period"].isNotNull() & base.isNotNull() & ~strange
    change = F.when(ready, classify_change(kind, cur, base, bands))
    expected = expected_change(c["direction"], c["primary_metric"])
    chain = [
        (c["primary_metric"].isNull(), "unverifiable", "no_metric"), (c["period_norm"].isNull(), "unverifiable", "no_period"), (absent, "unverifiable", "no_fact"),
        (strange, "incomparable", "incomparable"), (broken, "incomparable", "scope_break"),
        (target & ~kind.isin("ratio", "amount"), "needs_review", "target_kind"), (target & (c["bound"] == "about") & rate, "needs_review", "about"),
        (target & ~rate, "needs_review", "absolute_target"), (target & (kind == "amount") & F.coalesce(base <= 0, F.lit(True)), "needs_review", "base_not_positive"),
        (target & met, "supported", "target_met"), (target, "contradicted", "target_missed"),
        (c["base_period"].isNull() | base.isNull(), "needs_review", "no_base"), (change.isNull(), "needs_review", "base_not_positive"),
        (expected == "unknown", "needs_review", "no_direction"), (change == "flat", "neutral", "in_band"), (change == expected, "supported", "same_direction"), (F.lit(True), "contradicted", "other_direction"),
    ]
    shown = F.when(target & rate & ~strange & ~absent, deviation)
    return claims.withColumns({"verdict": refusal([(a, v) for a, v, _ in chain]), "reason": refusal([(a, r) for a, _, r in chain]), "change": change, "deviation": shown})


def absolute_variance(claims: DataFrame) -> DataFrame:
    """Targets in units of their own never score: ``variance`` of the fact from the target in millions or
    tonnes, ``side`` by the metric's sign, and why it can't be shown."""
    from steelyard.functions.numeric import to_millions, to_tonnes

    target = F.when(F.col("metric_unit_kind") == "currency", to_millions(F.col("magnitude_value"), F.col("magnitude_unit"))).when(F.col("metric_unit_kind") == "ton", to_tonnes(F.col("magnitude_value"), F.col("magnitude_unit")))
    code = refusal([(~F.coalesce("target_metric_aligned", F.lit(False)), "not_aligned"), (~F.col("metric_unit_kind").isin("currency", "ton"), "unit_kind"), (target.isNull(), "unit_factor"), (F.col("current_value").isNull(), "no_fact")])
    variance = F.when(code.isNull(), F.col("current_value") - target)
    lower = F.col("metric_sign") == "cost"
    side = F.when(variance == 0, "met").when((variance > 0) != F.coalesce(lower, F.lit(False)), "better").when(variance.isNotNull(), "worse")
    return claims.withColumns({"target": target, "variance": variance, "side": side, "refused": code, "verdict": F.lit("needs_review")})


def budget_attainment(claims: DataFrame, scope_break: str | None = None) -> DataFrame:
    """Planned against reached, for projects that enable it: reports up to the break year and facts that are
    pending are left out, other units are refused, else the plan is met or not."""
    early = (F.col("report_period") <= scope_break) if scope_break else F.lit(False)
    code = refusal([(~F.coalesce("enabled", F.lit(False)), "not_enabled"), (early, "transition_year"), (F.col("current_value").isNull(), "pending"), (F.col("magnitude_unit") != F.col("current_unit"), "unit"), (F.col("magnitude_value").isNull(), "no_target")])
    variance = F.when(code.isNull(), F.col("current_value") - F.col("magnitude_value"))
    verdict = F.when(variance >= 0, "supported").when(variance.isNotNull(), "contradicted").when(code.isin("transition_year"), "incomparable").when(code == "pending", "unverifiable").otherwise("needs_review")
    return claims.withColumns({"variance": variance, "refused": code, "verdict": verdict})


def narrative_judge(claims: DataFrame) -> DataFrame:
    """The other judge, without bands: any change has a direction, equal values can't be compared, and a claim
    with a value missing is missing. ``claims`` has ``direction, current_value, base_value``."""
    cur, base = F.col("current_value"), F.col("base_value")
    change = F.when(cur > base, "up").when(cur < base, "down").when(cur == base, "flat")
    verdict = F.when(change.isNull(), "missing").when(change == "flat", "incomparable").when(F.col("direction") == change, "consistent").when(F.col("direction").isin("up", "down"), "conflict").otherwise("undirected")
    return claims.withColumns({"change": change, "verdict": verdict})


def score(verdict: Column) -> Column:
    return F.when(verdict == "supported", 1).when(verdict == "neutral", 0).when(verdict == "contradicted", -1)


def summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """n of N: scored claims among those that can be; what needs review stays in N."""
    v = F.col("verdict")
    return judged.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(v.isin("supported", "neutral", "contradicted")).alias("n"), F.count_if(~v.isin("unverifiable", "incomparable")).alias("possible"), *[F.count_if(v == k).alias(k) for k in ("supported", "neutral", "contradicted", "needs_review")])
