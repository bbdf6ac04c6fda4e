"""The diagnosis index with its gates, its grade and the scenario weights it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steelyard.functions.numeric import quantize

#: Base and weights of history, current, risk, template and quality.
BASE, H, C, R, P, Q = 50, 20, 20, 5, 10, 15
HIGH, LOW, COVERAGE, OBSERVATIONS = 70, 45, "0.60", 5
#: Scenario weights by grade.
WEIGHTS = {"high": ("0.60", "0.25", "0.15"), "medium": ("0.50", "0.20", "0.30"), "low": ("0.35", "0.15", "0.50")}


def claim_score(s: Column) -> Column:
    """A score of a claim; anything but -1, 0 and 1 raises."""
    return F.when(s.isin(-1, 0, 1) | s.isNull(), s).otherwise(F.raise_error(F.lit("a claim scores -1, 0 or 1")).cast("int"))


def bucket(claim_period: Column, report_period: Column) -> Column:
    """A claim on a year after its report is history's forecast (H), any other one current (C)."""
    return F.when(claim_period > report_period, "H").otherwise("C")


def history_current(scored: DataFrame, by: list[str]) -> DataFrame:
    """``h, c``: equal-weight means of the scores by bucket, null where a bucket is empty; ``n`` scored."""
    mean = lambda b: quantize((F.sum(F.when(F.col("bucket") == b, claim_score(F.col("score")))).cast("decimal(20,6)") / F.nullif(F.count(F.when(F.col("bucket") == b, F.col("score"))), F.lit(0)).cast("decimal(20,6)")), 6)
    return scored.groupBy(*by).agg(mean("H").alias("h"), mean("C").alias("c"), F.count("score").alias("n"))


def diagnosis(df: DataFrame) -> DataFrame:
    """Add ``gates, score, grade`` to rows of ``h, c, r, p, q, n, total``.

    The gates are coverage n / total, the number of observations, both claim means and the three
    components; where one fails there is no score and the grade is ``insufficient``.
    """
    x = {k: F.col(k).cast("decimal(20,6)") for k in "hcrpq"}
    raw = F.lit(BASE).cast("decimal(20,6)") + H * x["h"] + C * x["c"] + R * x["r"] - P * x["p"] - Q * x["q"]
    coverage = F.coalesce((F.col("total") > 0) & (F.col("n").cast("decimal(20,6)") >= F.lit(COVERAGE).cast("decimal(6,4)") * F.col("total")), F.lit(False))
    gate = lambda name, ok: F.struct(F.lit(name).alias("gate"), ok.alias("passed"))
    gates = [gate("coverage", coverage), gate("observations", F.coalesce(F.col("n") >= OBSERVATIONS, F.lit(False))), gate("claims", x["h"].isNotNull() & x["c"].isNotNull()), gate("components", x["r"].isNotNull() & x["p"].isNotNull() & x["q"].isNotNull())]
    out = df.withColumn("gates", F.array(*gates))
    score = F.when(F.forall("gates", lambda g: g["passed"]), quantize(F.least(F.greatest(raw, F.lit(0)), F.lit(100)).cast("decimal(20,8)"), 6))
    return out.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def grade(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score < LOW, "low").when(score.isNotNull(), "medium").otherwise("insufficient")


def scenario_weights(df: DataFrame, weights: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Add ``base, optimistic, stress`` by grade; an insufficient grade has none. Weights that don't sum to
    1 raise."""
    weights = WEIGHTS if weights is None else weights
    for name, w in weights.items():
        if abs(sum(map(float, w)) - 1) > 1e-9:
            raise ValueError(f"the weights of {name} don't sum to 1")
    pick = lambda i: F.coalesce(*[F.when(F.col("grade") == g, F.lit(w[i]).cast("decimal(4,2)")) for g, w in weights.items()])
    return df.withColumns({name: pick(i) for i, name in enumerate(("base", "optimistic", "stress"))})


def drill_down(claims: DataFrame, risks: DataFrame, templates: DataFrame, qualities: DataFrame) -> DataFrame:
    """The rows behind the five components, as ``component, key, detail``."""
    own = lambda df, c: df.select(F.lit(c).alias("component") if c else F.lower("bucket").alias("component"), "key", F.col("detail").cast("string").alias("detail"))
    return own(claims, "").unionByName(own(risks, "r")).unionByName(own(templates, "p")).unionByName(own(qualities, "q"))
