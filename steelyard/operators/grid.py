"""The fact grid: every metric in every declared year, found or not, with guarded growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import quotient
from steelyard.functions.refusal import refusal

#: Changes up to this are flat on the grid, whatever the rules say.
FLAT = 0.01


def verified(facts: DataFrame) -> DataFrame:
    """Facts that are validated and comparable."""
    return facts.where((F.col("status") == "validated") & F.col("comparable"))


def grid(projects: DataFrame, metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """Project x metric x declared year with its fact, if any: ``project_id, metric_key, period, position,
    value, comparable, status``.

    ``projects`` declares ``fiscal_years``; ``metrics`` is the dictionary, whose size doesn't grow with the
    facts. Of several facts for a cell the one that isn't restated, then the newest, then the smallest id
    stands; cells without a fact stay, as ``not_found``.
    """
    cells = projects.select("project_id", F.posexplode("fiscal_years").alias("position", "period"))
    cells = cells.crossJoin(F.broadcast(metrics.select("metric_key")))
    key = ["project_id", "metric_key", "period"]
    first = Window.partitionBy(*key).orderBy("restated", F.col("created_at").desc(), "fact_id")
    best = facts.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*key, "value", "comparable", "status")
    out = cells.join(best, key, "left")
    return out.select(*key, "position", "value", F.coalesce("comparable", F.lit(True)).alias("comparable"), F.coalesce("status", F.lit("not_found")).alias("status"))


def grid_growth(cells: DataFrame) -> DataFrame:
    """Add ``change, change_dir, change_refused`` against the neighbour in the declared years.

    The first year has neither; both cells must be comparable; a change within the flat band is flat.
    """
    w = Window.partitionBy("project_id", "metric_key").orderBy("position")
    before = {c: F.lag(c).over(w) for c in ("value", "period", "comparable")}
    out = cells.select("*", *[v.alias(f"_{k}") for k, v in before.items()])
    p, c = F.col("_value"), F.col("value")
    gap = F.col("period").try_cast("int") - F.col("_period").try_cast("int")
    first = F.col("_period").isNull()
    code = refusal([
        (~F.col("comparable") | ~F.coalesce("_comparable", F.lit(True)), "incomparable"), (p.isNull() | c.isNull(), "missing"),
        (gap.isNull(), "period_unparsable"), (gap != 1, "gap"), (p == 0, "zero_base"), (p < 0, "negative_base"),
    ])
    change = F.when(~first & code.isNull(), quotient(c - p, F.abs(p)))
    return out.select(*cells.columns, change.alias("change"), direction(change, FLAT).alias("change_dir"), F.when(~first, code).alias("change_refused"))


def direction(change: Column, flat: float) -> Column:
    return F.when(F.abs(change) <= F.lit(flat), "flat").when(change > 0, "up").when(change < 0, "down")


def pad(declared: DataFrame, recorded: DataFrame, key: list[str], *, status: str = "status", absent: str = "pending") -> DataFrame:
    """Declared keys and recorded rows together: recorded keys outside the declaration stay, declared ones
    without a row become ``absent``."""
    out = declared.select(*key, F.lit(True).alias("declared")).join(recorded, key, "full_outer")
    return out.withColumn(status, F.coalesce(status, F.lit(absent))).withColumn("declared", F.coalesce("declared", F.lit(False)))


def filled_years(cells: DataFrame) -> DataFrame:
    return cells.groupBy("project_id", "metric_key").agg(F.count("value").alias("filled"), F.count("*").alias("declared"))
