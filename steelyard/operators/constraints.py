"""Constraints as queries that return the rows which break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steelyard.sources import store

#: Rows of a task where all of a table is grouped or joined.
ROWS = 500_000


def unique(df: DataFrame, key: list[str], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return store.spread(rows.select(*key), ROWS, *key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("unique").alias("rule"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("key"))


def foreign_key(df: DataFrame, column: str, parent: DataFrame, key: str, row: str) -> DataFrame:
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_c"), F.col(row).alias("_row"))
    n = store.tasks(rows, ROWS)
    # both sides are dealt to as many tasks, so neither is dealt out again
    rows, p = rows.repartition(n, "_c"), parent.select(F.col(key).alias("_p")).repartition(n, "_p")
    return rows.join(p, F.col("_c") == F.col("_p"), "left_anti").select(F.lit(f"foreign_key {column}").alias("rule"), F.col("_row").cast("string").alias("key"))


def check(df: DataFrame, rule: str, holds: Column, row: str) -> DataFrame:
    """Rows for which the condition is false; as in SQL an unknown one passes."""
    return df.where(~holds).select(F.lit(rule).alias("rule"), F.col(row).cast("string").alias("key"))


def allowed(df: DataFrame, column: str, values: list[str], row: str) -> DataFrame:
    return check(df, f"enum {column}", F.col(column).isin(values), row)


def fact_violations(facts: DataFrame, metrics: DataFrame, files: DataFrame) -> DataFrame:
    """All rules of the fact table: natural key, provenance of what is validated, reasons of what isn't
    comparable, period kinds, and references."""
    key = ["project_id", "company_id", "metric_key", "period", "period_kind", "scope", "restated"]
    proven = F.col("source_file_id").isNotNull() & F.col("source_page").isNotNull() & (F.length(F.trim(F.coalesce("source_text", F.lit("")))) > 0)
    out = unique(facts, key)
    out = out.unionByName(foreign_key(facts, "metric_key", metrics, "metric_key", "fact_id")).unionByName(foreign_key(facts, "source_file_id", files, "file_id", "fact_id"))
    out = out.unionByName(check(facts, "validated has provenance", (F.col("status") != "validated") | proven, "fact_id"))
    out = out.unionByName(check(facts, "incomparable has reason", F.col("comparable") | (F.length(F.trim(F.coalesce("incomparable_reason", F.lit("")))) > 0), "fact_id"))
    return out.unionByName(allowed(facts, "period_kind", ["current", "instant"], "fact_id"))


def observation_violations(observations: DataFrame, key: list[str]) -> DataFrame:
    """One adopted sighting per key at most; adopted ones name a fact, rejected ones a reason, pending none."""
    o = observations
    out = unique(o, key, F.col("resolution") == "adopted")
    out = out.unionByName(check(o, "adopted names a fact", (F.col("resolution") != "adopted") | F.col("resolved_fact_id").isNotNull(), "observation_id"))
    out = out.unionByName(check(o, "rejected says why", (F.col("resolution") != "rejected") | (F.length(F.coalesce("rejection_note", F.lit(""))) > 0), "observation_id"))
    return out.unionByName(check(o, "pending names no fact", (F.col("resolution") != "pending") | F.col("resolved_fact_id").isNull(), "observation_id"))


def dictionary_problems(metrics: DataFrame) -> DataFrame:
    """Problems of a metric dictionary ``metric_key, aliases, exclusion_terms, value_type, unit_kind,
    parent_key``: unknown kinds, an alias that is excluded too, text with a number's unit, parents that
    don't exist or lead back at any depth, and an alias of two metrics."""
    m = metrics
    out = allowed(m, "value_type", ["flow", "stock", "ratio", "text"], "metric_key")
    out = out.unionByName(check(m, "alias is excluded", ~F.arrays_overlap("aliases", "exclusion_terms"), "metric_key"))
    out = out.unionByName(check(m, "text has no unit", (F.col("value_type") != "text") | (F.col("unit_kind") == "text"), "metric_key"))
    out = out.unionByName(foreign_key(m, "parent_key", m, "metric_key", "metric_key"))
    out = out.unionByName(unique(m.select("metric_key", F.explode(F.array_distinct("aliases")).alias("alias")), ["alias"]))
    return out.unionByName(parent_loops(m).select(F.lit("parent loop").alias("rule"), "key"))


def parent_loops(metrics: DataFrame) -> DataFrame:
    """``key`` of the metrics that are their own ancestor, however far up.

    Doubling: each metric knows the ancestor 2^k steps up, and the smallest key met on the way with the steps to it.
    Metrics without so many ancestors drop out. One whose smallest key is its own stands in a loop, and the steps are the
    loop's length; those that have met it lead into a loop that is known and drop out too. So the rounds follow the
    longest way into a loop or to a metric without a parent, not the number of metrics. A loop's own members are
    those that the walk from its smallest key passes; only metrics that lead into a loop are looked at for that.
    """
    parents = metrics.where("parent_key IS NOT NULL").select(F.col("metric_key").alias("key"), F.col("parent_key").alias("at")).dropDuplicates(["key"])
    up = store.written(parents.withColumn("low", F.struct(F.col("at").alias("key"), F.lit(1).cast("long").alias("steps"))), "parents")
    one, steps = up.select("key", "at"), 1
    loops = met = None
    while not up.isEmpty():
        own = up.where("low.key = key").select("key", F.col("low.steps").alias("length"))
        if not own.isEmpty():
            own = store.written(own, "loops")
            inside = store.written(up.join(own.select(F.col("key").alias("_k")), F.col("low.key") == F.col("_k"), "left_semi").select("key"), "loops")
            loops, met = (own, inside) if loops is None else (loops.unionByName(own), met.unionByName(inside))
            up = up.join(inside, "key", "left_anti")
        further = up.select(F.col("key").alias("at"), F.col("at").alias("_at"), F.struct(F.col("low.key").alias("key"), (F.col("low.steps") + steps).alias("steps")).alias("_low"))
        up = store.written(up.join(further, "at").select("key", F.col("_at").alias("at"), F.least("low", "_low").alias("low")), "parents")
        steps *= 2
    if loops is None:
        return parents.select("key").limit(0)
    # all of a loop is reached by doubling from its smallest key
    reached, hop, steps, longest = loops.select("key"), one.join(met, "key", "left_semi"), 1, loops.agg(F.max("length")).first()[0]
    while steps < longest:
        reached = store.written(reached.unionByName(reached.join(hop, "key").select(F.col("at").alias("key"))).distinct(), "parents")
        steps *= 2
        if steps < longest:
            hop = store.written(hop.join(hop.select(F.col("key").alias("at"), F.col("at").alias("_at")), "at").select("key", F.col("_at").alias("at")), "parents")
    return reached
