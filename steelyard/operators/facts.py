"""Sightings to facts: units by the metric, and a merge that never overwrites what a report first said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY, to_millions, to_tonnes
from steelyard.sources import schema, store

#: What a fact is about.
KEY = ["project_id", "company_id", "metric_key", "period", "period_kind", "scope"]
# The unit of each kind, and the metrics of currency that are stated per share.
UNITS = {"currency": "百万元", "percent": "%", "ton": "吨", "days": "天", "shares": "股", "quantity": "数量", "text": "文本"}
PER_SHARE, PER_SHARE_UNIT = ("eps_basic", "eps_diluted", "bvps"), "元/股"
EXTRACTOR = "rule:pages-v1"


def kinds(spark: SparkSession) -> DataFrame:
    """``metric_key, value_type, unit_kind`` of the dictionary."""
    return spark.createDataFrame([(k, value, "per_share" if k in PER_SHARE else unit) for k, _, value, unit, *_ in schema.DICTIONARY], "metric_key string, value_type string, unit_kind string")


def scaled(value: Column, unit: Column, unit_kind: Column) -> Column:
    """Money in millions and quantities in tonnes by their printed unit, null for a unit that isn't known; shares
    of a whole, figures per share and anything else as printed."""
    return F.when(unit_kind == "currency", to_millions(value, unit)).when(unit_kind == "ton", to_tonnes(value, unit)).otherwise(value).cast(MONEY)


def unit_of(unit_kind: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in (UNITS | {"per_share": PER_SHARE_UNIT}).items() for x in pair])
    return F.coalesce(F.try_element_at(names, unit_kind), F.lit(UNITS["quantity"]))


def resolve(seen: DataFrame, facts: DataFrame | None = None, before: DataFrame | None = None, *, now: str = "") -> tuple[DataFrame, DataFrame]:
    """``(observations, facts)`` after a batch of sightings.

    ``seen`` and ``before`` (earlier sightings, resolved) are of the schema ``fact_observation``, ``facts`` of
    ``financial_fact``. Of a key's new sightings that of the report of the period's own year counts, then the
    newest report's, then the smallest id. A key without a fact gets one, marked restated if another sighting of
    the batch differs. A fact that is there is never changed: an equal value refers to it, a different one stands
    beside it as a restated twin, once however often it comes. A key has one adopted sighting for ever; later
    ones are rejected, as are values that are null. Sightings that are in ``before`` already add nothing.

    Keys are grouped and joined, a key at a time; a key has a few sightings a report. Null key columns are keys
    of their own; an empty batch returns what was there.
    """
    spark = seen.sparkSession
    facts = schema.empty(spark, "financial_fact") if facts is None else facts
    before = schema.empty(spark, "fact_observation") if before is None else before
    columns = before.columns
    known = before.select("observation_id")
    new = seen.join(known, "observation_id", "left_anti").dropDuplicates(["observation_id"])
    unread = new.where("value IS NULL").withColumns({"resolution": F.lit("rejected"), "resolved_fact_id": F.lit(None).cast("string"), "rejection_note": F.lit("no value in a known unit")})
    new = new.where("value IS NOT NULL").withColumn("_k", F.struct(*KEY))  # compared as a whole, nulls included
    other_year = F.coalesce(F.col("report_year") != F.col("period").try_cast("int"), F.lit(True)).cast("int")
    best = F.min(F.struct(other_year.alias("o"), (-F.col("report_year")).alias("y"), "observation_id", "value", "source_file_id", "source_page", "source_text"))
    picks = new.groupBy("_k").agg(best.alias("_b"), F.array_sort(F.collect_set(F.struct("value", "source_file_id"))).alias("_all"))
    differ = F.filter("_all", lambda s: s["value"] != F.col("_b.value"))
    picks = picks.withColumn("_differ", differ)
    there = facts.groupBy(F.struct(*KEY).alias("_k")).agg(F.min(F.when(~F.col("restated"), F.struct("created_at", "fact_id", "value"))).alias("_base"), F.min("fact_id").alias("_any"), F.collect_set(F.when(F.col("restated"), F.struct("value", "fact_id"))).alias("_twins"))
    adopted = before.where("resolution = 'adopted'").groupBy(F.struct(*KEY).alias("_k")).agg(F.min("observation_id").alias("_adopted"))
    picks = _left(_left(picks, there), adopted)
    twin = F.get(F.array_sort(F.transform(F.filter("_twins", lambda t: t["value"] == F.col("_b.value")), lambda t: t["fact_id"])), F.lit(0))
    parts = [F.coalesce(F.col(f"_k.{c}"), F.lit("")) for c in KEY]
    fresh = F.when(F.col("_any").isNull(), store.content_id("fact-", *parts)).otherwise(store.content_id("fact-", *parts, F.col("_b.value").cast("string")))
    same = F.col("_base").isNull() | (F.col("_base.value") == F.col("_b.value"))
    old = F.when(F.col("_any").isNotNull(), F.when(same, F.coalesce("_base.fact_id", "_any")).otherwise(twin))
    said = F.array_join(F.transform(F.slice("_differ", 1, 3), lambda s: F.concat(s["source_file_id"], F.lit(" "), s["value"].cast("string"))), "; ")
    first = F.when(F.col("_base.value").isNotNull() & ~same, F.concat(F.lit("stated before: "), F.col("_base.value").cast("string")))
    note = F.nullif(F.concat_ws("; ", F.when(F.size("_differ") > 0, F.concat(F.lit("also stated: "), said)), first), F.lit(""))
    picks = picks.withColumns({"_old": old, "_fact": F.coalesce(old, fresh), "_note": note, "_restated": F.col("_any").isNotNull() | (F.size("_differ") > 0)})
    unit = picks.withColumn("metric_key", F.col("_k.metric_key")).join(F.broadcast(kinds(spark)), "metric_key", "left")
    primary = F.coalesce(F.col("_k.company_id") == F.col("_k.project_id"), F.lit(False))
    made = unit.where("_old IS NULL").select(
        F.col("_fact").alias("fact_id"), "_k.project_id", "_k.company_id", primary.alias("is_primary"), "metric_key", F.col("_b.value").alias("value"), unit_of(F.col("unit_kind")).alias("unit"), "_k.period", "_k.period_kind", "_k.scope",
        "_b.source_file_id", "_b.source_page", "_b.source_text", F.lit(1.0).alias("confidence"), F.lit("validated").alias("status"), F.col("_restated").alias("restated"), F.lit(True).alias("comparable"),
        F.lit(None).cast("string").alias("incomparable_reason"), F.lit(EXTRACTOR).alias("extractor"), F.lit(now).alias("created_at"), F.col("_note").alias("restatement_note"),
    )
    x = _left(new, picks.select("_k", F.col("_b.observation_id").alias("_won"), "_fact", "_adopted", F.col("_b.value").alias("_v")))
    won = (F.col("observation_id") == F.col("_won")) & F.col("_adopted").isNull()
    why = F.when(F.col("_adopted").isNotNull(), F.concat(F.lit("adopted before: "), "_adopted")).when(F.col("value") == F.col("_v"), "same value").otherwise("another value stands")
    x = x.withColumns({"resolution": F.when(won, "adopted").otherwise("rejected"), "resolved_fact_id": F.when(won, F.col("_fact")), "rejection_note": F.when(~won, why)})
    out = before.unionByName(x.select(*columns)).unionByName(unread.select(*columns))
    return out, facts.unionByName(made.select(*facts.columns))


def _left(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on the key as a whole, in which nulls are equal."""
    right = right.withColumnRenamed("_k", "_r")
    return left.join(right, F.col("_k").eqNullSafe(F.col("_r")), "left").drop("_r")
