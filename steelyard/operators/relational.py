"""Relational shapes: top rows, lookups with fallback, as-of markers, neighbours, merges and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.sources import store


def top1(df: DataFrame, by: list[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; the order has to end with a key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def dedup_priority(df: DataFrame, by: list[str], priority: Column, key: str) -> DataFrame:
    """One row of each group: the smallest priority, then the smallest key. The winner is found by a
    minimum that is combined before the shuffle, so a group of any size makes no hot task; its other
    columns come along in the minimum."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.min(F.struct(priority.alias("_p"), F.col(key).alias("_k"), F.struct(*rest).alias("_r"))).alias("_b"))
    return best.select(*by, "_b._r.*").select(*df.columns)


def fallback_lookup(df: DataFrame, facts: DataFrame, on: list[str], first: str, other: str) -> DataFrame:
    """Add ``value, metric_used, substituted``: the fact of metric ``first``, or of ``other`` where the
    first is absent for that key."""
    one = facts.where(F.col("metric_key") == first).select(*on, F.col("value").alias("_a"))
    two = facts.where(F.col("metric_key") == other).select(*on, F.col("value").alias("_b"))
    out = df.join(one, on, "left").join(two, on, "left")
    used = F.when(F.col("_a").isNotNull(), first).when(F.col("_b").isNotNull(), other)
    return out.withColumns({"value": F.coalesce("_a", "_b"), "metric_used": used, "substituted": F.col("_a").isNull() & F.col("_b").isNotNull()}).drop("_a", "_b")


def last_marker(df: DataFrame, by: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """Add the nearest marker at or before each row: backward as-of lookup and carried state in one scan."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def neighbours(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add ``previous, next, first, last`` of ``order`` in each group."""
    w, every = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    return df.withColumns({"previous": F.lag(order).over(w), "next": F.lead(order).over(w), "first": F.min(order).over(every), "last": F.max(order).over(every)})


def nearest_containing(needles: DataFrame, pages: DataFrame, key: str, page: str, snippet: str, text: str, reach: int = 2) -> DataFrame:
    """For each needle the page within ``reach`` of its own that contains its snippet, nearest first, then
    the earlier one: ``key, page, found, distance``. The range join is an equality on the exploded pages."""
    around = needles.withColumn("_at", F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)))
    hits = around.join(pages.select(F.col(page).alias("_at"), F.col(text).alias("_t")), "_at").where(F.col("_t").contains(F.col(snippet)))
    hits = hits.withColumn("distance", F.abs(F.col("_at") - F.col(page)))
    best = hits.groupBy(key).agg(F.min(F.struct("distance", F.col("_at").alias("found"))).alias("_b")).select(key, "_b.*")
    return needles.select(key, page).join(best, key, "left")


def unique_prefix(left: DataFrame, right: DataFrame, key: str, name: str, prefix: int) -> DataFrame:
    """Match names exactly, else by being a prefix of exactly one other name: ``key, match, how``. Names
    shorter than ``prefix`` characters match exactly or not at all.

    In sorted order the names that a name begins follow it, so each looks at the next two, which a frame that
    only grows carries along from the end: nothing meets all others of its beginning. Rows are cut into
    ranges of that order by Spark's own sampled borders, with the key last so that equal names are cut as
    well, and what lies beyond a range is carried over in two names for each range.
    """
    r = right.where(F.col(name).isNotNull()).select(F.lit(None).cast(dict(left.dtypes)[key]).alias("_k"), F.col(name).alias("_n"), F.lit(1).alias("_r")).distinct()
    both = left.where(F.col(name).isNotNull()).select(F.col(key).alias("_k"), F.col(name).alias("_n"), F.lit(0).alias("_r")).unionByName(r)
    order = [F.col("_n").desc(), F.col("_r").desc(), F.col("_k")]
    # written, since borders that are sampled again may differ
    both = store.written(both.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "names")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("_r") == 1, F.col("_n"))
    both = both.withColumn("_next", F.last(own, ignorenulls=True).over(w))
    ends = both.groupBy("_p").agg(F.min(F.when(F.col("_r") == 1, F.struct(F.col("_n").alias("a"), F.col("_next").alias("b")))).alias("_e")).select("_p", "_e.*")
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.withColumn("_a", F.last("a", ignorenulls=True).over(over))
    ends = ends.withColumn("_b", F.last(F.when(F.col("a").isNotNull(), F.struct(F.coalesce("b", "_a").alias("b"))), ignorenulls=True).over(over)["b"]).select("_p", "_a", "_b")
    pair = F.last(F.when(F.col("_r") == 1, F.struct(F.col("_n").alias("a"), F.col("_next").alias("b"))), ignorenulls=True).over(w)
    found = both.withColumn("_in", pair).where("_r = 0").join(ends, "_p")
    near = F.struct(F.coalesce("_in.a", "_a").alias("a"), F.when(F.col("_in").isNull(), F.col("_b")).otherwise(F.coalesce("_in.b", "_a")).alias("b"))
    found = found.withColumn("_p", near)
    begins = lambda c: F.coalesce((F.length("_n") >= prefix) & F.col(c).startswith(F.col("_n")), F.lit(False))
    how = F.when(F.col("_p.a") == F.col("_n"), "exact").when(begins("_p.a") & begins("_p.b"), "ambiguous").when(begins("_p.a"), "prefix").otherwise("none")
    found = found.withColumn("how", how)
    absent = left.where(F.col(name).isNull()).select(key, F.lit(None).cast("string").alias("match"), F.lit("none").alias("how"))
    return found.select(F.col("_k").alias(key), F.when(F.col("how").isin("exact", "prefix"), F.col("_p.a")).alias("match"), "how").unionByName(absent)


def alias_lookup(aliases: DataFrame, normalize, industry: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lookup, conflicts)`` of ``metric_key, alias, rank``: the normalized alias maps to the key that
    ranks first, and every other key that claims it is reported. With an ``industry`` only its own metrics and those of
    all industries count, by the column ``industry``, since an alias may mean different things in different ones."""
    if industry is not None:
        aliases = aliases.where(F.coalesce("industry", F.lit("")).isin("", industry))
    names = aliases.select("metric_key", "rank", normalize(F.col("alias")).alias("label")).where("label <> ''")
    first = names.groupBy("label").agg(F.min(F.struct("rank", "metric_key")).alias("_f")).select("label", F.col("_f.metric_key").alias("metric_key"))
    clash = names.join(first.withColumnRenamed("metric_key", "winner"), "label").where("metric_key <> winner").select("label", "metric_key", "winner").distinct()
    return first, clash


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key, in all columns; keys are unique on either side."""
    rest = [c for c in old.columns if c not in key]
    a, b = old.select(*key, F.struct(*rest).alias("_a")), new.select(*key, F.struct(*rest).alias("_b"))
    return a.join(b, key, "full_outer").select(*key, F.coalesce("_b", "_a").alias("_r")).select(*key, "_r.*")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti").select(*old.columns))


def prune_stale(old: DataFrame, fresh: DataFrame, key: str, text: str, confirmed: str) -> DataFrame:
    """What becomes of each old row: ``key, action, target``.

    Rows that are still extracted stay; of the rest unconfirmed ones are deleted, confirmed ones are
    pointed to the one fresh row with their text, or demoted if there is none or more than one.
    """
    still = fresh.select(F.col(key).alias("_k"))
    by_text = fresh.groupBy(text).agg(F.count("*").alias("_n"), F.min(key).alias("_t"))
    out = old.join(still, F.col(key) == F.col("_k"), "left").join(by_text, text, "left")
    action = F.when(F.col("_k").isNotNull(), "keep").when(~F.col(confirmed), "delete").when(F.col("_n") == 1, "repoint").otherwise("demote")
    return out.select(key, action.alias("action"), F.when(action == "repoint", F.col("_t")).alias("target"))


def adopt(observations: DataFrame, key: list[str]) -> DataFrame:
    """Resolve sightings of one fact: the report of the fact's own year first, then the newest report, then
    the smallest id is adopted; the others are rejected with what they differ in.

    ``observations`` has ``observation_id, report_year, period, value`` and the key. Adds ``resolution``
    and ``note``.
    """
    own = (F.col("report_year") != F.col("period")).cast("int")
    best = observations.groupBy(*key).agg(F.min(F.struct(own.alias("o"), (-F.col("report_year")).alias("y"), "observation_id", "value")).alias("_b"))
    out = observations.join(best, key)
    won = F.col("observation_id") == F.col("_b.observation_id")
    note = F.when(won, None).when(F.col("value") == F.col("_b.value"), "same value").otherwise(F.concat(F.lit("adopted "), F.col("_b.value").cast("string")))
    return out.withColumns({"resolution": F.when(won, "adopted").otherwise("rejected"), "note": note}).drop("_b")


def streaks(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """The longest run of consecutive available rows in which the flag holds."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.select(*by, order, F.coalesce(flag, F.lit(False)).alias("_f"))
    x = x.withColumn("_g", F.row_number().over(w) - F.sum(F.col("_f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(*by, "_g").agg(F.count_if("_f").alias("_n"))
    return runs.groupBy(*by).agg(F.max("_n").alias("longest"))


def scope(extractor: str = "extractor", prefix: str = "rule", include_background: bool = False, background: str = "is_background") -> Column:
    """Rows of extractors with a prefix, without background rows unless they are asked for."""
    own = F.col(extractor).startswith(prefix)
    return own if include_background else own & ~F.coalesce(F.col(background), F.lit(False))


def argmax_argmin(df: DataFrame, by: list[str], label: str, value: str) -> DataFrame:
    """The labels of the largest and smallest value; of equal ones the smallest label."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))).alias("_a"), F.min(F.struct(F.col(value).alias("v"), F.col(label).alias("l"))).alias("_b")).select(*by, F.col("_a.l").alias("peak"), F.col("_b.l").alias("trough"))
