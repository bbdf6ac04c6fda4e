"""Operator 8: mix sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steelyard.llm.common import WORD, materialize, shuffle_partitions, table

#: Rows in a range of the sampling key, about; each (source, range) is prefix-summed by itself.
RANGE_ROWS = 1 << 18
#: A word of letters, with one mark of punctuation behind it at most.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?]?+(?![^\x20\x09-\x0D])"
#: The least weight, so that every document can be drawn.
LEAST = 0.05
#: The columns that mix() adds.
ADDED = ("size", "source_size", "target", "taken")


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """The share of a text's words that are letters alone, but for a mark of punctuation at the end; 0.05 at least."""
    plain = F.coalesce(F.regexp_count(F.col(text), F.lit(PLAIN)), F.lit(0))
    return F.greatest(plain / F.greatest(n_words(text), F.lit(1)), F.lit(LEAST))


def targets(sizes: DataFrame, *, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(_s, source_size)`` to the same plus ``target``: the budget ``share`` of all sizes by weight, capped.

    Sources in the order of ``_s`` weigh ``weights`` in turn. Resharing the excess by weight until no
    target is above ``most`` times its source's size ends at ``min(cap, level * weight)`` with one level
    for all; in order of ``cap / weight`` the capped sources come first, so running sums find the level.
    The table has a row per source, never one per document.
    """
    turn = (F.row_number().over(Window.orderBy("_s")) - 1) % len(weights) + 1
    all_ = Window.partitionBy()
    earlier = Window.orderBy(F.col("_cap") / F.col("_w"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.select("*", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).alias("_w"), (F.lit(most) * F.col("source_size")).alias("_cap"))
    left = F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    weight_left = F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    ranked = ranked.select("*", (left / weight_left).alias("_level"))
    # the first source that its own level leaves under its cap sets the level of all that follow
    free = F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_s", "_level"))).over(all_)
    return ranked.select("_s", "source_size", F.least("_cap", F.coalesce(free["_level"] * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weight: Column | None = None, keep_text: bool = False, split: bool = True, **plan) -> DataFrame:
    """Decide how many words of each row the mix takes: the columns of ``docs`` (the text only with
    ``keep_text``) plus ``size``, ``source_size``, ``target`` and ``taken``.

    ``target div source_size`` complete epochs take every document whole; the rest of the budget goes to
    documents in order of the exponential key ``-ln(u) / weight``, with ``u`` a hash of key and seed,
    along a running sum. The document that crosses the budget is taken in part (its leading words), or
    without ``split`` whole or not at all, whichever is nearer. The running sum has two levels: sampled
    splitters of source, key, text and place cut the rows into ranges, their number by the input, and sums
    run inside a range's share of a source and over those shares' totals, so no task gathers a source, a
    weight or a key. ``weight`` is positive; null counts as the least weight.

    A null text has size 0 and takes 0; a very long text is one row like others; a null source is a source
    of its own, last in order; equal keys are ordered by the text's hash and repeated rows each count; a
    null key is drawn by its text; an empty table gives no rows; input columns with the names of added ones
    give way.
    """
    spark, weight = docs.sparkSession, quality_weight(text) if weight is None else weight
    # a row without a key is drawn by its text, so such rows don't all come at one place
    by = F.coalesce(F.col(key).cast("string"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), by)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    kept = [c for c in docs.columns if c.lower() not in ADDED and (keep_text or c != text)]
    s = F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))
    # the row's own columns stay together, so none of them meets a name used here; _n names the row from here on
    sized = docs.select(F.struct(*kept).alias("_row"), F.col(key).alias("_id"), n_words(text).alias("size"), (-F.log(u) / F.greatest(F.coalesce(weight, F.lit(LEAST)), F.lit(1e-9))).alias("_k"), F.xxhash64(text).alias("_t"), s.alias("_s"))
    sized = materialize(sized.withColumn("_n", F.monotonically_increasing_id()), "mix")
    place = ["_k", "_id", "_t", "_n"]
    parts = max(shuffle_partitions(spark), -(-sized.count() // RANGE_ROWS))
    slim = sized.drop("_row").repartitionByRange(parts, "_s", *place).withColumn("_r", F.spark_partition_id())
    slim = materialize(slim, "mix")
    ranges = slim.groupBy("_s", "_r").agg(F.sum("size").alias("_in"))
    earlier = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    wanted = targets(ranges.groupBy("_s").agg(F.sum("_in").alias("source_size")), **plan)
    ranges = ranges.select("_s", "_r", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before")).join(wanted, "_s")
    inside = Window.partitionBy("_s", "_r").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    out = slim.withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["_s", "_r"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size") - F.col("_before") - F.col("_run")
    if split:
        part = F.least(F.greatest(F.round(rest), F.lit(0.0)), F.col("size"))
    else:
        part = F.when(rest * 2 > F.col("size"), F.col("size")).otherwise(0)
    out = out.select("_n", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))
    return sized.select("_n", "_row").join(out, "_n").select("_row.*", *ADDED)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``taken`` holds it whole (rows of no words: none)."""
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)
    kept = [c for c in mixed.columns if c.lower() not in ADDED]
    whole = mixed.where(F.col("taken") >= F.greatest("size", F.lit(1)))
    return whole.select(F.struct(*kept).alias("_row"), F.explode(F.sequence(F.lit(1), times.cast("int")))).select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", *ADDED)


SQL_OP8 = r"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (
  SELECT doc_id, source, len(words) AS size, len(list_filter(words, lambda x: regexp_full_match(x, '\p{L}+[.,;:!?]?'))) AS plain,
         (CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM w),
k AS (SELECT *, -ln(u) / greatest(plain::DOUBLE / greatest(size, 1), 0.05::DOUBLE) AS k FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
g AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER o, 0))
              / ((SELECT sum(w) FROM g) - coalesce(sum(w) OVER o, 0)) AS level
      FROM g WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / w) AS free FROM l WHERE level * w < cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT free FROM f) * w, cap)) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(greatest(round(target - epochs * source_size - run), 0), size) AS BIGINT) AS taken
FROM r
"""
