"""Recorded answers to claims: shape checked, the rest quarantined, each quote found on its page or sent to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions import text
from steelyard.sources import store

OTHER, BUDGET = "other", "management_budget"
#: Quotes of fewer characters stand everywhere, so they are located nowhere.
SHORTEST = 6
FIELDS = "text string, claim_type string, metric_key string, confidence string"


def bare(quote: Column) -> Column:
    """Without white space, which an answer doesn't keep."""
    return F.regexp_replace(quote, r"(?U)\s+", "")


def _shape(response: Column) -> Column:
    """What is wrong with an answer as a whole; null if nothing is."""
    claims = F.get_json_object(response, "$.claims")
    items = F.from_json(F.concat(F.lit('{"claims":'), claims, F.lit("}")), "claims array<string>")["claims"]
    lacks = F.exists(items, lambda c: ~F.coalesce(c.startswith("{"), F.lit(False)) | ~F.coalesce(F.array_contains(F.json_object_keys(c), "text"), F.lit(False)))
    whole = F.json_object_keys(response).isNotNull() & F.try_parse_json(response).isNotNull()
    return F.when(~F.coalesce(whole, F.lit(False)), "no object").when(F.json_array_length(claims).isNull(), "claims is no list").when(F.coalesce(lacks, F.lit(False)), "a claim without text")


def read_answers(answers: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(claims, quarantine)`` of answers ``section_id, response`` with any other columns.

    An answer that isn't an object with a list of objects that all have a text is quarantined whole, with its reason, and
    makes no claim. In the others a theme that isn't known is ``other``, a metric that isn't in ``metrics`` (``metric_key``,
    the dictionary) gives way to its theme's, and a confidence that is no number is 0. ``n`` is the claim's place.
    """
    x = answers.withColumn("reason", _shape(F.col("response")))
    quarantine = x.where("reason IS NOT NULL")
    own = [c for c in answers.columns if c != "response"]
    items = F.from_json(F.concat(F.lit('{"claims":'), F.get_json_object("response", "$.claims"), F.lit("}")), "claims array<string>")["claims"]
    x = x.where("reason IS NULL").select(*own, F.posexplode(items).alias("n", "_c")).withColumn("_c", F.from_json("_c", FIELDS))
    names = [t.name for t in text.THEMES]
    theme = F.when(F.col("_c.claim_type").isin(*names, BUDGET), F.col("_c.claim_type")).otherwise(OTHER)
    first = F.create_map(*[F.lit(v) for t in text.THEMES for v in (t.name, t.metric)])
    x = x.withColumns({"claim_type": theme, "_m": F.col("_c.metric_key")})
    known = metrics.select(F.col("metric_key").alias("_m"), F.lit(True).alias("_known")).distinct()
    x = x.join(F.broadcast(known), "_m", "left")  # as many rows as the dictionary has
    metric = F.when(F.col("_known"), F.col("_m")).otherwise(F.try_element_at(first, F.col("claim_type")))
    confidence = F.coalesce(F.col("_c.confidence").try_cast("double"), F.lit(0.0))
    return x.select(*own, "n", F.coalesce("_c.text", F.lit("")).alias("claim_text"), "claim_type", metric.alias("primary_metric"), confidence.alias("confidence")), quarantine


def located(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``page_no``, the first of the section's pages (``file_id, page_from, page_to``) on which the claim's text begins,
    white space aside, and ``needs_review``, whether there is none. ``pages`` has ``file_id, page_no, text``; a text may run
    on to the next page. A quote meets the pages of its own section alone; one of fewer
    than six characters is sent to review."""
    key = ["section_id", "n"]
    own = pages.select("file_id", "page_no", bare(F.coalesce("text", F.lit(""))).alias("_page"))
    own = own.withColumn("_next", F.coalesce(F.lead("_page").over(Window.partitionBy("file_id").orderBy("page_no")), F.lit("")))
    asked = claims.withColumn("_quote", bare(F.col("claim_text")))
    spread = asked.where(F.length("_quote") >= SHORTEST).select("file_id", *key, "_quote", F.explode(F.sequence("page_from", F.coalesce("page_to", "page_from"))).alias("page_no"))
    said = F.concat(F.col("_page"), F.substring(F.col("_next"), F.lit(1), F.length("_quote") - 1))
    found = spread.join(own, ["file_id", "page_no"]).where(said.contains(F.col("_quote"))).groupBy(*key).agg(F.min("page_no").alias("page_no"))
    return asked.drop("_quote").join(found, key, "left").withColumn("needs_review", F.col("page_no").isNull())


def answered_claims(requests: DataFrame, cassettes: DataFrame, pages: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From requests and recorded answers to located claims and the quarantine. ``requests`` has ``section_id, file_id,
    page_from, page_to, request``."""
    answers = store.replayed(requests, cassettes).drop("request", "key")
    claims, quarantine = read_answers(answers, metrics)
    return located(claims, pages), quarantine
