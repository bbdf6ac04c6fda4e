"""Queries that run as streams to their end, and a few more on claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY
from steelyard.operators import relational as rel
from steelyard.operators import verdicts
from steelyard.plans.analysis import CLAIMS_CTE, _claims
from steelyard.plans.text import _PAIRS, LEGAL
from steelyard.sources import store
from steelyard.sources.tables import table
from steelyard.streaming import bus
from steelyard.streaming import events as ev


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. A stream reads a folder or a pattern, and the pattern fits a table that
    is one file as well."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _ended(df: DataFrame) -> DataFrame:
    """Run a stream over all there is, into the shared folder, and read what it wrote."""
    home = store.scratch(df.sparkSession, "stream")
    writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{home}/out")


def transition_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state checked as they come, with the last state of each user kept as Spark's state."""
    e = _stream(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    return _ended(ev.transition_stream(e, "user_id", "event_type", LEGAL))


def channel_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of each user's events get who have seen some of them, from a stream that numbers events and holds
    the last 40 of a user."""
    e = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"), F.col("event_type").alias("type"))
    readers = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("task"), F.lit(None).cast("timestamp").alias("ts"), F.lit("r").alias("reader"), (F.col("user_id") % 90).cast("long").alias("after")).distinct()
    readers = spark.readStream.schema(readers.schema).parquet(store.written_to(readers, "readers"))
    with bus.state_store(spark):
        out = _ended(bus.channel(e.unionByName(readers, allowMissingColumns=True), history=40, kept_ms=0))
    return out.where("reader IS NOT NULL").select("task", "seq", "type", "kind")


def window_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and type, once the watermark has passed the hour."""
    out = _ended(ev.event_counts_stream(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def claim_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one extractor family, no background, one of each text: documents stand for the claims."""
    d = table(spark, sf_dir, "documents")
    x = d.select(F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("claim_id"), F.sha1("text").alias("digest"), F.when(F.col("doc_id") % 3 == 0, "llm-v1").when(F.col("doc_id") % 5 == 0, "retired").otherwise("rule-v2").alias("extractor"), (F.col("doc_id") % 11 == 0).alias("is_background"))
    both = x.where(rel.scope(prefix="rule") | rel.scope(prefix="llm"))
    return rel.dedup_priority(both, ["digest"], (~F.col("extractor").startswith("rule")).cast("int"), "claim_id").select("claim_id", "extractor")


def theme_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by metric, one column for each verdict."""
    v = verdicts.narrative_judge(_claims(spark, sf_dir))
    kinds = ["missing", "incomparable", "consistent", "conflict", "undirected"]
    return v.groupBy(F.coalesce("primary_metric", F.lit("none")).alias("metric")).pivot("verdict", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


TALLY_SQL = f"""
WITH {CLAIMS_CTE}, tx AS (SELECT coalesce(m, 'none') AS metric, dir, CASE WHEN cv > bv THEN 'up' WHEN cv < bv THEN 'down' WHEN cv = bv THEN 'flat' END AS ch FROM j),
tv AS (SELECT metric, CASE WHEN ch IS NULL THEN 'missing' WHEN ch = 'flat' THEN 'incomparable' WHEN dir = ch THEN 'consistent' WHEN dir IN ('up', 'down') THEN 'conflict' ELSE 'undirected' END AS v FROM tx)
SELECT metric, count(*) FILTER (v = 'missing') AS missing, count(*) FILTER (v = 'incomparable') AS incomparable, count(*) FILTER (v = 'consistent') AS consistent, count(*) FILTER (v = 'conflict') AS conflict, count(*) FILTER (v = 'undirected') AS undirected FROM tv GROUP BY 1
"""


def narrative_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headline for each project from its counts: conflicts first, then too little evidence, else consistent."""
    v = verdicts.narrative_judge(_claims(spark, sf_dir)).groupBy("project_id").agg(F.count_if(F.col("verdict") == "conflict").alias("conflicts"), F.count_if(F.col("verdict").isin("consistent", "conflict")).alias("judged"), F.count("*").alias("claims"))
    headline = F.when(F.col("judged") == 0, "nothing_to_judge").when(F.col("conflicts") * 2 > F.col("judged"), "mostly_in_conflict").when(F.col("conflicts") > 0, "some_conflicts").otherwise("consistent")
    return v.withColumn("headline", headline)


SUMMARY_SQL = f"""
WITH {CLAIMS_CTE}, x AS (SELECT project_id, dir, CASE WHEN cv > bv THEN 'up' WHEN cv < bv THEN 'down' END AS ch FROM j),
g AS (SELECT project_id, count(*) FILTER (ch IS NOT NULL AND dir IN ('up', 'down') AND dir <> ch) AS conflicts, count(*) FILTER (ch IS NOT NULL AND dir IN ('up', 'down')) AS judged, count(*) AS claims FROM x GROUP BY 1)
SELECT *, CASE WHEN judged = 0 THEN 'nothing_to_judge' WHEN conflicts * 2 > judged THEN 'mostly_in_conflict' WHEN conflicts > 0 THEN 'some_conflicts' ELSE 'consistent' END AS headline FROM g
"""


def legacy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of old records brought to current ones by a lookup; others stay as they are."""
    moved = spark.createDataFrame([("ECONOMY", "basic"), ("PROMO", "special")], "legacy_key string, metric_key string")
    p = table(spark, sf_dir, "part").join(F.broadcast(moved), F.col("p_type") == F.col("legacy_key"), "left")
    return p.groupBy(F.coalesce("metric_key", "p_type").alias("metric_key")).agg(F.count("*").alias("n"), F.count("legacy_key").alias("moved"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of JSON, money as text."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return store.as_text(o).select(F.to_json(F.struct("*")).alias("line"))


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that take an absent number as none, by role and in all."""
    c = table(spark, sf_dir, "conversations").select("role", F.when(F.col("turn") % 4 != 3, F.char_length("text")).alias("n"))
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.coalesce("n", F.lit(0))).alias("tokens"))


def running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's revenue as a share of its region's."""
    t = lambda n: table(spark, sf_dir, n)
    x = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast(MONEY).alias("revenue"))
    x = x.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    total = F.sum("revenue").over(Window.partitionBy("n_regionkey")).cast(MONEY)
    return x.select("n_name", "revenue", F.bround(F.try_divide(F.col("revenue"), total), 6).cast("double").alias("share"))


CHANNEL_SQL = """
WITH e AS (SELECT user_id, CAST(user_id AS VARCHAR) AS task, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS type FROM events),
l AS (SELECT user_id, any_value(task) AS task, max(seq) AS last, user_id % 90 AS after FROM e GROUP BY user_id)
SELECT e.task, seq, type, 'event' AS kind FROM e JOIN l ON l.user_id = e.user_id WHERE seq > last - 40 AND seq > after
UNION ALL SELECT task, last - 40, NULL, 'truncated' FROM l WHERE after < last - 40
"""

QUERIES = {
    "channel_stream": (channel_stream, CHANNEL_SQL),
    "transition_stream": (transition_stream, f"SELECT CAST(user_id AS VARCHAR) AS task, event_id AS seq, lag(event_type) OVER w AS previous, event_type AS state, lag(event_type) OVER w IS NULL OR lag(event_type) OVER w || '>' || event_type IN ({_PAIRS}) AS legal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "window_counts_stream": (window_counts_stream, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2"),
    "claim_scope": (claim_scope, """WITH x AS (SELECT 'c' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS claim_id, text, CASE WHEN doc_id % 3 = 0 THEN 'llm-v1' WHEN doc_id % 5 = 0 THEN 'retired' ELSE 'rule-v2' END AS extractor, doc_id % 11 = 0 AS bg FROM documents)
        SELECT claim_id, extractor FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN extractor LIKE 'rule%' THEN 0 ELSE 1 END, claim_id) AS n FROM x WHERE NOT bg AND (extractor LIKE 'rule%' OR extractor LIKE 'llm%')) WHERE n = 1"""),
    "theme_tally": (theme_tally, TALLY_SQL),
    "narrative_summary": (narrative_summary, SUMMARY_SQL),
    "legacy_keys": (legacy_keys, "SELECT CASE p_type WHEN 'ECONOMY' THEN 'basic' WHEN 'PROMO' THEN 'special' ELSE p_type END AS metric_key, count(*) AS n, count(*) FILTER (p_type IN ('ECONOMY', 'PROMO')) AS moved FROM part GROUP BY 1"),
    "snapshot": (snapshot, """SELECT '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"price":"' || CAST(o_totalprice AS DECIMAL(12,2)) || '"}' AS line FROM orders"""),
    "token_totals": (token_totals, "SELECT role, count(*) AS calls, CAST(sum(CASE WHEN turn % 4 <> 3 THEN coalesce(length(text), 0) ELSE 0 END) AS BIGINT) AS tokens FROM conversations GROUP BY 1"),
    "running_share": (running_share, """WITH x AS (SELECT c_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(20,6)) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT n_name, revenue, CAST(round_even(CAST(revenue / sum(revenue) OVER (PARTITION BY n_regionkey) AS DECIMAL(38,18)), 6) AS DOUBLE) AS share FROM x JOIN nation ON c_nationkey = n_nationkey"""),
}
