"""Queries on joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steelyard.functions.numeric import MONEY
from steelyard.operators import grid
from steelyard.operators import relational as rel
from steelyard.sources.tables import FACTS_SQL, annual, facts, table


def top1_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest order; of equals the earliest, then the smallest key."""
    return rel.top1(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


def dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each text: of src0 if there is one, else the smallest id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return rel.dedup_priority(docs, ["digest"], (F.col("source") != "src0").cast("int"), "doc_id")


def semi_join_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of promo lines that some open order has: by prefix, and by a semi join."""
    part, t = table(spark, sf_dir, "part"), lambda n: table(spark, sf_dir, n)
    open_ = t("lineitem").where("l_linestatus = 'O'").select("l_partkey")
    return part.where(F.col("p_type").startswith("PROMO")).join(open_, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who never placed an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per nation that a correlated subquery would give: grouped once each, 0 where there are none."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t("supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("debtors"))
    out = t("nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return out.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("debtors", F.lit(0)).alias("debtors"))


def left_join_on_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their finished urgent twin of the same customer and day, where the condition is part of
    the join: orders without one stay."""
    o = table(spark, sf_dir, "orders")
    b = o.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.min("o_orderkey").alias("twin"))
    return o.join(b, (F.col("o_custkey") == F.col("k")) & (F.to_date("o_orderdate") == F.col("d")), "left").select("o_orderkey", "twin")


def fallback_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume of each project and year, or the revenue where no volume is reported."""
    wide = annual(spark, sf_dir)
    return rel.fallback_lookup(wide.select("project_id", "period"), facts(wide), ["project_id", "period"], "steel_sales_volume", "revenue")


def base_year_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fact beside that of the year before, which may be absent."""
    f = facts(annual(spark, sf_dir)).select("project_id", "metric_key", "period", "value")
    base = f.select("project_id", "metric_key", (F.col("period").cast("int") + 1).cast("string").alias("period"), F.col("value").alias("base"))
    return f.join(base, ["project_id", "metric_key", "period"], "left")


def asof_backward_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup of each user at or before each of their events."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = rel.last_marker(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "signup_id")
    return out.select("event_id", "signup_id")


def adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


def nearest_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents, looked for in the documents within two of the number they are filed under."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    needles = d.select((F.col("doc_id")).alias("needle"), (F.col("doc_id") + F.col("doc_id") % 4 - 1).alias("page"), F.substring("text", 20, 40).alias("snippet"))
    return rel.nearest_containing(needles, d.select(F.col("doc_id").alias("page"), "text"), "needle", "page", "snippet", "text")


def unique_prefix_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of documents, re-keyed to whole texts; short ones match whole or not at all."""
    d = table(spark, sf_dir, "documents")
    left = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.substring("text", 1, 24)).alias("name"))
    out = rel.unique_prefix(left, d.select(F.col("text").alias("name")), "id", "name", 24)
    return out.select("id", F.sha2("match", 256).alias("match"), "how")


def _label(c):
    return F.lower(F.regexp_replace(c, r"[\s0-9.]+", ""))


def alias_lookup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as aliases of brands: the smallest part wins a name, other brands are reported."""
    a = table(spark, sf_dir, "part").select(F.col("p_brand").alias("metric_key"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("rank"))
    return rel.alias_lookup(a, _label)[1]


def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.col("p_brand").alias("metric_key"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("rank"))
    return rel.alias_lookup(a, _label)[0]


def pad_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared days of each event type (every second day) beside recorded purchases of over 90."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    declared = e.where("day(day) % 2 = 0").select("event_type", "day").distinct()
    recorded = e.where("value > 90").groupBy("event_type", "day").agg(F.count("*").alias("n")).withColumn("status", F.lit("recorded"))
    return grid.pad(declared, recorded, ["event_type", "day"]).select("event_type", F.col("day").cast("string").alias("day"), "declared", "n", "status")


def pad_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the four fixed items they may have; absent ones are pending."""
    e = table(spark, sf_dir, "events")
    items = spark.createDataFrame([("click",), ("purchase",), ("refund",), ("signup",)], "event_type string")
    declared = e.select("user_id").distinct().crossJoin(F.broadcast(items))
    recorded = e.join(F.broadcast(items), "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("status", F.lit("recorded"))
    return grid.pad(declared, recorded, ["user_id", "event_type"]).drop("declared")


def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("good"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"), F.sum(F.coalesce("quality", F.lit(0))).alias("quality"))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_shipdate").cast("string").alias("first"), F.max("l_quantity").alias("most"))


def argmax_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("v"))
    return rel.argmax_argmin(e, ["event_type"], "day", "v")


def adopt_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one order and number as sightings of one figure; suppliers stand for the reports."""
    x = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("int")).alias("observation_id"),
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 7).alias("report_year"), (F.col("l_orderkey") % 7).alias("period"), F.col("l_extendedprice").cast("decimal(12,2)").alias("value"))
    return rel.adopt(x, ["l_orderkey", "l_linenumber"])


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users by the events of the table's first half of days, and of its second."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    ends = e.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    e = e.join(F.broadcast(ends), F.lit(True)).withColumn("early", F.datediff("day", "d0") * 2 <= F.datediff("d1", "d0"))
    part = lambda early: e.where(F.col("early") == early).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))
    return part(True), part(False)


DAYS_SQL = """
b AS (SELECT min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) AS d1 FROM events),
e AS (SELECT user_id, event_id, date_diff('day', d0, CAST(ts AS DATE)) * 2 <= date_diff('day', d0, d1) AS early FROM events CROSS JOIN b),
o AS (SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM e WHERE early GROUP BY 1),
n AS (SELECT user_id, max(event_id) AS event_id, count(*) AS n FROM e WHERE NOT early GROUP BY 1)"""


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.upsert(*_days(spark, sf_dir), ["user_id"])


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.insert_ignore(*_days(spark, sf_dir), ["user_id"])


def stale_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the earlier extraction and as a fresh one, in which every third has a new id and every
    fifth another text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), (F.col("doc_id") % 4 == 0).alias("confirmed"))
    fresh = d.select(F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest")).alias("digest"))
    return rel.prune_stale(d, fresh, "doc_id", "digest", "confirmed")


def streak_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of days on which a type brought in less than its mean day."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("v"))
    mean = e.groupBy("event_type").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    return rel.streaks(e.join(mean, "event_type"), ["event_type"], "day", F.col("v") * F.col("c") < F.col("s"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by half of the month: in both, in one alone, and all together."""
    e = table(spark, sf_dir, "events")
    w = lambda a, b: e.where(F.dayofmonth("ts").between(a, b)).select("user_id")
    one, two = w(1, 15), w(16, 31)
    tag = lambda df, name: df.select("user_id", F.lit(name).alias("part"))
    return tag(one.intersect(two), "both").unionByName(tag(one.subtract(two), "left")).unionByName(tag(two.subtract(one), "joined")).unionByName(tag(one.union(two).distinct(), "any"))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as one table of parties; what one side lacks is null."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


def overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have the same part on a returned and on a kept line: no figure may stand on both sides."""
    back = (F.col("l_returnflag") == "R").cast("int")
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(back).alias("least"), F.max(back).alias("most"))
    return x.where("least < most").select("l_orderkey").distinct()


def truncated_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty dearest orders, and whether there are more: a top-k report reads one row over its limit."""
    k = 50
    top = table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(k + 1)
    every = Window.partitionBy()
    out = top.select("o_orderkey", "o_totalprice", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).alias("n"), (F.count("*").over(every) > k).alias("truncated"))
    return out.where(f"n <= {k}")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped counts in order of size, as compared between extractors."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.sum(F.col("value").cast("decimal(12,2)")).cast(MONEY).alias("total"))


def multi_value_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order all flags in order, and the first three prices that differ from the smallest."""
    x = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice").cast("decimal(12,2)"))
    g = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("f"), F.min("p").alias("m"), F.array_sort(F.collect_set("p")).alias("ps"))
    other = F.slice(F.filter("ps", lambda v: v != F.col("m")), 1, 3)
    return g.select("l_orderkey", F.array_join("f", "").alias("flags"), F.array_join(F.transform(other, lambda v: v.cast("string")), "; ").alias("others"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("p.k").alias("n"))


QUERIES = {
    "top1_per_group": (top1_per_group, "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1"),
    "dedup_priority": (dedup_priority, "SELECT doc_id, source, digest FROM (SELECT doc_id, source, sha256(text) AS digest, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) AS n FROM documents) WHERE n = 1"),
    "semi_join_scope": (semi_join_scope, "SELECT p_partkey, p_brand FROM part WHERE p_type LIKE 'PROMO%' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')"),
    "anti_join_missing": (anti_join_missing, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "scalar_counts": (scalar_counts, "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS debtors FROM nation"),
    "left_join_on_condition": (left_join_on_condition, "SELECT o.o_orderkey, t.twin FROM orders o LEFT JOIN (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS twin FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2) t ON t.k = o.o_custkey AND t.d = CAST(o.o_orderdate AS DATE)"),
    "fallback_metric": (fallback_metric, f"WITH {FACTS_SQL} SELECT a.project_id, a.period, coalesce(f.value, a.revenue) AS value, CASE WHEN f.value IS NOT NULL THEN 'steel_sales_volume' ELSE 'revenue' END AS metric_used, f.value IS NULL AS substituted FROM annual a LEFT JOIN facts f ON f.project_id = a.project_id AND f.period = a.period AND f.metric_key = 'steel_sales_volume'"),
    "base_year_join": (base_year_join, f"WITH {FACTS_SQL} SELECT f.project_id, f.metric_key, f.period, f.value, b.value AS base FROM facts f LEFT JOIN facts b ON b.project_id = f.project_id AND b.metric_key = f.metric_key AND CAST(b.period AS INT) = CAST(f.period AS INT) - 1"),
    "asof_backward_marker": (asof_backward_marker, "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM events"),
    "adjacent_turns": (adjacent_turns, "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "nearest_containment": (nearest_containment, """WITH n AS (SELECT doc_id AS needle, doc_id + doc_id % 4 - 1 AS page, substr(text, 20, 40) AS snippet FROM documents),
        h AS (SELECT needle, abs(d.doc_id - page) AS distance, d.doc_id AS found FROM n JOIN documents d ON d.doc_id BETWEEN page - 2 AND page + 2 AND contains(d.text, snippet)),
        b AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY distance, found) AS k FROM h)
        SELECT n.needle, n.page, b.distance, b.found FROM n LEFT JOIN b ON b.needle = n.needle AND k = 1"""),
    "unique_prefix_rekey": (unique_prefix_rekey, """WITH d AS (SELECT * FROM documents), r AS (SELECT DISTINCT text FROM d),
        l AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text ELSE substr(text, 1, 24) END AS name FROM d),
        m AS (SELECT id, count(*) AS n, min(r.text) AS m FROM l JOIN r ON starts_with(r.text, l.name) AND length(l.name) >= 24 GROUP BY 1)
        SELECT l.id, CASE WHEN e.text IS NOT NULL THEN sha256(e.text) WHEN n = 1 THEN sha256(m.m) END AS match,
               CASE WHEN e.text IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'prefix' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how
        FROM l LEFT JOIN r e ON e.text = l.name LEFT JOIN m ON m.id = l.id"""),
    "alias_lookup_conflicts": (alias_lookup_conflicts, """WITH a AS (SELECT p_brand AS metric_key, lower(regexp_replace(p_name, '[\\s0-9.]+', '', 'g')) AS label, p_partkey FROM part),
        f AS (SELECT label, arg_min(metric_key, p_partkey) AS winner FROM a GROUP BY 1) SELECT DISTINCT label, metric_key, winner FROM a JOIN f USING (label) WHERE metric_key <> winner"""),
    "alias_lookup": (alias_lookup, "SELECT lower(regexp_replace(p_name, '[\\s0-9.]+', '', 'g')) AS label, arg_min(p_brand, p_partkey) AS metric_key FROM part GROUP BY 1"),
    "pad_years": (pad_years, """WITH d AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events WHERE day(ts) % 2 = 0), r AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE value > 90 GROUP BY 1, 2)
        SELECT coalesce(d.event_type, r.event_type) AS event_type, CAST(coalesce(d.day, r.day) AS VARCHAR) AS day, d.day IS NOT NULL AS declared, n, CASE WHEN n IS NULL THEN 'pending' ELSE 'recorded' END AS status
        FROM d FULL JOIN r ON d.event_type = r.event_type AND d.day = r.day"""),
    "pad_items": (pad_items, """WITH d AS (SELECT user_id, unnest(['click', 'purchase', 'refund', 'signup']) AS event_type FROM (SELECT DISTINCT user_id FROM events)), r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT d.user_id, d.event_type, n, CASE WHEN n IS NULL THEN 'pending' ELSE 'recorded' END AS status FROM d LEFT JOIN r ON r.user_id = d.user_id AND r.event_type = d.event_type"""),
    "conditional_sums": (conditional_sums, "SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS good, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source"),
    "distinct_counts": (distinct_counts, "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS first, max(l_quantity) AS most FROM lineitem GROUP BY 1"),
    "argmax_argmin": (argmax_argmin, """WITH e AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(CAST(value AS DECIMAL(12,2))) AS v FROM events GROUP BY 1, 2)
        SELECT DISTINCT event_type, first_value(day) OVER (PARTITION BY event_type ORDER BY v DESC, day) AS peak, first_value(day) OVER (PARTITION BY event_type ORDER BY v, day) AS trough FROM e"""),
    "adopt_observation": (adopt_observation, """WITH x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS INT)) AS observation_id, l_orderkey, l_linenumber,
               l_suppkey % 7 AS report_year, l_orderkey % 7 AS period, CAST(l_extendedprice AS DECIMAL(12,2)) AS value FROM lineitem),
        b AS (SELECT *, first_value(observation_id) OVER w AS bo, first_value(value) OVER w AS bv FROM x WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN report_year <> period THEN 1 ELSE 0 END, -report_year, observation_id, value))
        SELECT observation_id, l_orderkey, l_linenumber, report_year, period, value, CASE WHEN observation_id = bo THEN 'adopted' ELSE 'rejected' END AS resolution,
               CASE WHEN observation_id = bo THEN NULL WHEN value = bv THEN 'same value' ELSE 'adopted ' || bv END AS note FROM b"""),
    "upsert_merge": (upsert_merge, f"WITH {DAYS_SQL} SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.n, o.n) AS n FROM o FULL JOIN n ON o.user_id = n.user_id"),
    "insert_ignore": (insert_ignore, f"WITH {DAYS_SQL} SELECT * FROM o UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM o)"),
    "stale_prune": (stale_prune, """WITH d AS (SELECT doc_id, text, doc_id % 4 = 0 AS c FROM documents),
        f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, text FROM d WHERE doc_id % 5 <> 0), t AS (SELECT text, count(*) AS n, min(doc_id) AS t FROM f GROUP BY 1),
        a AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 <> 0 THEN 'keep' WHEN NOT c THEN 'delete' WHEN n = 1 THEN 'repoint' ELSE 'demote' END AS action, t FROM d LEFT JOIN t ON t.text = d.text)
        SELECT doc_id, action, CASE WHEN action = 'repoint' THEN t END AS target FROM a"""),
    "streak_max": (streak_max, """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(12,2))) AS v FROM events GROUP BY 1, 2),
        f AS (SELECT *, v * count(*) OVER (PARTITION BY event_type) < sum(v) OVER (PARTITION BY event_type) AS low, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM e),
        g AS (SELECT *, i - sum(CAST(low AS INT)) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM f)
        SELECT event_type, max(n) AS longest FROM (SELECT event_type, g, count(*) FILTER (low) AS n FROM g GROUP BY 1, 2) GROUP BY 1"""),
    "set_operations": (set_operations, """WITH a AS (SELECT DISTINCT user_id FROM events WHERE day(ts) BETWEEN 1 AND 15), b AS (SELECT DISTINCT user_id FROM events WHERE day(ts) BETWEEN 16 AND 31)
        SELECT user_id, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT user_id, 'joined' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT user_id, 'any' FROM (SELECT * FROM a UNION SELECT * FROM b)"""),
    "union_by_name": (union_by_name, "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier"),
    "overlap_violations": (overlap_violations, "SELECT DISTINCT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_returnflag = 'R' AND b.l_returnflag <> 'R'"),
    "truncated_top": (truncated_top, "SELECT o_orderkey, o_totalprice, n, (SELECT count(*) FROM orders) > 50 AS truncated FROM (SELECT *, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS n FROM orders) WHERE n <= 50"),
    "event_counts": (event_counts, "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS large, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(20,6)) AS total FROM events GROUP BY 1"),
    "multi_value_collect": (multi_value_collect, """WITH x AS (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem), g AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS f, min(p) AS m, list_sort(list_distinct(list(p))) AS ps FROM x GROUP BY 1)
        SELECT l_orderkey, array_to_string(f, '') AS flags, array_to_string(list_transform(list_filter(ps, lambda v: v <> m)[1:3], lambda v: CAST(v AS VARCHAR)), '; ') AS others FROM g"""),
    "json_props": (json_props, "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k, count(json_extract(props, '$.k')) AS n FROM events GROUP BY 1"),
}
