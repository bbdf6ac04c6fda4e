"""Queries on text, search, events and constraints. The vocabulary is neutral: the given texts are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steelyard.functions import numeric, text
from steelyard.operators import constraints, extraction, narrative, search
from steelyard.sources import store
from steelyard.sources.tables import table
from steelyard.streaming import events as ev

THEMES = (text.Theme("first", "revenue", ("the ", "tion ", "eau")), text.Theme("second", None, ("ing ", "ed ", "ment", "que"), False), text.Theme("third", "volume", ("ung", "ción", "th")))
WORDS = text.Directions(improve=("ther", "ieux"), deteriorate=("worthless", "idiot"), up=("tion", "ment"), down=("ing", "heit"), flat=("stable",), negation=("not", "ne "), modality=("would", "will"), clause=".,\n", ambiguous=())
UNITS = (("km", "1000"), ("%", "0.01"), ("m", "1"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text"), ends=".!?").alias("s"))
    return d.select("doc_id", F.posexplode("s").alias("n", "sentence"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.char_length("sentence")).alias("chars"), F.min(F.sha1("sentence")).alias("digest"))


_NUM = r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)"
_ROW = rf"(CASE WHEN length(regexp_replace(x, '[ \t\n\x0b\f\r]', '', 'g')) > 0 THEN len(regexp_extract_all(x, '[0-9]')) / length(regexp_replace(x, '[ \t\n\x0b\f\r]', '', 'g')) ELSE 0 END > 0.35 OR regexp_matches(x, '(?:{_NUM}[ \t\n\x0b\f\r]+){{2,}}{_NUM}') OR regexp_matches(x, '(?:\|[^|]*){{2,}}'))"
SENTENCES_CTE = rf"""
j AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT {_ROW} AND trim(x) <> ''), lambda x: trim(x)), ' ') AS t FROM documents),
s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(t, '([.!?])', '\1' || chr(1), 'g'), chr(1)))) AS sentence FROM j),
k AS (SELECT * FROM s WHERE length(sentence) >= 8)"""


def table_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.is_table_row(F.col("line"))).alias("rows"))


def theme_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the theme that most of their words call; of equals the first theme."""
    s = _sentences(spark, sf_dir).select("doc_id", text.match_theme(F.col("sentence"), THEMES).alias("m"))
    return s.where("m IS NOT NULL").groupBy("m.theme", "m.usable").agg(F.count("*").alias("sentences"), F.sum("m.hits").alias("hits"))


_HITS = ", ".join(f"{' + '.join(f'CAST(contains(sentence, {t!r}) AS INT)' for t in th.triggers)} AS h{i}" for i, th in enumerate(THEMES))
THEME_SQL = f"""
WITH {SENTENCES_CTE}, h AS (SELECT {_HITS} FROM k),
m AS (SELECT CASE WHEN h0 >= h1 AND h0 >= h2 THEN 'first' WHEN h1 >= h2 THEN 'second' ELSE 'third' END AS theme, greatest(h0, h1, h2) AS hits FROM h)
SELECT theme, theme <> 'second' AS usable, count(*) AS sentences, CAST(sum(hits) AS BIGINT) AS hits FROM m WHERE hits > 0 GROUP BY 1
"""


def theme_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each theme in each document."""
    s = _sentences(spark, sf_dir).withColumn("theme", text.match_theme(F.col("sentence"), THEMES)["theme"]).where("theme IS NOT NULL")
    return s.groupBy("doc_id", "theme").agg(F.min(F.struct("n", F.sha1("sentence").alias("digest"))).alias("f")).select("doc_id", "theme", "f.digest")


THEME_FIRST_SQL = f"""
WITH {SENTENCES_CTE.replace("s AS (SELECT doc_id, trim(unnest(", "s AS (SELECT doc_id, generate_subscripts(p, 1) AS n, trim(unnest(p)) AS sentence FROM (SELECT doc_id, ").replace(", chr(1)))) AS sentence FROM j)", ", chr(1)) AS p FROM j))")},
h AS (SELECT doc_id, n, sentence, {_HITS} FROM k), m AS (SELECT *, CASE WHEN h0 >= h1 AND h0 >= h2 THEN 'first' WHEN h1 >= h2 THEN 'second' ELSE 'third' END AS theme FROM h WHERE greatest(h0, h1, h2) > 0)
SELECT doc_id, theme, sha1(arg_min(sentence, n)) AS digest FROM m GROUP BY 1, 2
"""


def sentence_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by direction, anchored in the words of their theme."""
    s = _sentences(spark, sf_dir)
    d = text.direction(F.col("sentence"), F.array(F.lit("the"), F.lit("que"), F.lit("der"), F.lit("los")), WORDS)
    return s.groupBy(d["direction"].alias("direction"), d["intended"].alias("intended")).agg(F.count("*").alias("sentences"))


def _held(word: str, anchored: bool, negated: bool) -> str:
    near = lambda c: "(" + " OR ".join(f"contains({c}, '{a}')" for a in ("the", "que", "der", "los")) + ")"
    at = f"list_position(list_transform(c, lambda x: contains(x, '{word}')), true)"
    first = f"c[{at}]"
    out = [f"contains(sentence, '{word}')", f"{at} > 0"]
    if anchored:
        out.append(f"({near(first)} OR ({at} > 1 AND {near(f'coalesce(c[{at} - 1], {chr(39)}{chr(39)})')}))")
    if negated:
        before = f"string_split({first}, '{word}')[1]"
        out.append(f"NOT (contains({before}, 'not') OR contains({before}, 'ne '))")
    return "(" + " AND ".join(out) + ")"


DIRECTION_SQL = f"""
WITH {SENTENCES_CTE}, q AS (SELECT sentence, regexp_split_to_array(sentence, '[.,\\n]') AS c FROM k),
d AS (SELECT CASE WHEN {_held('ther', True, False)} OR {_held('ieux', True, False)} THEN 'improve' WHEN {_held('worthless', True, False)} OR {_held('idiot', True, False)} THEN 'deteriorate'
             WHEN {_held('tion', False, True)} OR {_held('ment', False, True)} THEN 'up' WHEN {_held('ing', False, True)} OR {_held('heit', False, True)} THEN 'down' WHEN contains(sentence, 'stable') THEN 'flat' ELSE 'unknown' END AS direction,
             contains(sentence, 'would') OR contains(sentence, 'will') AS intended FROM q)
SELECT direction, intended, count(*) AS sentences FROM d GROUP BY 1, 2
"""


def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in documents in base units, by unit: ``total`` is the exact sum of all that have at most 18
    digits before and 10 after the point, ``unfit`` counts those that have more and aren't in it."""
    n = table(spark, sf_dir, "documents").select(F.explode(text.numbers(F.col("text"), UNITS)).alias("x"))
    plain = F.regexp_replace("x.raw", ",", "")
    written = F.when(~plain.rlike(r"\.[0-9]{10}[0-9]*[1-9]"), plain.try_cast("decimal(28,10)"))
    factor = F.create_map(*[F.lit(x) for u, f in UNITS for x in (u, f)])
    base = written * F.coalesce(F.try_element_at(factor, F.nullif(F.col("x.unit"), F.lit(""))), F.lit("1")).cast("decimal(6,2)")
    n = n.select("x", F.when(F.col("x.sign") < 0, -base).otherwise(base).alias("base"))
    return n.groupBy("x.unit").agg(F.count("*").alias("n"), F.try_sum("base").cast("double").alias("total"), F.max("x.places").alias("places"), F.count_if(F.col("base").isNull()).alias("unfit"))


NUMBER_SQL = rf"""
WITH m AS (SELECT unnest(regexp_extract_all(text, '[-−+]?{_NUM}[ \t\n\x0b\f\r]*(?:km|%|m)?')) AS m FROM documents),
x AS (SELECT regexp_extract(m, '{_NUM}') AS raw, regexp_extract(m, '(km|%|m)$', 1) AS unit, CASE WHEN regexp_matches(m, '^[-−]') THEN -1 ELSE 1 END AS sign FROM m)
SELECT unit, count(*) AS n, CAST(sum(v * sign * CASE unit WHEN 'km' THEN 1000 WHEN '%' THEN 0.01 ELSE 1 END) AS DOUBLE) AS total,
       max(CASE WHEN contains(raw, '.') THEN length(string_split(raw, '.')[-1]) ELSE 0 END) AS places, count(*) FILTER (v IS NULL) AS unfit
FROM (SELECT *, CASE WHEN NOT regexp_matches(raw, '\.[0-9]{{10}}[0-9]*[1-9]') THEN TRY_CAST(replace(raw, ',', '') AS DECIMAL(28,10)) END AS v FROM x) AS x
WHERE NOT (unit = '' AND regexp_matches(raw, '^(19|20)[0-9][0-9]$')) GROUP BY 1
"""


def number_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbers that aren't among those allowed."""
    ok = F.array(*[F.lit(x).cast("decimal(20,6)") for x in ("1", "2", "3", "10", "24", "100", "555")])
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = d.select("doc_id", F.size(text.numbers(F.col("text"), UNITS)).alias("checked"), F.size(text.unsupported_numbers(F.col("text"), ok, UNITS)).alias("bad"))
    return bad.where("checked > 0")


GUARD_SQL = rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[-−+]?{_NUM}[ \t\n\x0b\f\r]*(?:km|%|m)?')) AS m FROM documents),
x AS (SELECT doc_id, regexp_extract(m, '{_NUM}') AS raw, regexp_extract(m, '(km|%|m)$', 1) AS unit, CASE WHEN regexp_matches(m, '^[-−]') THEN -1 ELSE 1 END AS sign FROM m),
y AS (SELECT doc_id, CAST(replace(raw, ',', '') AS DOUBLE) * sign AS v, CASE WHEN contains(raw, '.') THEN length(string_split(raw, '.')[-1]) ELSE 0 END AS p, CASE unit WHEN 'km' THEN 1000.0 WHEN '%' THEN 0.01 ELSE 1.0 END AS f
      FROM x WHERE NOT (unit = '' AND regexp_matches(raw, '^(19|20)[0-9][0-9]$')))
SELECT doc_id, CAST(count(*) AS INT) AS checked, CAST(count(*) FILTER (len(list_filter([1.0, 2.0, 3.0, 10.0, 24.0, 100.0, 555.0], lambda a: abs(floor(a / f * pow(10.0, p) + 0.5 + 1e-9) / pow(10.0, p) - v) < 1e-9)) = 0) AS INT) AS bad FROM y GROUP BY 1
"""


def figure_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes printed in several ways, read back."""
    p = table(spark, sf_dir, "part")
    shown = F.element_at(F.array(F.format_string("%,d", F.col("p_size") * 1000), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")), F.concat(F.lit("（"), F.col("p_size").cast("string"), F.lit(".5）")), F.lit("--"), F.col("p_name")), (F.col("p_partkey") % 5 + 1).cast("int"))
    r = numeric.parse_figure(shown)
    return p.select("p_partkey", r["value"].alias("value"), r["is_dash"].alias("is_dash"))


FIGURE_SQL = """
SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size * 1000 WHEN 1 THEN -p_size WHEN 2 THEN -(p_size + 0.5) END AS DECIMAL(20,6)) AS value, p_partkey % 5 = 3 AS is_dash FROM part
"""


def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    label = F.concat(F.lit("1、 "), F.when(F.col("p_partkey") % 2 == 0, F.lit("其中：")).otherwise(""), F.col("p_name"), F.lit(" （"), F.col("p_type"), F.lit("）"))
    return p.select("p_partkey", text.normalize_label(label).alias("label"))


def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that best match a query, by score: a top-k report."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.trigram_search(d, "the and", key="doc_id")


TRIGRAM_SQL = """
WITH g AS (SELECT unnest(['the', 'he ', 'e a', ' an', 'and']) AS g), d AS (SELECT doc_id, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM documents),
n AS (SELECT count(*) AS n, avg(len) AS avg FROM d),
o AS (SELECT doc_id, g, len, len(list_filter(range(1, CAST(len AS INT) + 1), lambda i: substr(t, i, 3) = g)) AS tf, contains(t, 'the and') AS hit FROM d CROSS JOIN g WHERE contains(t, g)),
f AS (SELECT g, count(*) AS df FROM o GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) AS score
FROM o JOIN f ON f.g = o.g CROSS JOIN n WHERE hit GROUP BY 1 ORDER BY round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 6) DESC, doc_id LIMIT 20
"""


def short_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a short query, literally, with an excerpt."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.scan_search(d, "%", key="doc_id", limit=None)


def search_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several queries find, blank, short, long and with pattern characters, in some sources alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = None
    for q in ("  ", "zz", "the and", "_|", " eau "):
        one = search.search(d, q, key="doc_id", files=["src1", "src2", "src3"], file="source", limit=None).select(F.lit(q).alias("query"), "doc_id")
        found = one if found is None else found.unionByName(one)
    return found


def postings_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against its pages: some were empty when it was made, others were emptied since."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    blank = lambda k: d.withColumn("text", F.when(F.col("doc_id") % 10 == k, "").otherwise(F.col("text")))
    return search.index_drift(blank(7), search.postings(blank(3), key="doc_id"), key="doc_id")


def trigram_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a query, each with 16 trigrams around its first occurrence."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.trigram_search(d, "The And", key="doc_id", limit=None, snippets=True).select("doc_id", "snippet")


SNIPPET_SQL = """
WITH d AS (SELECT doc_id, text, strpos(lower(text), 'the and') - 1 AS a, length(text) - 18 AS last FROM documents WHERE contains(lower(text), 'the and')),
s AS (SELECT *, greatest(0, least(a - 5, last)) AS b FROM d)
SELECT doc_id, CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, b + 1, 18), '(?i)(the and)', '【\\1】', 'g') || CASE WHEN b < last THEN '…' ELSE '' END AS snippet FROM s
"""


#: Lines of a made-up report; which one stands where follows from the given orders.
LINES = (
    "（一）2025年度经营计划", "3、2024年经营计划", "4、可能面对的风险", "2025年经营计划", "公司实现营业总收入1,181.42亿元。", "计划主营业务收入327亿元，同比下降。", "计划营业成本2,420亿元。",
    "全年需求旺盛，订单饱满。", "工序成本下降，降本增效明显。", "品种钢比例提升，高端产品占比提高。", "回款改善，两金压降。", "满负荷生产，稳产高产。", "项目达产，产能利用率提升。",
    "预计需求向好。", "市场压力大，需求旺盛难以持续。", "原材料结构升级。", "现金流改善，成本上升。", "",
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = F.element_at(F.array(*map(F.lit, LINES)), (F.col("o_orderkey") * 7 % len(LINES) + 1).cast("int"))
    return o.select((F.col("o_custkey") % 20).cast("string").alias("project_id"), F.col("o_orderkey").alias("n"), line.alias("text"), (F.col("o_custkey") % 5).cast("int").alias("page_no"), F.year("o_orderdate").cast("string").alias("period"), (F.col("o_orderkey") % 3 == 0).alias("forward"))


_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
LINES_SQL = f"""u AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS project_id, o_orderkey AS n, {_list(LINES)}[o_orderkey * 7 % {len(LINES)} + 1] AS text, CAST(o_custkey % 5 AS INT) AS page_no,
            CAST(year(o_orderdate) AS VARCHAR) AS period, o_orderkey % 3 = 0 AS forward FROM orders)"""


def narrative_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of management in made-up reports."""
    return narrative.find_claims(_lines(spark, sf_dir)).select("project_id", "theme_key", "metric", "matched", "page_no", "period", "verify_period", "n")


_TOPICS = " UNION ALL ".join(f"SELECT {i} AS i, '{t.key}' AS theme_key, '{t.metric}' AS metric, {_list(t.keywords)} AS words, {_list(t.exclude)} AS never" for i, t in enumerate(narrative.TOPICS))
NARRATIVE_SQL = f"""
WITH {LINES_SQL}, t AS ({_TOPICS}),
h AS (SELECT u.*, theme_key, metric, list_filter(words, lambda w: contains(text, w))[1] AS matched, row_number() OVER (PARTITION BY project_id, theme_key, period, page_no ORDER BY n) AS k FROM u CROSS JOIN t
      WHERE text <> '' AND len(list_filter({_list(narrative.DENIAL)}, lambda w: contains(text, w))) = 0 AND len(list_filter(never, lambda w: contains(text, w))) = 0 AND len(list_filter(words, lambda w: contains(text, w))) > 0)
SELECT project_id, theme_key, metric, matched, page_no, period, CASE WHEN forward THEN CAST(CAST(period AS INT) + 1 AS VARCHAR) ELSE period END AS verify_period, n FROM h WHERE k = 1
"""


def plan_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of made-up reports that are budgets, with the year of the plan that they stand under."""
    lines = _lines(spark, sf_dir).select(F.concat_ws("-", "project_id", "period").alias("file_id"), "page_no", F.col("n").alias("line_no"), F.col("text").alias("line"))
    return extraction.plan_years(lines).where(extraction.is_budget(F.col("line"), F.col("plan_year"))).select("file_id", "line_no", "plan_year", "line")


BUDGET_SQL = f"""
WITH {LINES_SQL}, m AS (SELECT project_id || '-' || period AS file_id, page_no, n AS line_no, text AS line,
     CASE WHEN regexp_matches(text, '^\\s*([0-9]+[、.]|[（(]?[一二三四五六七八九十]+[）)、.])\\s*20[0-9]{{2}}\\s*年[^。！？；，：]{{0,8}}经营计划') THEN regexp_extract(text, '(20[0-9]{{2}})\\s*年', 1)
          WHEN regexp_matches(text, '^\\s*([一二三四五六七八九十]+[、.]|[0-9]+[、.])[^。！？；，：]{{0,40}}$') THEN '' END AS mark FROM u),
p AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING) AS plan_year FROM m)
SELECT file_id, line_no, plan_year, line FROM p WHERE plan_year <> '' AND (contains(line, '营业收入') OR contains(line, '营业总收入') OR contains(line, '主营业务收入'))
"""


def content_hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    props = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return d.select("doc_id", store.content_id("f-", F.col("source"), F.col("text")).alias("file_id"), F.sha1("text").alias("text_sha1"), store.canonical_hash(props).alias("props"))


def basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", store.basename(F.concat(F.col("url"), F.lit("\\"), F.col("page_id").cast("string"))).alias("name"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(text.squeeze(F.col("text")), 1, 160).alias("preview"))


def _task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), "ts", "event_id", "event_type")
    return ev.sequenced(e, "task_id", ["ts", "event_id"])


def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers at different places get, where a task holds its last forty events."""
    e = _task_events(spark, sf_dir)
    positions = e.select("task_id").distinct().select("task_id", (F.col("task_id") % 90).cast("int").alias("after"))
    return ev.replay(e, positions, "task_id", 40)


REPLAY_SQL = """
WITH e AS (SELECT user_id AS task_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM events),
l AS (SELECT task_id, max(seq) AS last, CAST(task_id % 90 AS INT) AS after FROM e GROUP BY 1)
SELECT e.task_id, seq, 'event' AS kind FROM e JOIN l ON l.task_id = e.task_id WHERE seq > last - 40 AND seq > after
UNION ALL SELECT task_id, CAST(last - 40 AS INT), 'truncated' FROM l WHERE after < last - 40
"""


def until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _task_events(spark, sf_dir)
    return ev.until_terminal(e, "task_id", "event_type", ("refund", "error")).select("task_id", "seq")


LEGAL = (("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "refund"), ("signup", "view"))


def transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = ev.transitions(e, "user_id", ["ts", "event_id"], "event_type", LEGAL)
    return out.select("event_id", "previous", "legal")


_PAIRS = ", ".join(f"'{a}>{b}'" for a, b in LEGAL)


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on the given tables: unique lines, customers of orders, enumerations and a bound."""
    t = lambda n: table(spark, sf_dir, n)
    out = constraints.unique(t("lineitem"), ["l_orderkey", "l_linenumber"])
    out = out.unionByName(constraints.foreign_key(t("lineitem"), "l_orderkey", t("orders").where("o_orderkey % 1000 <> 0"), "o_orderkey", "l_orderkey"))
    out = out.unionByName(constraints.allowed(t("orders"), "o_orderstatus", ["F", "O"], "o_orderkey"))
    return out.unionByName(constraints.check(t("customer"), "balance", F.col("c_acctbal") >= -900, "c_custkey"))


CONSTRAINT_SQL = """
SELECT 'unique' AS rule, l_orderkey || '|' || l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'foreign_key l_orderkey', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 <> 0)
UNION ALL SELECT 'enum o_orderstatus', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'balance', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < -900
"""


def dictionary_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a dictionary of metrics with faults of each kind."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    m = p.select(
        k.cast("string").alias("metric_key"), F.array(F.concat("p_name", F.lit("/"), F.col("p_size").cast("string")), F.concat(F.lit("a"), k.cast("string"))).alias("aliases"),
        F.array(F.concat(F.lit("a"), (k - k % 50).cast("string"))).alias("exclusion_terms"), F.when(k % 97 == 0, "odd").when(k % 89 == 0, "text").otherwise("flow").alias("value_type"),
        F.lit("currency").alias("unit_kind"), F.when(k % 3 == 0, (k + F.when(k % 6 == 0, 3).otherwise(-3)).cast("string")).alias("parent_key"))
    return constraints.dictionary_problems(m)


DICTIONARY_SQL = """
WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey AS k, [p_name || '/' || p_size, 'a' || p_partkey] AS aliases, 'a' || (p_partkey - p_partkey % 50) AS ex,
                  CASE WHEN p_partkey % 97 = 0 THEN 'odd' WHEN p_partkey % 89 = 0 THEN 'text' ELSE 'flow' END AS vt, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey + CASE WHEN p_partkey % 6 = 0 THEN 3 ELSE -3 END AS VARCHAR) END AS parent FROM part)
SELECT 'enum value_type' AS rule, key FROM m WHERE vt = 'odd' UNION ALL SELECT 'alias is excluded', key FROM m WHERE list_contains(aliases, ex) UNION ALL SELECT 'text has no unit', key FROM m WHERE vt = 'text'
UNION ALL SELECT 'foreign_key parent_key', key FROM m WHERE parent IS NOT NULL AND parent NOT IN (SELECT key FROM m)
UNION ALL SELECT 'unique', a FROM (SELECT unnest(aliases) AS a FROM m) GROUP BY a HAVING count(*) > 1
UNION ALL SELECT 'parent loop', m.key FROM m JOIN m p ON m.parent = p.key WHERE p.parent = m.key
"""


def unit_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy factors snapped to exact ones, and values brought to millions where the unit is known."""
    p = table(spark, sf_dir, "part")
    noisy = F.element_at(F.array(*[F.lit(float(f)) for f in ("0.000001", "0.001", "0.01", "1", "100")]), (F.col("p_partkey") % 5 + 1).cast("int")) * (1 + (F.col("p_size") - 25) / 999)
    unit = F.element_at(F.array(*map(F.lit, ("元", "万元", "亿元", "吨"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", numeric.snapped_factor(noisy).cast("double").alias("factor"), numeric.to_millions(F.col("p_size").cast("decimal(20,6)"), unit).cast("double").alias("millions"))


UNIT_SQL = """
SELECT p_partkey, CASE WHEN abs(p_size - 25) < 20 THEN [0.000001, 0.001, 0.01, 1.0, 100.0][p_partkey % 5 + 1]::DOUBLE END AS factor,
       (CASE p_partkey % 4 WHEN 0 THEN p_size * 0.000001 WHEN 1 THEN p_size * 0.01 WHEN 2 THEN p_size * 100 END)::DOUBLE AS millions FROM part
"""


def carried_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents under the last heading (a short line) before them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.char_length("line") < 12, F.col("n")), ignorenulls=True).over(w)
    return lines.select("doc_id", "n", heading.alias("heading"))


QUERIES = {
    "sentence_split": (sentence_split, f"WITH {SENTENCES_CTE} SELECT doc_id, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars, min(sha1(sentence)) AS digest FROM k GROUP BY 1"),
    "table_row_filter": (table_row_filter, f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER ({_ROW}) AS rows FROM l GROUP BY 1"),
    "theme_claims": (theme_claims, THEME_SQL),
    "theme_first": (theme_first, THEME_FIRST_SQL),
    "sentence_direction": (sentence_direction, DIRECTION_SQL),
    "number_extract": (number_extract, NUMBER_SQL),
    "number_guard": (number_guard, GUARD_SQL),
    "figure_parse": (figure_parse, FIGURE_SQL),
    "label_normalize": (label_normalize, "SELECT p_partkey, replace(p_name, ' ', '') AS label FROM part"),
    "trigram_search": (trigram_search, TRIGRAM_SQL),
    "short_query_search": (short_query_search, "SELECT doc_id, substr(text, greatest(strpos(lower(text), '%') - 30, 1), 120) AS excerpt FROM documents WHERE contains(text, '%')"),
    "search_dispatch": (search_dispatch, "SELECT q AS query, doc_id FROM documents CROSS JOIN (SELECT unnest(['zz', 'the and', '_|', ' eau ']) AS q) WHERE contains(lower(text), trim(q)) AND source IN ('src1', 'src2', 'src3')"),
    "trigram_snippets": (trigram_snippets, SNIPPET_SQL),
    "narrative_claims": (narrative_claims, NARRATIVE_SQL),
    "plan_budgets": (plan_budgets, BUDGET_SQL),
    "postings_consistency": (postings_consistency, "SELECT doc_id, 'not_indexed' AS side FROM documents WHERE length(text) >= 3 AND doc_id % 10 = 3 UNION ALL SELECT doc_id, 'no_page' FROM documents WHERE length(text) >= 3 AND doc_id % 10 = 7"),
    "content_hash_ids": (content_hash_ids, """SELECT doc_id, 'f-' || substr(sha256(source || chr(0) || text), 1, 12) AS file_id, sha1(text) AS text_sha1, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS props FROM documents"""),
    "basenames": (basenames, "SELECT page_id, CAST(page_id AS VARCHAR) AS name FROM pages"),
    "previews": (previews, r"SELECT conv_id, turn, substr(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')), 1, 160) AS preview FROM conversations"),
    "event_replay": (event_replay, REPLAY_SQL),
    "until_terminal": (until_terminal, """WITH e AS (SELECT user_id AS task_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM events),
        t AS (SELECT task_id, min(seq) AS last FROM e WHERE event_type IN ('refund', 'error') GROUP BY 1) SELECT e.task_id, seq FROM e LEFT JOIN t ON t.task_id = e.task_id WHERE last IS NULL OR seq <= last"""),
    "transition_check": (transition_check, f"SELECT event_id, lag(event_type) OVER w AS previous, lag(event_type) OVER w IS NULL OR lag(event_type) OVER w || '>' || event_type IN ({_PAIRS}) AS legal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "constraint_violations": (constraint_violations, CONSTRAINT_SQL),
    "dictionary_problems": (dictionary_problems, DICTIONARY_SQL),
    "unit_factors": (unit_factors, UNIT_SQL),
    "carried_heading": (carried_heading, "WITH l AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) SELECT doc_id, n, last_value(CASE WHEN length(line) < 12 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS heading FROM l"),
}
