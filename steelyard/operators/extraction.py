"""Claims and tables out of report text: sections, carried plan years, claims, signs, aging blocks, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steelyard.functions import text
from steelyard.functions.numeric import parse_figure

# Headings and phrases.
SECTION = r"^第([一二三四五六七八九十]+)[节章](.{1,30})$"
MDNA = "管理层讨论与分析|董事会报告|经营情况讨论与分析"
SUBSECTION = r"^([一二三四五六七八九十]+)、.{1,38}$"
OUTLOOK = "未来发展|经营计划|展望"
PLAN_HEADING = r"^\s*(?:\d+[、.]|[（(]?[一二三四五六七八九十]+[）)、.])\s*(20\d{2})\s*年[^。！？；，：]{0,8}经营计划"
BUDGET = ("营业收入", "营业总收入", "主营业务收入")
TOP_HEADING = r"^\s*(?:[一二三四五六七八九十]+[、.]|[0-9]+[、.])[^。！？；，：]{0,40}$"
LOSS_NEGATIVE, LOSS_POSITIVE, BALANCE = "损失以[“\"'「]?[-－—][”\"'」]?号填列|损失以负号填列", "损失以正数列示|减[:：].{0,10}减值损失", "减值准备|坏账准备余额"
AGING_TOTAL, AGING_WITHIN, AGING_OVER = "^合计|^小计", "^1年以内|^一年以内", "^[1-5一二三四五]至[1-5一二三四五]年|^[1-5一二三四五]年以上"


def sections(lines: DataFrame) -> DataFrame:
    """``file_id, page_no, line_no, line`` to the lines of each file's discussion: from its heading to the
    next one. A page with two headings or more is a table of contents and has none."""
    bare = F.regexp_replace("line", r"\s+", "")
    x = lines.withColumn("_h", F.when(bare.rlike(SECTION), F.regexp_extract(bare, SECTION, 2)))
    x = x.withColumn("_n", F.count("_h").over(Window.partitionBy("file_id", "page_no"))).withColumn("_h", F.when(F.col("_n") == 1, F.col("_h")))
    w = Window.partitionBy("file_id").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("heading", F.last("_h", ignorenulls=True).over(w))
    return x.where(F.col("heading").rlike(MDNA) & F.col("_h").isNull()).drop("_h", "_n")


def subsections(lines: DataFrame) -> DataFrame:
    """Add ``title, kind`` by the last numbered heading from the first on that is number one; what stands
    before it belongs to the section above and goes."""
    bare = F.regexp_replace("line", r"\s+", "")
    w = Window.partitionBy("file_id").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("_t", F.when(bare.rlike(SUBSECTION), bare))
    x = x.withColumn("_one", F.max(F.col("_t").startswith("一、").cast("int")).over(w)).withColumn("_any", F.max(F.col("_t").startswith("一、").cast("int")).over(Window.partitionBy("file_id")))
    x = x.where((F.col("_one") == 1) | F.col("_any").isNull() | (F.col("_any") == 0)).withColumn("title", F.last("_t", ignorenulls=True).over(w))
    return x.withColumn("kind", F.when(F.col("title").rlike(OUTLOOK), "outlook").otherwise("business_review")).drop("_t", "_one", "_any")


def plan_years(lines: DataFrame) -> DataFrame:
    """Add ``plan_year``: a heading of a plan sets it, another top heading clears it, and it carries over
    lines, pages and sections of one file."""
    w = Window.partitionBy("file_id").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(PLAN_HEADING), F.regexp_extract("line", PLAN_HEADING, 1)).when(F.col("line").rlike(TOP_HEADING), "")
    return lines.withColumn("plan_year", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))


def is_budget(sentence: Column, plan_year: Column) -> Column:
    """Whether a sentence is a budget: it names revenue and stands under a plan's heading, never without one."""
    return F.coalesce(plan_year.isNotNull() & text.any_of(sentence, BUDGET), F.lit(False))


def claims(sentences: DataFrame, aliases: dict[str, list[str]] | None = None, extractor: str = "rule-v1") -> DataFrame:
    """Sentences ``project_id, section_id, n, sentence, paragraph, report_period, plan_year`` to claims.

    A budget is a sentence under a plan's heading that names the company's revenue; other sentences are claims
    of their theme. Then
    direction, magnitude and period; text about the industry isn't about the company. The id is a hash of
    place and text, so a rerun makes the same claims. Confidence is .8 with a magnitude, .7 with a
    direction, else .5, and .2 less for intentions.
    """
    aliases = aliases or {}
    s = F.col("sentence")
    theme = text.match_theme(s)
    triggers = F.create_map(*[x for t in text.THEMES for x in (F.lit(t.name), F.array(*map(F.lit, t.triggers)))])
    budget = is_budget(s, F.col("plan_year"))
    x = sentences.withColumn("_m", theme).where(budget | F.col("_m").isNotNull()).where(~text.industry_scope(F.coalesce("paragraph", "sentence")))
    x = x.withColumns({"claim_type": F.when(budget, "management_budget").otherwise(F.col("_m.theme")), "primary_metric": F.when(budget, "revenue").otherwise(F.when(F.col("_m.usable"), F.col("_m.metric")))})
    names = F.create_map(*[y for k, v in (aliases or {"": [""]}).items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    x = x.withColumns({"_d": text.direction(s, F.try_element_at(triggers, F.col("claim_type"))), "_g": text.magnitude(s, F.try_element_at(names, F.col("primary_metric")))})
    period = F.when(budget, F.col("plan_year")).otherwise(text.claim_period(s, F.col("report_period")))
    base = F.when(F.col("_g").isNotNull(), 0.8).when(F.col("_d.direction") != "unknown", 0.7).otherwise(0.5)
    bare = text.squeeze(s)
    key = F.concat(F.lit("cl-"), F.substring(F.sha1(F.concat_ws("\x00", "project_id", "section_id", F.col("n").cast("string"), bare)), 1, 12))
    return x.select(
        key.alias("claim_id"), "project_id", "section_id", s.alias("claim_text"), "claim_type", "primary_metric", F.col("_d.direction").alias("direction"), period.alias("period_norm"),
        F.col("_g.value").alias("magnitude_value"), F.col("_g.unit").alias("magnitude_unit"), F.col("_g.bound").alias("bound"), F.coalesce("_g.is_plan", F.lit(False)).alias("is_plan"), F.col("_g.aligned").alias("target_metric_aligned"),
        F.round(base - F.when(F.col("_d.intended"), 0.2).otherwise(0.0), 2).alias("confidence"), F.lit(extractor).alias("extractor"), "report_period",
    )


def sign_basis(row: Column, header: Column) -> Column:
    """How an impairment is printed, by what its row and heading say; the year never decides."""
    t = F.concat_ws(" ", row, header)
    return F.when(F.trim(t) == "", "undetermined").when(t.rlike(BALANCE), "not_applicable").when(t.rlike(LOSS_NEGATIVE), "loss_negative").when(t.rlike(LOSS_POSITIVE), "loss_positive").otherwise("undetermined")


def normalize_impairment(value: Column, basis: Column) -> Column:
    """Losses positive: the sign is turned, never dropped, so a reversal stays a gain."""
    return F.when(basis == "loss_negative", -value).otherwise(value)


def aging(rows: DataFrame) -> DataFrame:
    """Receivables by age from ``block_id, line_no, label, figure`` (text): the block ends at its first total.
    Gross has to equal the part within a year plus the parts over it, and a file has to have one such
    block, else it is refused."""
    w = Window.partitionBy("file_id", "block_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("_done", F.coalesce(F.max(F.col("label").rlike(AGING_TOTAL).cast("int")).over(w), F.lit(0))).where("_done = 0").withColumn("_v", parse_figure(F.col("figure"))["value"])
    part = lambda p: F.sum(F.when(F.col("label").rlike(p), F.col("_v"))).cast("decimal(20,6)")
    g = x.groupBy("file_id", "block_id").agg(part(AGING_TOTAL).alias("gross"), part(AGING_WITHIN).alias("within"), part(AGING_OVER).alias("over_one_year"))
    fits = F.coalesce(F.col("gross") == F.col("within") + F.col("over_one_year"), F.lit(False))
    f = g.groupBy("file_id").agg(F.count_if(fits).alias("_n"), F.first(F.when(fits, F.struct("block_id", "gross", "over_one_year")), ignorenulls=True).alias("_b"))
    return f.select("file_id", F.when(F.col("_n") == 1, F.col("_b")).alias("block"), F.when(F.col("_n") == 0, "no_block").when(F.col("_n") > 1, "ambiguous").alias("refused")).select("file_id", "block.*", "refused")


# Headings that a table of ages begins at, and how its rows begin.
AGING_HEADINGS = ("按账龄分析法计提坏账准备的应收账款", "按账龄披露", "按账龄列示")
AGING_ROWS = (
    ("within", ("1年以内",)), ("1to2", ("1至2年", "1-2年", "1—2年")), ("2to3", ("2至3年", "2-3年", "2—3年")), ("3to4", ("3至4年", "3-4年")),
    ("4to5", ("4至5年", "4-5年")), ("over5", ("5年以上",)), ("over3", ("3年以上",)), ("total", ("合计",)),
)
AGING_FIGURE = r"(\d[\d,]*\.\d{2})"


def aging_blocks(pages: DataFrame) -> DataFrame:
    """``file_id, page_no, block, total, within, over_one_year``: what the pages' tables of ages say, cut at their
    totals. Reading begins at the last of the narrow headings of a page, if it has one; a row's first figure counts,
    and of a block's rows with one meaning the first."""
    heading = "|".join(AGING_HEADINGS)
    text = F.coalesce(F.nullif(F.regexp_extract("text", f"(?s)^.*((?:{heading}).*)$", 1), F.lit("")), F.col("text"))
    x = pages.select("file_id", "page_no", F.posexplode(F.split(text, "\n")).alias("n", "_l")).withColumn("_l", F.trim("_l"))
    row = F.coalesce(*[F.when(F.col("_l").rlike("^(?:" + "|".join(starts) + ")"), name) for name, starts in AGING_ROWS])
    x = x.withColumns({"row": row, "v": parse_figure(F.regexp_extract("_l", AGING_FIGURE, 1))["value"]}).where("row IS NOT NULL AND v IS NOT NULL")
    before = Window.partitionBy("file_id", "page_no").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("block", F.coalesce(F.sum((F.col("row") == "total").cast("int")).over(before), F.lit(0)))
    g = x.groupBy("file_id", "page_no", "block").agg(*[F.min(F.when(F.col("row") == name, F.struct("n", "v")))["v"].alias(name) for name, _ in AGING_ROWS], F.count("*").alias("_rows"))
    some = lambda *names: F.when(F.coalesce(*names).isNotNull(), sum((F.coalesce(F.col(c), F.lit(0)) for c in names), F.lit(0).cast("decimal(20,6)")))
    late = F.when(F.col("over3").isNotNull(), some("1to2", "2to3", "over3")).otherwise(some("1to2", "2to3", "3to4", "4to5", "over5"))
    return g.where("total IS NOT NULL AND _rows > 1").select("file_id", "page_no", "block", "total", "within", late.cast("decimal(20,6)").alias("over_one_year"))


def aging_of_pages(pages: DataFrame, scope: str = "consolidated") -> DataFrame:
    """``file_id, page_no, gross, over_one_year, refused`` of each file with a table of ages in that scope: the first
    of its pages on which all blocks whose total is the part within a year plus the parts over it say the same.
    Pages are never put together. Without such a page it is ``ambiguous`` where blocks differ, else ``no_block``."""
    own = aging_pages(pages).where(F.col("scope") == scope).select("file_id", "page_no")
    fits = aging_blocks(pages.join(own, ["file_id", "page_no"], "left_semi")).where(F.col("total") == F.col("within") + F.col("over_one_year"))
    by_page = fits.groupBy("file_id", "page_no").agg(F.count_distinct("total", "over_one_year").alias("_n"), F.min(F.struct("block", "total", "over_one_year")).alias("_b"))
    found = by_page.groupBy("file_id").agg(F.min(F.when(F.col("_n") == 1, F.struct("page_no", F.col("_b.total").alias("gross"), "_b.over_one_year"))).alias("_f"), F.lit(True).alias("_any"))
    out = own.select("file_id").distinct().join(found, "file_id", "left")
    return out.select("file_id", "_f.page_no", "_f.gross", "_f.over_one_year", F.when(F.col("_f").isNull(), F.when(F.col("_any"), "ambiguous").otherwise("no_block")).alias("refused"))


def aging_pages(pages: DataFrame) -> DataFrame:
    """Pages ``file_id, page_no, text`` with an aging table, and the scope that the nearest page before (or
    the page) names."""
    w = Window.partitionBy("file_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    scope = F.when(F.col("text").contains("母公司财务报表"), "parent").when(F.col("text").contains("合并财务报表"), "consolidated")
    x = pages.withColumn("scope", F.last(scope, ignorenulls=True).over(w))
    return x.where(F.col("text").contains("应收账款") & F.col("text").rlike("账龄") & F.col("text").rlike("1年以内|一年以内")).select("file_id", "page_no", "scope")


def risk_candidates(sentences: DataFrame, items: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], most: int = 2) -> DataFrame:
    """Sentences ``file_id, n, sentence`` that hit both word sets of an item and aren't figures: the first
    ``most`` of each item, which is what a reviewer is shown."""
    s = F.col("sentence")
    hits = F.array(*[F.when(text.any_of(s, a) & text.any_of(s, b), F.lit(k)) for k, (a, b) in items.items()])
    x = sentences.where(text.digit_ratio(s) <= 0.3).withColumn("item", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    w = Window.partitionBy("file_id", "item").orderBy("n")
    return x.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def self_check(counts: dict[str, DataFrame], least: dict[str, int]) -> dict[str, tuple[int, bool]]:
    """Rows of each table and whether there are as many as there have to be; -1 for a table that is absent."""
    return {name: (n := counts[name].count() if name in counts else -1, n >= need) for name, need in least.items()}


def config_difference(used: DataFrame, declared: DataFrame) -> DataFrame:
    """Parameters ``key, value`` that the engine uses otherwise than declared, or that one side lacks."""
    out = used.withColumnRenamed("value", "used").join(declared.withColumnRenamed("value", "declared"), "key", "full_outer")
    return out.where(~F.col("used").eqNullSafe(F.col("declared")))


def rule_value(rules: DataFrame, key: str, industry: str) -> DataFrame:
    """The industry's own row of a rule, else the global one: ``key, industry, value``."""
    own = rules.where((F.col("key") == key) & F.col("industry").isin("", industry))
    return own.groupBy("key").agg(F.max_by(F.struct("industry", "value"), F.length("industry")).alias("_r")).select("key", "_r.*")


def rule_boolean(value: Column) -> Column:
    """Rules are text, and '0' is false."""
    return F.lower(F.trim(value)).isin("1", "true", "yes")
