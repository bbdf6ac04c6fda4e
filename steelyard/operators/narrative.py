"""Claims of management that figures can support: themes found in utterances, held against the series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steelyard.functions.text import any_of
from steelyard.operators.verdicts import narrative_judge


@dataclass(frozen=True)
class Topic:
    """A theme with the words that call it, those that rule it out, and the metric that has to rise."""

    key: str
    metric: str
    keywords: tuple[str, ...]
    exclude: tuple[str, ...]
    expect: str = "up"


# Words of denial and risk, and the topics in order.
DENIAL = ("没有", "难以", "无法", "不足", "尚未", "未能", "未见", "未明显", "压力", "承压", "挑战", "风险", "疲软", "低迷", "下滑", "恶化")
TOPICS = (
    Topic("demand", "revenue", ("需求旺盛", "需求向好", "产销两旺", "满产满销", "供不应求", "订单饱满"), ("预计", "有望")),
    Topic("capacity", "revenue", ("满负荷生产", "达产", "产能利用率提升", "制造效率提升", "稳产高产"), ("工程", "项目", "在建", "预计", "计划")),
    Topic("cost", "gross_margin", ("降本增效", "成本削减", "成本下降", "工序成本", "降本潜力"), ("压力", "挤压", "上升")),
    Topic("mix", "gross_margin", ("产品结构优化", "优化产品结构", "结构升级", "品种钢", "高端产品"), ("工程", "项目", "资金主要", "募集", "投资", "原材料", "基地", "改造", "大修", "在建")),
    Topic("cash", "cfo", ("两金压降", "回款改善", "现金流改善", "应收账款周转", "现款现货"), ("预计", "计划")),
)


def find_claims(utterances: DataFrame, topics: tuple[Topic, ...] = TOPICS, *, forward_next_year: bool = True) -> DataFrame:
    """``project_id, theme_key, metric, expect, text, matched, page_no, period, verify_period, forward, n`` from
    ``project_id, n, text, page_no, period, forward``.

    Sentences with a word of denial or risk make no claim, nor do those with a word that rules a topic out.
    A topic counts once for each report and page, by its first sentence in order of ``n``: a company that
    says a thing twice doesn't claim more. What speaks of the future is verified by the next year, unless
    told otherwise, or by the report's own period where that is no year.
    """
    text = F.trim("text")
    said = lambda t: F.get(F.filter(F.array(*map(F.lit, t.keywords)), lambda k: F.contains(text, k)), 0)
    hits = F.array(*[F.when(~any_of(text, t.exclude), F.struct(F.lit(t.key).alias("theme_key"), F.lit(t.metric).alias("metric"), F.lit(t.expect).alias("expect"), said(t).alias("matched"))) for t in topics])
    found = utterances.where((text != "") & ~any_of(text, DENIAL)).withColumn("_t", F.explode(F.filter(hits, lambda h: h["matched"].isNotNull())))
    first = found.groupBy("project_id", F.col("_t.theme_key").alias("theme_key"), "period", "page_no").agg(F.min_by(F.struct("_t.metric", "_t.expect", text.alias("text"), "_t.matched", "forward", "n"), "n").alias("_f"))
    out = first.select("project_id", "theme_key", "period", "page_no", "_f.*")
    later = F.coalesce((F.col("period").try_cast("int") + 1).cast("string"), "period")
    return out.withColumn("verify_period", F.when(F.coalesce("forward", F.lit(False)) & F.lit(forward_next_year), later).otherwise(F.col("period")))


def consistency(claims: DataFrame, series: DataFrame) -> DataFrame:
    """The claims of :func:`find_claims` with ``current_value, base_value, change, verdict`` against ``series``:
    ``project_id, metric, period, value``, by :func:`steelyard.operators.verdicts.narrative_judge`."""
    now = series.select("project_id", "metric", F.col("period").alias("verify_period"), F.col("value").alias("current_value"))
    before = series.select("project_id", "metric", (F.col("period").try_cast("int") + 1).cast("string").alias("verify_period"), F.col("value").alias("base_value"))
    both = claims.join(now, ["project_id", "metric", "verify_period"], "left").join(before, ["project_id", "metric", "verify_period"], "left")
    return narrative_judge(both.withColumn("direction", F.col("expect")))
