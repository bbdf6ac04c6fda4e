"""A registry of named table functions with checked arguments, and a keyword router."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.operators import constraints, extraction, grid, narrative, ratios
from steelyard.sources import schema


@dataclass(frozen=True)
class Tool:
    name: str
    version: str
    run: Callable[..., DataFrame]
    keywords: tuple[str, ...] = ()
    deterministic: bool = True
    parameters: dict[str, bool] = field(default_factory=dict)

    def describe(self) -> dict:
        return {"name": self.name, "version": self.version, "deterministic": self.deterministic, "required": [k for k, r in self.parameters.items() if r], "optional": [k for k, r in self.parameters.items() if not r]}


class Registry:
    """Tools by name. A name is taken once; calls with missing or unknown arguments are refused."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def tool(self, name: str, version: str = "1", *, keywords: tuple[str, ...] = (), deterministic: bool = True):
        def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self._tools:
                raise ValueError(f"{name} is registered already")
            parameters = {k: p.default is inspect.Parameter.empty for k, p in inspect.signature(run).parameters.items()}
            self._tools[name] = Tool(name, version, run, keywords, deterministic, parameters)
            return run

        return add

    def call(self, name: str, **arguments) -> DataFrame:
        if name not in self._tools:
            raise KeyError(name)
        t = self._tools[name]
        missing = sorted(k for k, required in t.parameters.items() if required and k not in arguments)
        unknown = sorted(arguments.keys() - t.parameters.keys())
        if missing or unknown:
            raise TypeError(f"{name}: missing {missing}, unknown {unknown}")
        return t.run(**arguments)

    def route(self, question: str) -> str | None:
        """The first tool in order of name that a keyword of the question calls."""
        return next((n for n in sorted(self._tools) if any(k in question for k in self._tools[n].keywords)), None)

    def describe(self) -> list[dict]:
        return [self._tools[n].describe() for n in sorted(self._tools)]


#: The tools of the engine.
TOOLS = Registry()


def _own(df: DataFrame, project_id: str | None) -> DataFrame:
    return df if project_id is None else df.where(F.col("project_id") == project_id)


def _series(facts: DataFrame, project_id: str | None) -> DataFrame:
    """Verified figures for whole years."""
    whole = grid.verified(facts)
    return _own(whole.where("period_kind = 'current'") if "period_kind" in facts.columns else whole, project_id)


@TOOLS.tool("facts.coverage", keywords=("覆盖", "缺口", "coverage"))
def coverage(facts: DataFrame, project_id: str | None = None) -> DataFrame:
    """Per project its verified years in order, and how many metrics and facts there are."""
    years = _series(facts, project_id).groupBy("project_id").agg(F.array_sort(F.collect_set("period")).alias("years"))
    counts = _own(grid.verified(facts), project_id).groupBy("project_id").agg(F.count_distinct("metric_key").alias("metrics"), F.count("*").alias("facts"))
    return counts.join(years, "project_id", "left").select("project_id", F.coalesce("years", F.array().cast("array<string>")).alias("years"), "metrics", "facts")


@TOOLS.tool("facts.series", keywords=("序列", "同比", "series"))
def series(facts: DataFrame, metric_key: str, project_id: str | None = None) -> DataFrame:
    """A metric year by year with its growth, or why that is refused."""
    own = _series(facts, project_id).where(F.col("metric_key") == metric_key).select("project_id", "metric_key", "period", "value")
    return ratios.series_yoy(own, ["project_id", "metric_key"])


@TOOLS.tool("facts.margin", keywords=("毛利率", "margin"))
def margin(facts: DataFrame, project_id: str | None = None) -> DataFrame:
    """The gross margin year by year: from the disclosed gross profit, else from revenue less cost."""
    parts = ["revenue", "operating_cost", "gross_profit"]
    wide = _series(facts, project_id).groupBy("project_id", "period").pivot("metric_key", parts).agg(F.first("value"))
    return ratios.margin_series(wide.where("revenue IS NOT NULL"), ["project_id", "period"])


@TOOLS.tool("narrative.claims", keywords=("主张", "表述", "claims"))
def narrative_claims(utterances: DataFrame, project_id: str | None = None) -> DataFrame:
    """The claims in what management says."""
    return narrative.find_claims(_own(utterances, project_id))


@TOOLS.tool("narrative.consistency", keywords=("一致", "冲突", "consistency"))
def narrative_consistency(utterances: DataFrame, facts: DataFrame, project_id: str | None = None, theme_key: str | None = None, forward_next_year: bool = True) -> DataFrame:
    """Each claim against the figures of its year and the one before; the gross margin is computed."""
    own = _series(facts, project_id)
    rates = margin(facts, project_id).where("margin.value IS NOT NULL").select("project_id", F.lit("gross_margin").alias("metric"), "period", F.col("margin.value").cast("decimal(38,6)").alias("value"))
    figures = own.select("project_id", F.col("metric_key").alias("metric"), "period", F.col("value").cast("decimal(38,6)").alias("value"))
    claims = narrative.find_claims(_own(utterances, project_id), forward_next_year=forward_next_year)
    return narrative.consistency(claims if theme_key is None else claims.where(F.col("theme_key") == theme_key), figures.unionByName(rates))


@TOOLS.tool("system.db_stats", keywords=("统计", "表", "stats"))
def db_stats(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table has."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in sorted(tables.items())]
    out = spark.createDataFrame([], "name string, rows long")
    for one in counts:
        out = out.unionByName(one)
    return out


@TOOLS.tool("system.dictionary_check", keywords=("字典", "dictionary"))
def dictionary_check(metrics: DataFrame) -> DataFrame:
    """What is wrong with the dictionary; no rows if it is sound."""
    return constraints.dictionary_problems(metrics)


@TOOLS.tool("system.rule_config_check", keywords=("参数", "rules"))
def rule_config_check(rules: DataFrame) -> DataFrame:
    """Declared parameters that the engine uses otherwise, or that one side lacks."""
    return extraction.config_difference(schema.engine_parameters(rules.sparkSession), rules.where("industry = ''").select("key", "value"))
