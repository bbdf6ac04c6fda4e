"""Operators on fixtures of annual reports, against the rules of the domain."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from steelyard.functions import numeric, text
from steelyard.operators import checks, constraints, derived, grid, index, quality, quantiles, ratios, relational, search, verdicts
from steelyard.plans.tools import Registry
from steelyard.sources import store
from steelyard.streaming import events

D = Decimal


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


@pytest.mark.parametrize(
    ("prev", "curr", "pp", "cp", "value", "refused"),
    [("100", "112.345", "2023", "2024", "0.1234", None), (None, "1", "2023", "2024", None, "missing"), ("1", "2", "2022", "2024", None, "gap"), ("1", "2", "2023H1", "2024", None, "period_unparsable"),
     ("0", "2", "2023", "2024", None, "zero_base"), ("-100", "50", "2023", "2024", None, "negative_base"), ("100", "100.005", "2023", "2024", "0.0000", None), ("200", "200.03", "2023", "2024", "0.0002", None)],
)
def test_growth(spark, prev, curr, pp, cp, value, refused):
    money = lambda x: F.lit(x).cast("decimal(20,6)")
    r = spark.range(1).select(ratios.yoy_growth(money(prev), money(curr), F.lit(pp), F.lit(cp)).alias("r")).first().r
    assert (r.value, r.refused) == (None if value is None else D(value), refused)


def test_growth_scope_comes_before_the_gap(spark):
    m = F.lit("1").cast("decimal(20,6)")
    r = spark.range(1).select(ratios.yoy_growth(m, m, F.lit("2020"), F.lit("2024"), F.lit("a"), F.lit("b")).alias("r")).first().r
    assert r.refused == "scope_mismatch" and r.inputs["curr"] == "1.000000"


def test_gross_margin(spark):
    m = lambda x: F.lit(x).cast("decimal(20,6)")
    r = spark.range(1).select(ratios.gross_margin(m("1"), m("-5")).alias("a"), ratios.gross_margin(m("25"), m("200")).alias("b"), ratios.gross_margin(m(None), m("0")).alias("c")).first()
    assert r.a.refused == "negative_revenue" and r.b.value == D("12.5") and r.c.refused == "missing"


FACTS = "fact_id string, project_id string, metric_key string, period string, value decimal(20,6), comparable boolean, status string, restated boolean, created_at string"


def test_grid(spark):
    f = lambda i, p, v, **k: (i, "p1", "revenue", p, D(v), k.get("ok", True), "validated", k.get("restated", False), k.get("at", "1"))
    facts = spark.createDataFrame([f("a", "2020", "100"), f("b", "2021", "100.5"), f("c", "2021", "999", restated=True), f("d", "2022", "80"), f("e", "2024", "90"), f("f", "2025", "95", ok=False), f("g", "2020", "1", at="0")], FACTS)
    projects = spark.createDataFrame([("p1", ["2020", "2021", "2022", "2023", "2024", "2025"])], "project_id string, fiscal_years array<string>")
    metrics = spark.createDataFrame([("revenue",), ("cfo",)], "metric_key string")
    cells = {(r.metric_key, r.period): r for r in grid.grid_growth(grid.grid(projects, metrics, facts)).collect()}
    assert len(cells) == 12 and all(cells["cfo", p].status == "not_found" for p in ("2020", "2025"))
    assert cells["revenue", "2020"].value == 100 and cells["revenue", "2020"].change is None and cells["revenue", "2020"].change_refused is None
    assert (cells["revenue", "2021"].change, cells["revenue", "2021"].change_dir) == (D("0.0050"), "flat")
    assert cells["revenue", "2022"].change_dir == "down"
    assert cells["revenue", "2024"].change_refused == "missing" and cells["revenue", "2025"].change_refused == "incomparable"
    counts = {r.metric_key: (r.filled, r.declared) for r in grid.filled_years(grid.grid(projects, metrics, facts)).collect()}
    assert counts == {"revenue": (5, 6), "cfo": (0, 6)}


def long(spark, rows):
    return spark.createDataFrame([("p1", k, p, D(str(v))) for k, p, v in rows], "project_id string, metric_key string, period string, value decimal(20,6)")


def test_derived(spark):
    rows = [("revenue", "2023", 900), ("revenue", "2024", 1000), ("operating_cost", "2024", 700), ("net_income_parent", "2024", 50), ("equity_parent", "2023", 400), ("equity_parent", "2024", 600), ("steel_sales_volume", "2024", 2_000_000)]
    rows += [("profit_before_tax", "2024", 100), ("interest_expense", "2024", 20), ("interest_income", "2024", 5), ("net_income", "2024", 0), ("cfo", "2024", 7)]
    got = {(r.metric_key, r.period): r for r in derived.derive(long(spark, rows)).collect()}
    value = lambda k, p="2024": got[k, p].value
    assert value("gross_profit") == 300 and value("gross_margin") == 30 and value("ebit") == 115 and value("ebit_margin") == D("11.5") and value("roe") == 10
    assert value("steel_gross_profit_per_ton") == 150
    assert got["cash_conversion", "2024"].refused == "zero_denominator" and got["ebitda", "2024"].refused == "missing" and got["gross_profit", "2023"].refused == "missing"
    assert got["roe", "2023"].refused == "missing" and got["net_debt", "2024"].refused == "not_defined" and got["roic", "2024"].refused == "needs_normalized_tax"
    assert len({k for k, _ in got}) == len(derived.SPECS) == 21
    assert all((r.value is None) != (r.refused is None) for r in got.values())


def test_checks(spark):
    wide = {"total_assets": D("228652.514012"), "total_liabilities": D("104447.687866"), "total_equity": D("124204.826147"), "cash_begin": D(10), "cash_net_increase": D(5), "cash_end": D(20), "gross_profit": D(30), "revenue": D(100), "operating_cost": D(70)}
    df = spark.createDataFrame([("2024", *wide.values(), False)], "period string, " + ", ".join(f"{k} decimal(20,6)" for k in wide) + ", revenue_ok boolean")
    got = {r.rule_key: r for r in checks.run_checks(df, ["period"]).collect()}
    assert {k: r.status for k, r in got.items()} == {"balance_sheet": "passed", "cash_rollforward": "failed", "cash_components": "skipped_missing_data", "gross_profit": "skipped_incomparable"}
    assert got["cash_rollforward"].diff == -5 and got["gross_profit"].lhs is None and got["balance_sheet"].inputs[-1] == "total_equity"
    s = checks.summary(checks.run_checks(df, ["period"]), ["period"]).first()
    assert (s.total, s.evaluable, s.passed, s.failed_hard, s.skipped_missing, s.skipped_incomparable) == (4, 2, 1, 1, 1, 1)
    parts = spark.createDataFrame([("2024", D(100), D(60), D(30), D(10))], "period string, total_assets decimal(20,6), total_liabilities decimal(20,6), equity_parent decimal(20,6), minority_interest decimal(20,6)")
    assert checks.run_checks(parts, ["period"], checks.RULES[:1]).first().status == "passed"
    with pytest.raises(ValueError):
        checks.run_checks(df, ["period"], tolerance=1.5)
    bad = checks.unreadable(spark.createDataFrame([("1,0",), ("x",), (None,), ("2",)], "v string"), "v")
    assert sorted(r.v for r in bad.collect()) == ["1,0", "x"]


def cycle(spark, margins, start=2017, **more):
    return spark.createDataFrame([("c", str(start + i), D(1000), D(1000) * D(m), True) for i, m in enumerate(margins)], "project_id string, period string, revenue decimal(20,6), ebit decimal(20,6), comparable boolean")


def test_normalize(spark):
    run = lambda df: quantiles.normalize(df).first()
    base = [".08", ".12", ".06", ".03", ".15", ".10", ".04", ".07"]
    r = run(cycle(spark, base))
    assert (r.status, r.start, r.end, r.comparable_years, r.mid) == ("normalized", 2017, 2024, 8, D("0.07"))
    assert (r.p25, r.p75) == (D("0.04"), D("0.10"))
    heavy = cycle(spark, [*base[:4], ".08", *base[5:]]).withColumn("revenue", F.when(F.col("period") == "2021", 50_000).otherwise(1000).cast("decimal(20,6)")).withColumn("ebit", F.col("ebit") * F.when(F.col("period") == "2021", 50).otherwise(1)).withColumn("ebit", F.col("ebit").cast("decimal(20,6)"))
    weights = {x.period: x.weight for x in quantiles.cycle_years(heavy, 8).collect()}
    assert weights["2021"] == D("0.877193") and weights["2017"] == D("0.017544") and run(heavy).mid == D("0.08")
    assert run(cycle(spark, [".08"] * 8)).status == "incomplete_cycle" and run(cycle(spark, [".08"] * 8)).mid is None
    assert run(cycle(spark, base[:4])).status == "insufficient_data"
    some = cycle(spark, [".02", ".2", *base], 2015).withColumn("comparable", ~F.col("period").isin("2019", "2020"))
    r = run(some)
    assert (r.mode, r.status, r.comparable_years) == ("fallback_10y", "normalized", 8)
    with pytest.raises(Exception, match="annual label"):
        run(cycle(spark, base).withColumn("period", F.lit("2024H1")))


def test_quantiles(spark):
    df = spark.createDataFrame([("g", D(v), D(w)) for v, w in ((1, 1), (2, 1), (3, 2), (9, 0), (10, -4))], "g string, v decimal(10,2), w decimal(10,2)")
    r = quantiles.weighted_quantiles(df, ["g"], "v", "w", {"a": "0.25", "b": "0.5", "c": "0.51"}).first()
    assert (r.a, r.b, r.c) == (1, 2, 3)


def test_quantiles_of_many_values_with_outliers(spark):
    """Groups larger than the parts they are cut into, one with an outlier that spans nearly all of its width."""
    import numpy as np

    values = {"wide": [*range(9000), 10**9], "tied": [k // 3 for k in range(7000)], "one": [5] * 40, "few": [-3, 0, 8]}
    df = spark.createDataFrame([(g, float(v)) for g, some in values.items() for v in some], "g string, v double")
    qs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.999, "e": 1.0}
    for r in quantiles.interpolated_quantile(df, ["g"], "v", qs).collect():
        assert [round(r[n], 6) for n in qs] == [round(float(np.quantile(values[r.g], q)), 6) for q in qs.values()], r.g
    weighted = df.withColumn("w", F.lit(1).cast("decimal(10,2)"))
    for r in quantiles.weighted_quantiles(weighted, ["g"], "v", "w", {"m": "0.5", "h": "0.9"}).collect():
        some = sorted(values[r.g])
        assert (r.m, r.h) == (some[-(-len(some) // 2) - 1], some[-(-len(some) * 9 // 10) - 1]), r.g


def test_unique_prefix_across_ranges(spark):
    """One beginning that all names share, equal names and nested names, against all pairs."""
    import random

    draw = random.Random(3)
    stem = "the same beginning of all of them "
    right = [stem + "".join(draw.choice("ab") for _ in range(draw.randint(0, 9))) for _ in range(400)] + ["short", None]
    left = [n if n is None else n[: draw.randint(4, len(n))] if draw.random() < 0.7 else n for n in right] + [stem + "zz"] * 150 + [right[0]] * 150
    want = []
    for i, n in enumerate(left):
        begun = {r for r in right if n is not None and r is not None and r.startswith(n)}
        if n in begun:
            want.append((i, n, "exact"))
        elif n is None or len(n) < 24 or not begun:
            want.append((i, None, "none"))
        else:
            want.append((i, min(begun), "prefix") if len(begun) == 1 else (i, None, "ambiguous"))
    frame = lambda some, name: spark.createDataFrame(list(enumerate(some)), f"id long, {name} string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for parts in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
            got = relational.unique_prefix(frame(left, "name"), frame(right, "name"), "id", "name", 24)
            assert sorted(map(tuple, got.collect())) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    empty = frame([], "name")
    assert relational.unique_prefix(empty, frame(right, "name"), "id", "name", 24).count() == 0
    assert {r.how for r in relational.unique_prefix(frame(left, "name"), empty, "id", "name", 24).collect()} == {"none"}


CLAIM = "primary_metric string, period_norm string, direction string, magnitude_value decimal(20,6), magnitude_unit string, bound string, is_plan boolean, metric_kind string, current_value decimal(20,6), current_comparable boolean, current_period string, base_value decimal(20,6), base_comparable boolean, base_period string"


def claim(**k):
    base = {"primary_metric": "revenue", "period_norm": "2024", "direction": "up", "magnitude_value": None, "magnitude_unit": "", "bound": "exact", "is_plan": False, "metric_kind": "amount", "current_value": "105", "current_comparable": True, "current_period": "2024", "base_value": "100", "base_comparable": True, "base_period": "2023"}
    base |= k
    return tuple(D(v) if n.endswith("_value") and v is not None else v for n, v in base.items())


CASES = [
    ({}, "supported"), ({"direction": "down"}, "contradicted"), ({"current_value": "100.8"}, "neutral"), ({"current_value": "101"}, "neutral"), ({"direction": "improve", "primary_metric": "operating_cost"}, "contradicted"),
    ({"primary_metric": None}, "unverifiable"), ({"period_norm": None}, "unverifiable"), ({"current_value": None, "current_period": None, "current_comparable": None}, "unverifiable"), ({"base_comparable": False}, "incomparable"),
    ({"base_value": None, "base_period": None, "base_comparable": None}, "needs_review"), ({"base_value": "-5"}, "needs_review"), ({"direction": "unclear"}, "needs_review"),
    ({"magnitude_value": "5", "magnitude_unit": "%", "bound": "at_least", "current_value": "104"}, "contradicted"), ({"magnitude_value": "5", "magnitude_unit": "%", "bound": "at_least"}, "supported"),
    ({"magnitude_value": "5", "magnitude_unit": "%", "bound": "about"}, "needs_review"), ({"magnitude_value": "5", "magnitude_unit": "亿元", "is_plan": True}, "needs_review"), ({"magnitude_value": "5", "magnitude_unit": "亿元"}, "supported"),
    ({"magnitude_value": "5", "magnitude_unit": "个百分点", "current_value": "105.2"}, "supported"), ({"magnitude_value": "5", "magnitude_unit": "%", "direction": "down", "current_value": "95"}, "supported"),
    ({"metric_kind": "ratio", "current_value": "0.0996", "base_value": "0.1"}, "neutral"), ({"metric_kind": "ratio", "current_value": "0.106", "base_value": "0.1"}, "supported"), ({"metric_kind": "days", "current_value": "103", "base_value": "100"}, "neutral"),
]


def test_judge(spark):
    df = spark.createDataFrame([(i, *claim(**k)) for i, (k, _) in enumerate(CASES)], "n int, " + CLAIM)
    got = {r.n: r.verdict for r in verdicts.judge(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [v for _, v in CASES]
    r = verdicts.judge(spark.createDataFrame([claim()], CLAIM), scope_break="2023").first()
    assert (r.verdict, r.reason) == ("incomparable", "scope_break")
    legacy = verdicts.judge(spark.createDataFrame([claim(magnitude_value="5", magnitude_unit="%", direction="down", current_value="95")], CLAIM), legacy=True).first()
    assert legacy.verdict == "contradicted"
    with pytest.raises(Exception, match="0 to 1"):
        verdicts.judge(spark.createDataFrame([claim(metric_kind="ratio", current_value="10", base_value="9")], CLAIM)).collect()


def test_absolute_and_budget(spark):
    schema = "magnitude_value decimal(20,6), magnitude_unit string, metric_unit_kind string, target_metric_aligned boolean, metric_sign string, current_value decimal(20,6)"
    rows = [(D(2420), "亿元", "currency", True, "cost", D("259084.996")), (D(1), "斤", "ton", True, "gain", D(1)), (D(1), "亿元", "currency", False, "gain", D(1)), (D(1), "%", "percent", True, "gain", D(1))]
    got = verdicts.absolute_variance(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    assert (got[0].target, got[0].variance, got[0].side) == (242000, D("17084.996"), "worse")
    assert [r.refused for r in got] == [None, "unit_factor", "not_aligned", "unit_kind"] and {r.verdict for r in got} == {"needs_review"}


def test_index(spark):
    schema = "h decimal(20,6), c decimal(20,6), r decimal(20,6), p decimal(20,6), q decimal(20,6), n long, total long"
    rows = [(0, 0, 0, 0, 0, 6, 10), (1, 1, 1, 0, 0, 10, 10), (-1, -1, 0, 1, 1, 10, 10), (0, 0, 0, 0, 0, 5, 10), (0, 0, 0, 0, 0, 4, 5), (None, 0, 0, 0, 0, 6, 10), (1, 1, 1, 0, 0, 0, 0)]
    df = spark.createDataFrame([tuple(None if v is None else (D(v) if i < 5 else v) for i, v in enumerate(r)) for r in rows], schema).coalesce(1)
    got = index.scenario_weights(index.diagnosis(df)).collect()
    assert [None if r.score is None else float(r.score) for r in got] == [50, 95, 0, None, None, None, None]
    assert [r.grade for r in got] == ["medium", "high", "low", *["insufficient"] * 4]
    assert got[1].base == D("0.60") and got[3].base is None
    with pytest.raises(ValueError):
        index.scenario_weights(df.withColumn("grade", F.lit("high")), {"high": ("0.5", "0.5", "0.5")})
    scored = spark.createDataFrame([("p", "H", 1), ("p", "H", 0), ("p", "C", -1), ("p", "C", None)], "project_id string, bucket string, score int")
    r = index.history_current(scored, ["project_id"]).first()
    assert (r.h, r.c, r.n) == (D("0.5"), -1, 3)
    with pytest.raises(Exception, match="scores"):
        index.history_current(scored.withColumn("score", F.lit(2)), ["project_id"]).collect()


def test_quality(spark):
    rows = [("p", str(y), D(a), D(o), D(r), s) for y, a, o, r, s in ((2021, 100, 20, 1000, "confirmed"), (2022, 100, 20, 1000, "confirmed"), (2023, 200, 60, 1000, "confirmed"), (2024, 210, 63, 1000, "pending"))]
    df = spark.createDataFrame(rows, "project_id string, period string, receivable decimal(20,6), over_one_year decimal(20,6), revenue decimal(20,6), status string")
    got = {r.period: r for r in quality.receivables(df, ["project_id"]).collect()}
    assert got["2021"].blocked == "no_prior" and got["2024"].blocked == "not_confirmed"
    assert got["2023"].triggered is True and got["2023"].days == D("54.75") and got["2022"].triggered is False
    streak = spark.createDataFrame([("p", y, D(c), D(1)) for y, c in ((2019, -1), (2020, -2), (2022, -3), (2023, 4))], "p string, y int, cfo decimal(20,6), ni decimal(20,6)")
    r = quality.cash_streak(streak, ["p"], "y", "cfo", "ni").first()
    assert (r.longest, r.triggered) == (3, True)
    items = spark.createDataFrame([("p", True, "sufficient", ""), ("p", True, "insufficient", ""), ("p", False, None, "none held")], "p string, applicable boolean, conclusion string, evidence string")
    c = quality.risk(items, ["p"]).first().component
    assert (c.numerator, c.denominator, c.value, c.verified) == (1, 2, D("0.5"), True)
    assert not quality.risk(items.withColumn("evidence", F.lit(" ")), ["p"]).first().component.verified
    states = spark.createDataFrame([("p", "q2", "triggered"), ("p", "q2", "triggered"), ("p", "q1", "clear"), ("p", "q3", "not_applicable")], "p string, item string, state string")
    assert quality.checklist(states, ["p"]).first().component.value == D("0.5")
    assert quality.checklist(states, ["p"], legacy=True).first().component.numerator == 2


def test_claim_text(spark):
    rows = [
        ("2018年公司计划产铁4563万吨、营业总收入2786亿元、营业成本2,420亿元。", ["营业成本"], "2420", "亿元", "exact", True, True), ("力争销量增长不低于5%。", [], "5", "%", "at_least", False, True),
        ("销量约 4,976.3 万吨", [], "4976.3", "万吨", "about", False, True), ("公司2019-2021年规划目标", [], None, None, None, None, None), ("2022年共12家", [], "12", "", "exact", False, True),
        ("固定资产投资239.2亿元", ["营业成本"], "239.2", "亿元", "exact", False, False),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "n int, t string, a array<string>")
    got = {r.n: r.m for r in df.select("n", text.magnitude(F.col("t"), F.col("a")).alias("m")).collect()}
    for i, (_, _, value, unit, bound, plan, aligned) in enumerate(rows):
        m = got[i]
        assert (m is None) if value is None else (m.value, m.unit, m.bound, m.is_plan, m.aligned) == (D(value), unit, bound, plan, aligned), i


DIRECTIONS = [
    ("全年销量同比增长5%", ["销量"], "up", False), ("未能实现销量增长", ["销量"], "unknown", False), ("对标找差，优势显现，核心竞争力显著提升", ["成本"], "unknown", False), ("成本管控，效率提升", ["成本"], "improve", False),
    ("力争收入上升", ["销量"], "up", True), ("费用下降", [], "down", False), ("市场走弱", [], "deteriorate", False), ("销量持平", [], "flat", False),
]


def test_direction(spark):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _, _) in enumerate(DIRECTIONS)], "n int, t string, a array<string>")
    got = {r.n: (r.d.direction, r.d.intended) for r in df.select("n", text.direction(F.col("t"), F.col("a")).alias("d")).collect()}
    assert [got[i] for i in range(len(DIRECTIONS))] == [(d, m) for _, _, d, m in DIRECTIONS]


def test_themes_periods_scope(spark):
    c = lambda t: F.lit(t)
    row = spark.range(1).select(
        text.match_theme(c("化工产品的生产销售")).alias("a"), text.match_theme(c("产销量与库存")).alias("b"), text.match_theme(c("降本与销量")).alias("c"), text.match_theme(c("高端新产品")).alias("d"),
        text.claim_period(c("2024 年计划"), c("2023")).alias("e"), text.claim_period(c("明年有望"), c("2023")).alias("f"), text.claim_period(c("全年预计"), c("2023")).alias("g"), text.claim_period(c("同比上升"), c("2023")).alias("h"),
        text.claim_period(c("上年同期"), c("2023H1")).alias("i"), text.claim_period(c("明年"), c("2023"), False).alias("j"), text.industry_scope(c("国家统计局数据显示，产量下降")).alias("k"), text.industry_scope(c("本公司产量")).alias("l"),
        text.sentences(c("营业收入增长5%，成本下降。短句。\n1 2 3 4\n  续行说明情况良好！"), min_length=4).alias("m"), text.normalize_label(c(" 一、其中：应收 账款（注1）")).alias("n"),
    ).first()
    assert row.a is None and row.b.theme == "demand_sales" and row.c.theme == "cost_reduction" and row.d.usable is False
    assert (row.e, row.f, row.g, row.h, row.i, row.j) == ("2024", "2024", None, "2023", "2022", None)
    assert (row.k, row.l) == (True, False) and row.m == ["营业收入增长5%，成本下降。", "续行说明情况良好！"] and row.n == "应收账款"


def test_number_guard(spark):
    allowed = F.array(*[F.lit(x).cast("decimal(20,6)") for x in ("258508500000", "0.0512", "12")])
    t = F.lit("2024年成本2,585.09亿元，增长5.12%，共12家，另有7亿元")
    row = spark.range(1).select(text.unsupported_numbers(t, allowed).alias("bad"), text.redact(t, text.unsupported_numbers(t, allowed)).alias("shown")).first()
    assert [(x.raw, x.unit) for x in row.bad] == [("7", "亿元")] and "[?]亿元" in row.shown and "2,585.09" in row.shown


def test_figures(spark):
    rows = ["1,234.50", "(12)", "（3.5）", "—", "-", "", "n/a", "１２", None, "1 000"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, t string")
    got = {r.n: r.f for r in df.select("n", numeric.parse_figure(F.col("t")).alias("f")).collect()}
    assert [got[i].value for i in range(10)] == [D("1234.5"), -12, D("-3.5"), None, None, None, None, 12, None, 1000]
    assert [i for i in range(10) if got[i].is_dash] == [3, 4]


def test_adoption_and_merges(spark):
    obs = spark.createDataFrame([("o1", "m", 2023, 2023, D(5)), ("o2", "m", 2024, 2023, D(6)), ("o3", "m", 2022, 2023, D(5)), ("o4", "k", 2023, 2022, D(1)), ("o5", "k", 2024, 2022, D(2))], "observation_id string, metric string, report_year int, period int, value decimal(20,6)")
    got = {r.observation_id: (r.resolution, r.note) for r in relational.adopt(obs, ["metric"]).collect()}
    assert got["o1"] == ("adopted", None) and got["o2"] == ("rejected", "adopted 5.000000") and got["o3"] == ("rejected", "same value") and got["o5"][0] == "adopted"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, None)], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, None)]
    assert sorted(map(tuple, relational.insert_ignore(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, None)]


def test_search(spark):
    pages = spark.createDataFrame([("a1", "a", "steel output rose. steel steel"), ("a2", "a", "Steel fell 5% in_1"), ("b1", "b", "nothing here")], "page_id string, file_id string, text string")
    ids = lambda q, **k: [r.page_id for r in search.search(pages, q, **k).collect()]
    assert ids("steel") == ["a1", "a2"] and ids("  ") == [] and ids("5%") == ["a2"] and ids("n_") == ["a2"] and ids("steel", files=["b"]) == [] and ids("steel", limit=1) == ["a1"]
    index = search.postings(pages)
    assert search.index_drift(pages, index).count() == 0 and search.index_drift(pages.where("page_id <> 'b1'"), index).count() == 1
    top = search.ranked(pages, spark.createDataFrame([(1, "steel")], "query_id int, query string"), index, 1).first()
    assert top.page_id == "a1"


def test_constraints(spark):
    schema = "fact_id string, project_id string, company_id string, metric_key string, period string, period_kind string, scope string, restated boolean, status string, comparable boolean, incomparable_reason string, source_file_id string, source_page int, source_text string"
    good = ("k1", "p", "c", "revenue", "2024", "current", "consolidated", False, "validated", True, None, "f1", 86, "t")
    rows = [good, ("k2", *good[1:]), (*("k3", "p", "c", "odd", "2023", "prior", "consolidated", False, "validated", False, " ", "f9", None, ""),)]
    got = constraints.fact_violations(spark.createDataFrame(rows, schema), spark.createDataFrame([("revenue",)], "metric_key string"), spark.createDataFrame([("f1",)], "file_id string"))
    assert sorted(r.rule for r in got.collect()) == ["enum period_kind", "foreign_key metric_key", "foreign_key source_file_id", "incomparable has reason", "unique", "validated has provenance"]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("p1", D("1.5"), ["a", 'b"c']), ("p2", None, ["x\ny"])], "project_id string, value decimal(20,6), names array<string>")
    store.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, store.read_csv(spark, f"{tmp_path}/csv", df.schema).collect())) == sorted(map(tuple, df.collect()))
    store.write_json(store.as_text(df), f"{tmp_path}/json")
    assert store.read_json(spark, f"{tmp_path}/json", "value string").where("value = '1.500000'").count() == 1
    store.replace_batch(df, f"{tmp_path}/batch", "project_id")
    store.replace_batch(df.where("project_id = 'p1'").withColumn("value", F.lit("9").cast("decimal(20,6)")), f"{tmp_path}/batch", "project_id")
    assert sorted((r.project_id, r.value) for r in spark.read.parquet(f"{tmp_path}/batch").collect()) == [("p1", 9), ("p2", None)]
    a = {"file": spark.createDataFrame([("f1",)], "file_id string"), "fact": spark.createDataFrame([("k1", "f1")], "fact_id string, source string")}
    b = {"file": spark.createDataFrame([("f2",)], "file_id string"), "fact": spark.createDataFrame([("k2", "f2")], "fact_id string, source string")}
    keys, refs = {"file": "file_id", "fact": "fact_id"}, [("fact", "source", "file")]
    assert store.merge(a, b, ["file", "fact"], keys, refs)["fact"].count() == 2
    with pytest.raises(ValueError, match="there already"):
        store.merge(a, a, ["file", "fact"], keys, refs)
    with pytest.raises(ValueError, match="without"):
        store.merge(a, b | {"fact": b["fact"].withColumn("source", F.lit("f3"))}, ["file", "fact"], keys, refs)
    requests = spark.createDataFrame([("q",)], "request string")
    tape = requests.select(F.substring(F.sha2("request", 256), 1, 32).alias("key"), F.lit("yes").alias("response"))
    assert store.replayed(requests, tape).first().response == "yes"
    with pytest.raises(Exception, match="no recording"):
        store.replayed(requests, tape.limit(0)).collect()


def test_transition_stream_equals_batch(spark, tmp_path):
    rows = [("t1", i + 1, s) for i, s in enumerate(["pending", "planning", "running", "completed", "running"])] + [("t2", 1, "pending"), ("t2", 2, "running")]
    df = spark.createDataFrame(rows, "task string, seq long, state string")
    want = sorted(map(tuple, events.transitions(df, "task", ["seq"], "state", events.TASK_STEPS).select("task", "seq", "previous", "state", "legal").collect()))
    for k, part in enumerate((df.where("seq <= 2"), df.where("seq > 2"))):
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).json(f"{tmp_path}/in")
    q = events.transition_stream(stream, "task", "state", events.TASK_STEPS).writeStream.format("memory").queryName("steps").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("steps").collect())) == want
    assert [r[4] for r in want if r[0] == "t1"] == [True, True, True, True, False]


def test_transition_stream_gives_out_parts(spark, tmp_path, monkeypatch):
    """A task with more events than are given out at a time, in no order within its batch, and with null states."""
    rows = [("t", i, [None, "pending", "running", "completed"][i * 7 % 4]) for i in range(1, 100)]
    df = spark.createDataFrame(rows, "task string, seq long, state string")
    df.orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(events, "ROWS", 10)
    out = events.transition_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "task", "state", events.TASK_STEPS)
    q = out.writeStream.format("memory").queryName("parts").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    states = [s for _, _, s in rows]
    want = [("t", i + 1, p, s, p is None or (p, s) in events.TASK_STEPS) for i, (p, s) in enumerate(zip([None, *states], states))]
    assert sorted(map(tuple, spark.table("parts").collect()), key=lambda r: r[1]) == want


def test_registry():
    tools = Registry()

    @tools.tool("facts.series", keywords=("trend", "series"))
    def series(spark, sf_dir, limit=5):
        return (spark, sf_dir, limit)

    assert tools.call("facts.series", spark=1, sf_dir=2) == (1, 2, 5) and tools.route("show the trend") == "facts.series" and tools.route("?") is None
    for bad in ({"spark": 1}, {"spark": 1, "sf_dir": 2, "x": 3}):
        with pytest.raises(TypeError):
            tools.call("facts.series", **bad)
    with pytest.raises(ValueError):
        tools.tool("facts.series")(series)
    assert tools.describe()[0]["required"] == ["spark", "sf_dir"]


def test_totals_hold_numbers_of_any_length(spark, sf, tmp_path):
    import re
    from collections import defaultdict

    from steelyard.plans.text import number_extract
    from steelyard.sources import tables

    def brute(texts):
        out = defaultdict(lambda: [0, Decimal(0), 0])
        for m in re.finditer(r"([-−+]?)([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)[ \t\n\x0b\f\r]*(km|%|m)?", "\x00".join(texts)):
            sign, raw, unit = m[1], m[2], m[3] or ""
            if unit or not re.fullmatch("(19|20)[0-9]{2}", raw):
                whole, _, places = raw.replace(",", "").partition(".")
                fits = len(whole.lstrip("0")) <= 18 and len(places.rstrip("0")) <= 10
                out[unit][0] += 1
                out[unit][1] += fits * Decimal(raw.replace(",", "")) * (-1 if sign in ("-", "−") else 1) * {"km": 1000, "%": Decimal("0.01")}.get(unit, 1)
                out[unit][2] += not fits
        return {u: (n, float(total), unfit) for u, (n, total, unfit) in out.items()}

    texts = ["1,234,567 and 12345.678 or -123456789012345678", "12345678.25% or 0.12345678901 m or 1.00000000000 m", "-1,234,567.5 km", "1234567890123456789 km"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for path in (str(tmp_path), sf):
        got = {r.unit: (r.n, r.total, r.unfit) for r in number_extract(spark, path).collect()}
        assert got == brute([r.text for r in tables.table(spark, path, "documents").collect() if r.text is not None])
    assert number_extract(spark, str(tmp_path)).where("unit = 'km'").first().total == -1234567500.0


def test_registered_tools(spark):
    from steelyard.plans.tools import TOOLS
    from steelyard.sources import schema

    facts = [("p", k, str(y), v) for y, r, c in ((2022, 100, 80), (2023, 110, 85), (2025, 120, 90)) for k, v in (("revenue", r), ("operating_cost", c), ("cfo", 5))] + [("q", "revenue", "2023", 7)]
    rows = [(p, k, y, Decimal(v), True, "validated") for p, k, y, v in facts] + [("p", "revenue", "2021", Decimal(1), True, "pending")]
    facts = spark.createDataFrame(rows, "project_id string, metric_key string, period string, value decimal(20,6), comparable boolean, status string")
    said = [("p", 0, "订单饱满，需求旺盛。", 3, "2023", False), ("p", 1, "需求旺盛。", 3, "2023", False), ("p", 2, "成本下降。", 4, "2023", False), ("p", 3, "需求旺盛但有风险。", 9, "2023", False), ("p", 4, "现款现货。", 4, "2022", True), ("p", 5, "稳产高产。", 4, "2024", True), ("q", 6, "产销两旺。", 1, "x", True)]
    said = spark.createDataFrame(said, "project_id string, n int, text string, page_no int, period string, forward boolean")
    got = {r.project_id: (r.years, r.metrics, r.facts) for r in TOOLS.call("facts.coverage", facts=facts).collect()}
    assert got == {"p": (["2022", "2023", "2025"], 3, 9), "q": (["2023"], 1, 1)}
    series = TOOLS.call("facts.series", facts=facts, metric_key="revenue", project_id="p").orderBy("period").collect()
    assert [(r.period, r.yoy.value, r.yoy.refused) for r in series] == [("2022", None, "first"), ("2023", Decimal("0.1"), None), ("2025", None, "gap")]
    margins = {r.period: r.margin.value for r in TOOLS.call("facts.margin", facts=facts, project_id="p").collect()}
    assert margins["2022"] == 20 and margins["2025"] == 25
    claims = {(r.project_id, r.theme_key, r.n): r.verify_period for r in TOOLS.call("narrative.claims", utterances=said).collect()}
    assert claims == {("p", "demand", 0): "2023", ("p", "cost", 2): "2023", ("p", "cash", 4): "2023", ("p", "capacity", 5): "2025", ("q", "demand", 6): "x"}
    judged = {(r.project_id, r.theme_key): r.verdict for r in TOOLS.call("narrative.consistency", utterances=said, facts=facts).collect()}
    assert judged == {("p", "demand"): "consistent", ("p", "cost"): "consistent", ("p", "cash"): "incomparable", ("p", "capacity"): "missing", ("q", "demand"): "missing"}
    assert {r.theme_key for r in TOOLS.call("narrative.consistency", utterances=said, facts=facts, theme_key="cash", forward_next_year=False).collect()} == {"cash"}
    assert {r.name: r.rows for r in TOOLS.call("system.db_stats", spark=spark, tables={"facts": facts, "said": said}).collect()} == {"facts": 11, "said": 7}
    assert TOOLS.call("system.dictionary_check", metrics=schema.metrics(spark)).count() == 0
    assert TOOLS.call("system.rule_config_check", rules=schema.rules(spark)).count() == 0
    assert TOOLS.route("毛利率怎样") == "facts.margin" and len(TOOLS.describe()) == 8


def test_templates_and_pending_observations(spark, tmp_path):
    from steelyard.sources import store

    projects = spark.createDataFrame([("p", ["2023", "2024"])], "project_id string, fiscal_years array<string>")
    done = spark.createDataFrame([("p", "2024", "consolidated", 5, "confirmed")], "project_id string, period string, scope string, receivable int, status string")
    grid = store.q2_template(projects, done)
    assert {(r.period, r.receivable, r.status) for r in grid.collect()} == {("2023", None, "pending"), ("2024", 5, "confirmed")}
    store.write_csv(grid, f"{tmp_path}/q2")
    back = store.import_decided(store.read_csv(spark, f"{tmp_path}/q2", grid.schema))
    assert [tuple(r) for r in back.select("period", "receivable").collect()] == [("2024", 5)]
    items = spark.createDataFrame([("p", "2024", "price", "no risk", "confirmed")], "project_id string, period string, item string, conclusion string, status string")
    assert store.r_template(projects, ["price", "fx"], items).where("status = 'pending'").count() == 3
    claims = spark.createDataFrame([("c1", "one"), ("c2", "two")], "claim_id string, claim_text string")
    kept = spark.createDataFrame([("c2", True, "confirmed")], "claim_id string, is_template boolean, status string")
    assert {(r.claim_id, r.claim_text, r.status) for r in store.p_template(claims, kept).collect()} == {("c1", "one", "pending"), ("c2", "two", "confirmed")}
    store.append_pending(spark.createDataFrame([("o1", 1)], "observation_id string, value int"), f"{tmp_path}/seen")
    store.append_pending(spark.createDataFrame([("o2", 2)], "observation_id string, value int"), f"{tmp_path}/seen")
    assert {(r.observation_id, r.resolution) for r in spark.read.parquet(f"{tmp_path}/seen").collect()} == {("o1", "pending"), ("o2", "pending")}


def test_ambiguous_words_follow_from_the_vocabularies():
    from steelyard.functions.text import Directions
    from steelyard.plans.text import WORDS

    for w in (Directions(), WORDS):
        state = (*w.improve, *w.deteriorate)
        assert w.ambiguous == tuple(t for t in (*w.up, *w.down) if any(t in s or s in t for s in state))


def test_aliases_of_an_industry(spark):
    from steelyard.operators.relational import alias_lookup

    rows = spark.createDataFrame([("steel_sales_volume", "销售量", 1, "steel"), ("coal_sales_volume", "销售量", 2, "energy"), ("revenue", "营业收入", 3, ""), ("cfo", "净额", 4, None)], "metric_key string, alias string, rank int, industry string")
    found = {i: {r.label: r.metric_key for r in alias_lookup(rows, F.trim, i)[0].collect()} for i in (None, "steel", "energy")}
    assert found["steel"]["销售量"] == "steel_sales_volume" and found["energy"]["销售量"] == "coal_sales_volume" and all(f["营业收入"] == "revenue" and f["净额"] == "cfo" for f in found.values())
    assert alias_lookup(rows, F.trim)[1].count() == 1 and alias_lookup(rows, F.trim, "steel")[1].count() == 0


def test_drift_reads_the_index_once(spark):
    from steelyard.operators import search

    pages = spark.createDataFrame([("a", "abcd"), ("b", "a😀bc"), ("c", "xy"), (None, "long")], "page_id string, text string")
    index = search.postings(pages.where("page_id <> 'a'").unionByName(spark.createDataFrame([("d", "gone")], "page_id string, text string")))
    assert {(r.page_id, r.gram) for r in index.collect()} == {("b", "a😀b"), ("b", "😀bc"), ("d", "gon"), ("d", "one")}
    drift = search.index_drift(pages, index)
    assert sorted((str(r.page_id), r.side) for r in drift.collect()) == [("None", "not_indexed"), ("a", "not_indexed"), ("d", "no_page")]
    assert drift._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_constraints_have_tasks_by_rows(spark, monkeypatch):
    from steelyard.operators import constraints

    monkeypatch.setattr(constraints, "ROWS", 10)
    rows = spark.range(60).selectExpr("id % 50 AS k", "CAST(IF(id % 7 = 0, NULL, id) AS BIGINT) AS v")
    twice = constraints.unique(rows, ["k"])
    assert ", 7), REPARTITION_BY_NUM" in twice._jdf.queryExecution().executedPlan().toString() and {r.key for r in twice.collect()} == {str(k) for k in range(10)}
    lost = constraints.foreign_key(rows, "v", spark.range(30).withColumnRenamed("id", "p"), "p", "k")
    assert lost._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert sorted(int(r.key) for r in lost.collect()) == sorted(k % 50 for k in range(30, 60) if k % 7)
