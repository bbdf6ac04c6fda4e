"""Statements over pages, sightings with their units, and batches of facts on made-up reports."""

from decimal import Decimal

import pytest

from steelyard.operators import facts, grid
from steelyard.operators import report_tables as rt
from steelyard.sources import geometry, schema, statements, store
from test_extraction import words

CHARS = "file_id string, page_no int, c string, x0 double, x1 double, y0 double, height double"


def characters(pages):
    """``pages``: file, page and lines of cells ``(text, x, right)``."""
    return [(file, number, *c[2:]) for file, number, lines in pages for k, line in enumerate(lines) for c in words(100 + 20 * k, *line)]


def row(label, *values, note=None):
    out = [(label, 90, False)] + ([(note, 230, False)] if note else [])
    return out + [(v, x, True) for v, x in zip(values, (360, 480), strict=False) if v]


def head(*labels):
    return [("项目", 90, False), ("附注", 230, False)] + [(t, x, False) for t, x in zip(labels, (300, 420), strict=True)]


def title(text):
    return [(text, 200, False)]


def unit(text="元"):
    return [(f"单位：{text}", 400, False)]


def read(spark, pages, years=None):
    df = spark.createDataFrame(characters(pages), CHARS)
    reports = spark.createDataFrame([(f, (years or {}).get(f)) for f in {p[0] for p in pages}], "file_id string, report_year string")
    found, rows = statements.tables(geometry.cells(geometry.lines(geometry.body(df))), reports)
    return [tuple(r) for r in found.orderBy("file_id", "page_no").collect()], rows.collect()


def test_a_statement_runs_to_the_next_title(spark):
    tail = [row("上表末行", "9.00", "8.00")]
    first = [*tail, title("1、合并资产负债表"), unit(), head("2024年12月31日", "2023年12月31日"), row("货币资金", "1,000.00", "900.00", note="（五）1"), row("应收账款", "300.00", "-", note="2"), [("非流动资产：", 90, False)]]
    second = [head("2024年12月31日", "2023年12月31日"), row("固定资产", "7,000.00", "6,500.00", note="3"), row("资产总计", "8,300.00", "7,400.00")]
    third = [row("负债合计", "(5.00)", "4.00"), title("2、母公司资产负债表"), unit("万元"), head("2024年12月31日", "2023年12月31日"), row("货币资金", "1.00", "2.00"), row("存货", "3.00", "4.00"), row("资产总计", "4.00", "6.00")]
    found, rows = read(spark, [("f", 3, first), ("f", 4, second), ("f", 5, third)])
    assert [(r[1], r[3], r[4], r[5], r[7]) for r in found] == [(3, "balance", "consolidated", "元", None), (5, "balance", "parent", "万元", None)]
    got = {(r.scope, r.label, r.period): r for r in rows}
    assert got["consolidated", "货币资金", "2024"].value == 1000 and got["consolidated", "货币资金", "2024"].note == "（五）1"
    assert got["consolidated", "资产总计", "2023"].value == 7400 and got["consolidated", "资产总计", "2023"].page_no == 4
    assert got["consolidated", "负债合计", "2024"].value == -5 and got["consolidated", "应收账款", "2023"].is_dash
    assert got["parent", "货币资金", "2024"].value == 1 and got["parent", "资产总计", "2023"].value == 6
    assert not any(r.label == "上表末行" for r in rows) and {r.period_kind for r in rows} == {"instant"}
    assert got["consolidated", "固定资产", "2024"].source_text == "固定资产  3  7,000.00  6,500.00"


def test_six_pages_at_most(spark):
    pages = [("f", 1, [title("合并利润表"), unit(), head("2024年度", "2023年度"), row("第1页", "1.00", "2.00")])] + [("f", p, [row(f"第{p}页", "1.00", "2.00")]) for p in range(2, 9)]
    rows = read(spark, pages)[1]
    assert {r.page_no for r in rows} == set(range(1, 7)) and {r.period_kind for r in rows} == {"current"}


def test_years_from_header_date_and_report(spark):
    table = [row("营业收入", "3.00", "2.00"), row("营业成本", "2.00", "1.00"), row("净利润", "1.00", "1.00")]
    pages = [
        ("own", 1, [title("合并利润表"), unit(), head("2022年度", "2021年度"), *table]),
        ("date", 1, [[("2020年度报告", 90, False)], title("合并资产负债表"), [("2023年12月31日", 90, False)], unit(), head("期末余额", "期初余额"), *table]),
        ("words", 1, [title("合并利润表"), unit(), head("本期金额", "上期金额"), *table]),
        ("none", 1, [title("合并利润表"), unit(), head("本期金额", "上期金额"), *table]),
    ]
    found, rows = read(spark, pages, {"own": "2024", "date": "2024", "words": "2024"})
    assert {r[0]: (r[6], r[7]) for r in found} == {"own": ("header", None), "date": ("statement_date", None), "words": ("report_year", None), "none": (None, "no_period")}
    assert {(r.file_id, r.column, r.period) for r in rows} == {("own", 0, "2022"), ("own", 1, "2021"), ("date", 0, "2023"), ("date", 1, "2022"), ("words", 0, "2024"), ("words", 1, "2023")}


def test_what_is_refused_is_said(spark):
    table = [row("营业收入", "3.00", "2.00"), row("营业成本", "2.00", "1.00"), row("净利润", "1.00", "1.00")]
    whole = [title("合并利润表"), unit(), head("2022年度", "2021年度"), *table]
    pages = [
        ("contents", 1, [title("合并利润表"), title("合并资产负债表"), *whole[1:]]),
        ("again", 1, [title("合并利润表"), *whole[2:]]), ("again", 2, whole), ("again", 3, whole),
        ("bare", 1, [title("合并利润表"), unit(), *table]), ("empty", 1, [title("合并利润表"), unit(), [("正文", 90, False)]]), ("few", 1, [title("合并利润表"), unit(), head("2022年度", "2021年度"), *table[:2]]),
    ]
    found, rows = read(spark, pages)
    assert {(r[0], r[1]): r[7] for r in found} == {("again", 1): "no_unit", ("again", 2): None, ("again", 3): "repeated", ("bare", 1): "no_header", ("empty", 1): "no_rows", ("few", 1): "no_columns"}
    assert {(r.file_id, r.page_no) for r in rows} == {("again", 2)}
    assert statements.tables(spark.createDataFrame([], "file_id string, page_no int, line int, cell int, text string, x0 double, x1 double"), spark.createDataFrame([], "file_id string, report_year string"))[1].count() == 0


def test_lines_are_those_of_one_scan(spark):
    """A run of characters each within 3 points of the line's first one, and wrapped lines, against the plain loop."""
    import random

    r = random.Random(4)
    rows, want = [], {}
    for page in range(6):
        ys, y = [], 70.0
        for _ in range(80):
            y += r.choice([0.0, 0.5, 2.9, 3.0, 3.1, 6.0, 9.9, 10.0, 14.0])
            ys.append(round(y, 1))
        tops, line, top = [], -1, None
        for y in ys:
            if top is None or y - top > geometry.LINE:
                line += top is None or y - top >= geometry.WRAP
                top = y
            want[page, y] = line
        rows += [("f", page, "x", 6.0 * k, 6.0 * k + 5, y, 2000.0) for k, y in enumerate(ys)]
    got = geometry.lines(spark.createDataFrame(rows, CHARS)).collect()
    assert len(got) == len(rows) and all(want[r.page_no, r.y0] == r.line for r in got)


def test_characters_are_shuffled_once(spark):
    """From characters to cells there is one exchange, of rows or of pages alike, with the same cells."""
    rows = [("f", p, c, x0 + 7.0 * k, x0 + 7.0 * k + 6, y, 900.0) for p in (1, 2) for x0, y, word in ((90.0, 100.0, "合计"), (200.0, 101.5, "1,2"), (90.0, 104.0, "in"), (90.0, 130.0, "b c"), (90.0, 20.0, "head")) for k, c in enumerate(word)]
    chars = spark.createDataFrame(rows, CHARS)
    by_row = geometry.cells(geometry.lines(geometry.body(chars)))
    assert by_row._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {(p, line, cell, text) for p in (1, 2) for line, cell, text in ((0, 0, "合i计n"), (0, 1, "1,2"), (1, 0, "bc"))}
    for got in (by_row, geometry.page_cells(geometry.packed(chars))):
        assert {(r.page_no, r.line, r.cell, r.text) for r in got.collect()} == want and got.count() == 6


OBSERVATION = "observation_id string, metric_key string, period string, value string, report_year int, source_file_id string"


def sightings(spark, *rows):
    out = spark.createDataFrame(rows, OBSERVATION)
    fixed = {"project_id": "'p'", "company_id": "'p'", "period_kind": "'current'", "scope": "'consolidated'", "raw_unit": "'元'", "value_raw": "value", "source_page": "1", "source_text": "'t'", "location": "'statement'", "resolution": "null", "resolved_fact_id": "null", "rejection_note": "null"}
    kinds = dict(x.rsplit(" ", 1) for x in schema.SCHEMAS["fact_observation"].split(", "))
    out = out.selectExpr("*", *[f"{v} AS {k}" for k, v in fixed.items()])
    return out.selectExpr(*[f"CAST({k} AS {t}) AS {k}" for k, t in kinds.items()])


def kept(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_fact_is_never_overwritten(spark):
    first = sightings(spark, ("o1", "revenue", "2022", "10", 2022, "r22"), ("o2", "revenue", "2022", "10", 2023, "r23"), ("o3", "revenue", "2023", "12", 2024, "r24"), ("o4", "revenue", "2023", "11", 2023, "r23"), ("o9", "revenue", "2021", None, 2022, "r22"))
    resolve = lambda *a, **k: tuple(store.written(x, "batch") for x in facts.resolve(*a, **k))
    seen, found = resolve(first, now="1")
    assert kept(found, "period", "value", "restated", "unit", "status", "source_file_id") == [("2022", 10, False, "百万元", "validated", "r22"), ("2023", 11, True, "百万元", "validated", "r23")]
    assert kept(seen, "observation_id", "resolution") == [("o1", "adopted"), ("o2", "rejected"), ("o3", "rejected"), ("o4", "adopted"), ("o9", "rejected")]
    assert {r.restatement_note for r in found.collect()} == {None, "also stated: r24 12.000000"}
    # the same batch once more adds nothing
    again = resolve(first, found, seen, now="2")
    assert kept(again[1], *found.columns[:20]) == kept(found, *found.columns[:20]) and kept(again[0], "observation_id", "resolution") == kept(seen, "observation_id", "resolution")
    # a later report: an equal value, a different one twice, and a new period
    later = sightings(spark, ("o5", "revenue", "2022", "10", 2024, "r24"), ("o6", "revenue", "2022", "9", 2025, "r25"), ("o7", "revenue", "2024", "15", 2024, "r24"))
    seen2, found2 = resolve(later, found, seen, now="2")
    assert kept(found2, "period", "value", "restated") == [("2022", 9, True), ("2022", 10, False), ("2023", 11, True), ("2024", 15, False)]
    assert {r.observation_id: (r.resolution, r.rejection_note) for r in seen2.collect() if r.observation_id in ("o5", "o6", "o7")} == {"o5": ("rejected", "adopted before: o1"), "o6": ("rejected", "adopted before: o1"), "o7": ("adopted", None)}
    third = sightings(spark, ("o8", "revenue", "2022", "9", 2026, "r26"))
    seen3, found3 = resolve(third, found2, seen2, now="3")
    assert found3.count() == found2.count() and kept(found3, "fact_id") == kept(found2, "fact_id")
    adopted = seen3.where("resolution = 'adopted'")
    assert adopted.count() == 3 and adopted.join(found3, adopted.resolved_fact_id == found3.fact_id).count() == 3
    empty = resolve(schema.empty(spark, "fact_observation"), found, seen)
    assert empty[0].count() == seen.count() and empty[1].count() == found.count()


@pytest.mark.parametrize(("kind", "unit", "value"), [("currency", "万元", Decimal("12.34")), ("currency", "吨", None), ("per_share", "元", 1234), ("ton", "万吨", 12340000), ("ton", "元", None), ("percent", "%", 1234), ("shares", "股", 1234)])
def test_units_by_the_metric(spark, kind, unit, value):
    from pyspark.sql import functions as F

    got = spark.range(1).select(facts.scaled(F.lit(1234).cast("decimal(20,6)"), F.lit(unit), F.lit(kind)).alias("v")).first().v
    assert got == value


def report(file, year, revenue, last):
    rows = [title("合并利润表"), unit("万元"), head("本期金额", "上期金额"), row("营业收入", revenue, last), row("营业成本", "700.00", "650.00"), row("基本每股收益", "1.25", "1.20")]
    sales = [[("(2)产销量情况分析表", 90, False)], [("主要产品", 90, False), ("单位", 170, False), ("生产量", 250, False), ("销售量", 350, False), ("库存量", 450, False)]]
    sales += [[(n, 90, False), ("万吨", 170, False), (a, 270, True), (b, 370, True), (c, 470, True)] for n, a, b, c in (("热轧", "12", "11", "3"), ("冷轧", "8", "7", "2"), ("合计", "20", "18", "5"))]
    return [(file, 1, rows), (file, 2, sales)]


def test_ingest_to_the_grid(spark):
    names = spark.createDataFrame([("营业收入", "revenue"), ("营业成本", "operating_cost"), ("基本每股收益", "eps_basic")], "alias string, metric_key string")
    reports = spark.createDataFrame([("r24", "p", "p", "2024"), ("r23", "p", "p", "2023")], "file_id string, project_id string, company_id string, report_year string")
    df = lambda *files: spark.createDataFrame(characters([x for f in files for x in f]), CHARS)
    r23, r24 = report("r23", "2023", "1,000.00", "900.00"), report("r24", "2024", "1,100.00", "1,050.00")
    seen, found, read = rt.ingest(df(r23), reports, names, now="1")
    got = {(r.metric_key, r.period): (r.value, r.unit) for r in found.collect()}
    assert got["revenue", "2023"] == (10, "百万元") and got["revenue", "2022"] == (9, "百万元") and got["eps_basic", "2023"] == (Decimal("1.25"), "元/股")
    assert got["steel_output", "2023"] == (200000, "吨") and got["steel_sales_volume", "2023"] == (180000, "吨")
    assert {r.raw_unit for r in seen.where("metric_key = 'revenue'").collect()} == {"万元"} and [r.period_source for r in read.collect()] == ["report_year"]
    seen, found, _ = rt.ingest(df(r24), reports, names, facts=found, before=seen, now="2")
    projects = spark.createDataFrame([("p", ["2022", "2023", "2024"])], "project_id string, fiscal_years array<string>")
    cells = grid.grid_growth(grid.grid(projects, spark.createDataFrame([("revenue",), ("gross_profit",)], "metric_key string"), grid.verified(found)))
    by_year = {r.period: r for r in cells.collect() if r.metric_key == "revenue"}
    # what the report of 2023 said stands, and its restatement stands beside it
    assert [by_year[y].value for y in ("2022", "2023", "2024")] == [9, 10, 11] and by_year["2024"].change == Decimal("0.1")
    assert [(r.value, r.restated) for r in found.where("metric_key = 'revenue' AND period = '2023'").orderBy("restated").collect()] == [(10, False), (Decimal("10.5"), True)]
    assert found.columns == schema.empty(spark, "financial_fact").columns
