"""Sections of notes, production totals and physical sales on made-up pages."""

from decimal import Decimal

from pyspark.sql import functions as F
from steelyard.functions.numeric import to_tonnes
from steelyard.operators import report_tables as rt
from test_extraction import words

CELLS = "file_id string, page_no int, line int, cell int, text string, x0 double, x1 double"


def page(file, number, *rows):
    """Cells ten points a character; ``(text, right)`` ends at right, a text alone follows at 90."""
    out = []
    for line, row in enumerate(rows):
        for k, (text, right) in enumerate(((row, None),) if isinstance(row, str) else row):
            x1 = 90.0 + 6 * len(text) if right is None else float(right)
            out.append((file, number, line, k, text, x1 - 6 * len(text), x1))
    return out


def read(spark, cells, section, year="2024"):
    df = spark.createDataFrame(cells, CELLS)
    reports = spark.createDataFrame([(f, year) for f in {c[0] for c in cells}], "file_id string, report_year string")
    return df, {(r.label, r.period): (r.value, r.unit) for r in rt.read_tables(df, reports, (section,)).collect()}


def test_years_of_the_header(spark):
    head = (("主要会计数据", None), ("2024年", 250), ("2023年", 350), ("本期比上年同期增减(%)", 480), ("2022年", 560))
    cells = page("a", 3, "七、近三年主要会计数据和财务指标", "单位：百万元", head, (("营业收入", None), ("1,000", 250), ("1,900", 350), ("11.1", 450), ("800", 560)), (("净利润", None), ("30", 250), ("20", 350), ("50.0", 450), ("-", 560)), "八、其他", (("营业成本", None), ("1", 250), ("2", 350)))
    got = read(spark, cells, "summary")[1]
    assert got["营业收入", "2024"] == (Decimal(1000), "百万元") and got["营业收入", "2022"] == (Decimal(800), "百万元")
    assert got["净利润", "2023"][0] == 20 and ("净利润", "2022") not in got and not any(k == "营业成本" for k, _ in got)
    # without a unit on the pages of the section the file's own counts, without one nothing is read
    bare = [c for c in cells if not c[4].startswith("单位")]
    assert read(spark, bare, "summary")[1] == {}
    assert read(spark, [*bare, *page("a", 1, "财务附注中报表的单位为：元")], "summary")[1]["营业收入", "2023"] == (Decimal(1900), "元")
    # a year that no column stands under refuses the header
    torn = [c if c[4] != "2022年" else (*c[:5], 700.0, 736.0) for c in cells]
    assert read(spark, torn, "summary")[1] == {}


def test_this_year_alone(spark):
    cells = page("a", 7, "79、现金流量表补充资料", "单位：元", (("补充资料", None), ("本期金额", 300), ("上期金额", 420)), (("净利润", None), ("5.00", 300), ("4.00", 420)), (("固定资产折旧", None), ("2.50", 300), ("2.00", 420)), "80、所有权受限", (("货币资金", None), ("9.00", 300)))
    assert read(spark, cells, "cashflow_supplement")[1] == {("净利润", "2024"): (Decimal(5), "元"), ("固定资产折旧", "2024"): (Decimal("2.5"), "元")}


def test_cells_and_sentences_by_rule(spark):
    head = (("项目", None), ("期初余额", 220), ("本期增加", 320), ("本期减少", 420), ("期末余额", 520))
    cells = page("a", 9, "58、专项储备", "单位：元", head, (("安全生产费", None), ("2,000.00", 220), ("282.50", 320), ("281.00", 420), ("1.50", 520)), (("合计", None), ("2,000.00", 220), ("282.50", 320), ("281.00", 420), ("1.50", 520)), "公司本期计提安全生产费 286,112,204.89 元，已使用。", "59、盈余公积")
    assert read(spark, cells, "special_reserve")[1] == {("safety_production_fee_increase", "2024"): (Decimal("282.5"), "元"), ("safety_production_fee_provision", "2024"): (Decimal("286112204.89"), "元")}
    table = page("a", 4, "公司主要产品产能及产能利用率如下", (("产品", None), ("产能", 250), ("产能利用率", 400)), (("钢", None), ("900.00", 250), ("95.30%", 400)), (("铁", None), ("800.00", 250), ("91.00%", 400)))
    assert read(spark, table, "capacity_table")[1] == {("reported_capacity_utilization", "2024"): (Decimal("95.3"), "%")}


def production(unit_column, unit="万吨", total="合计"):
    head = [("主要产品", None)] + ([("单位", 180)] if unit_column else []) + [("生产量", 250), ("销售量", 350), ("库存量", 450)]
    row = lambda name, *v: [(name, None)] + ([(unit, 180)] if unit_column else []) + [(x, r) for x, r in zip(v, (250, 350, 450), strict=True)]
    return ["(2)产销量情况分析表", *([] if unit_column else [f"单位：{unit}"]), head, row("热轧", "1,200", "1,190", "44"), row("冷轧", "800", "790", "20"), row(total, "2,000", "1,980", "64"), (("合计", None), ("9%", 250))]


def test_production_totals(spark):
    cells = page("new", 5, *production(True)) + page("old", 5, "单位：百万元", *production(False)) + page("none", 5, *production(False)[:1], *production(False)[2:]) + page("money", 5, *production(False, "元")) + page("split", 5, *production(True)[:3]) + page("split", 6, *production(True)[3:])
    df = spark.createDataFrame(cells, CELLS)
    reports = spark.createDataFrame([(f, "2024") for f in ("new", "old", "none", "money", "split")], "file_id string, report_year string")
    got = {(r.file_id, r.label): (r.value, r.unit, r.period, r.page_no) for r in rt.read_tables(df, reports, ("production",)).collect()}
    # on the page behind the title there are two lines above the total, as columns need
    assert got == {(f, q): (v, "万吨", "2024", p) for f, p in (("new", 5), ("old", 5), ("split", 6)) for q, v in (("生产量", 2000), ("销售量", 1980), ("库存量", 64))}


def test_physical_sales(spark):
    table = lambda unit, *more: ["公司实物销售收入是否大于劳务收入", "是", (("行业分类", None), ("项目", 180), ("单位", 230), ("2024年", 330), ("2023年", 430), ("同比增减", 520)), (("钢铁行业", None), ("销售量", 180), (unit, 230), ("2,530.5", 330), ("2,500", 430), ("1.22%", 520)), (("生产量", 180), (unit, 230), ("9", 330), ("8", 430)), *more]
    cells = page("a", 11, *table("万吨")) + page("b", 11, *table("吨")) + page("c", 11, *table("元"))
    reports = spark.createDataFrame([("a", None)], "file_id string, report_year string")
    got = {r.file_id: (r.period, r.t, r.unit) for r in rt.read_tables(spark.createDataFrame(cells, CELLS), reports, ("physical_sales",)).withColumn("t", to_tonnes(F.col("value"), F.col("unit"))).collect()}
    assert got == {"a": ("2024", Decimal("25305000"), "万吨"), "b": ("2024", Decimal("2530.5"), "吨")}


def test_ingest_from_characters_to_facts(spark):
    def report(file, revenue, last, sold):
        rows = [("合并利润表", 200, False)], [("单位：万元", 400, False)], [("项目", 90, False), ("2024年度", 270, False), ("2023年度", 390, False)]
        rows = [*rows, *[[(label, 90, False), (a, 320, True), (b, 440, True)] for label, a, b in (("营业收入", revenue, last), ("营业成本", "700.00", "650.00"), ("净利润", "30.00", "20.00"))]]
        rows += [[("公司实物销售收入是否大于劳务收入", 90, False)], [("项目", 90, False), ("单位", 200, False), ("2024年", 300, True), ("2023年", 420, True)], [("销售量", 90, False), ("万吨", 200, False), (sold, 300, True), ("5", 420, True)]]
        return [(file, *c[1:]) for k, row in enumerate(rows) for c in words(100 + 20 * k, *row)]

    chars = report("r24", "1,000.00", "900.00", "6") + report("r23", "1,001.00", "905.00", "7")
    df = spark.createDataFrame(chars, "file_id string, page_no int, c string, x0 double, x1 double, y0 double, height double")
    reports = spark.createDataFrame([("r24", "p", "c", "2024"), ("r23", "p", "c", "2023")], "file_id string, project_id string, company_id string, report_year string")
    names = spark.createDataFrame([("营业收入", "revenue"), ("净利润", "net_income")], "alias string, metric_key string")
    seen, facts, _ = rt.ingest(df, reports, names)
    got = {(r.metric_key, r.period): (r.value, r.source_file_id) for r in facts.collect()}
    # money in millions; each year's figures come from its own report
    assert got["revenue", "2024"] == (10, "r24") and got["revenue", "2023"] == (Decimal("9.05"), "r23") and got["net_income", "2024"][0] == Decimal("0.3")
    assert got["industry_sales_volume", "2024"] == (60000, "r24") and ("operating_cost", "2024") not in got
    assert {r.resolution for r in seen.collect()} == {"adopted", "rejected"} and seen.select("observation_id").distinct().count() == seen.count()
