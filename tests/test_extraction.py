"""Sections, claims, signs, aging and page geometry on made-up reports."""

from decimal import Decimal

from pyspark.sql import functions as F

from steelyard.operators import extraction as ex
from steelyard.sources import geometry, statements


def report(spark):
    pages = {1: ["目录", "第三节管理层讨论与分析", "第四节公司治理"], 2: ["第三节 管理层讨论与分析", "上节余文", "一、经营情况", "全年销量同比增长5%。"], 3: ["二、公司未来发展的展望", "（一）2025年度经营计划", "计划营业成本2,420亿元。", "四、可能面对的风险", "需求承压。"], 4: ["第四节 公司治理", "其他"]}
    rows = [("f", p, n, line) for p, ls in pages.items() for n, line in enumerate(ls)]
    return spark.createDataFrame(rows, "file_id string, page_no int, line_no int, line string")


def test_sections_and_plan_years(spark):
    own = ex.plan_years(ex.subsections(ex.sections(report(spark)))).orderBy("page_no", "line_no").collect()
    assert [r.line for r in own] == ["一、经营情况", "全年销量同比增长5%。", "二、公司未来发展的展望", "（一）2025年度经营计划", "计划营业成本2,420亿元。", "四、可能面对的风险", "需求承压。"]
    assert [r.kind for r in own] == ["business_review"] * 2 + ["outlook"] * 3 + ["business_review"] * 2
    assert [r.plan_year for r in own] == [None, None, None, "2025", "2025", None, None]


def test_headings_of_plans(spark):
    lines = ["3、2018年经营计划", "（二）2021年度经营计划", "2024年经营计划", "二、2024年度生产计划", "（一）2024年预算", "1.2025年公司经营计划"]
    df = spark.createDataFrame([(str(i), 1, 1, x) for i, x in enumerate(lines)], "file_id string, page_no int, line_no int, line string")
    assert {r.line: r.plan_year for r in ex.plan_years(df).collect()} == dict(zip(lines, ["2018", "2021", None, None, None, "2025"], strict=True))


def test_claims(spark):
    rows = [("p", "s", 0, "全年销量同比增长5%。", None), ("p", "s", 1, "计划营业成本2,420亿元。", "2025"), ("p", "s", 2, "国家统计局数据显示，粗钢产量下降。", None), ("p", "s", 3, "天气晴朗宜人。", None), ("p", "s", 4, "力争高端产品占比提高。", None), ("p", "s", 5, "主营业务收入1,200亿元。", "2025"), ("p", "s", 6, "主营业务收入1,200亿元实现。", None)]
    df = spark.createDataFrame([(*r[:4], r[3], "2024", r[4]) for r in rows], "project_id string, section_id string, n int, sentence string, paragraph string, report_period string, plan_year string")
    got = {r.claim_text[:4]: r for r in ex.claims(df, {"revenue": ["营业收入", "主营业务收入"], "operating_cost": ["营业成本"]}).collect()}
    assert len(got) == 4
    a, b, c, d = got["全年销量"], got["计划营业"], got["力争高端"], got["主营业务"]
    assert (a.claim_type, a.primary_metric, a.direction, a.period_norm, a.magnitude_value, a.confidence) == ("demand_sales", "steel_sales_volume", "up", "2024", 5, 0.8)
    # costs are no budget, whatever they stand under; revenue is one under a plan's heading alone
    assert (b.claim_type, b.primary_metric, b.magnitude_value, b.is_plan, b.target_metric_aligned, b.confidence) == ("cost_reduction", "operating_cost", 2420, True, True, 0.6)
    assert (d.claim_type, d.primary_metric, d.period_norm, d.magnitude_value, d.claim_text) == ("management_budget", "revenue", "2025", 1200, "主营业务收入1,200亿元。")
    assert c.primary_metric is None and c.confidence == 0.5
    assert {r.claim_id for r in ex.claims(df).collect()} == {r.claim_id for r in got.values()}


def test_signs(spark):
    row = spark.range(1).select(*[ex.sign_basis(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b) in enumerate([("资产减值损失（损失以“-”号填列）", None), ("减：资产减值损失", ""), ("存货跌价减值准备", ""), ("资产减值损失", "2024"), (None, None)])], ex.normalize_impairment(F.lit("-578764052.76").cast("decimal(20,2)"), F.lit("loss_negative")).alias("v")).first()
    assert tuple(row)[:5] == ("loss_negative", "loss_positive", "not_applicable", "undetermined", "undetermined") and row.v == Decimal("578764052.76")


def test_aging(spark):
    block = lambda f, b, rows: [(f, b, n, label, v) for n, (label, v) in enumerate(rows)]
    good = [("1年以内", "80"), ("1至2年", "15"), ("3年以上", "5"), ("合计", "100"), ("1年以内", "999")]
    rows = block("a", 1, good) + block("a", 2, [("1年以内", "8"), ("合计", "10")]) + block("b", 1, good) + block("b", 2, good) + block("c", 1, [("合计", "-")])
    got = {r.file_id: r for r in ex.aging(spark.createDataFrame(rows, "file_id string, block_id int, line_no int, label string, figure string")).collect()}
    assert (got["a"].gross, got["a"].over_one_year, got["a"].refused) == (100, 20, None) and got["b"].refused == "ambiguous" and got["c"].refused == "no_block"
    pages = spark.createDataFrame([("a", 1, "合并财务报表项目注释"), ("a", 2, "应收账款 账龄 1年以内"), ("a", 3, "母公司财务报表"), ("a", 4, "应收账款按账龄 1年以内")], "file_id string, page_no int, text string")
    assert sorted((r.page_no, r.scope) for r in ex.aging_pages(pages).collect()) == [(2, "consolidated"), (4, "parent")]


def test_aging_out_of_pages(spark):
    head = "应收账款\n账龄 期末余额\n"
    good = "按账龄列示\n1年以内（含1年） 80.00 1.00\n1年以内小计 81.00\n1至2年 15.00\n3年以上 5.00\n合计 100.00"
    rows = [
        ("one", 1, "合并财务报表项目注释"), ("one", 2, head + "1年以内 1.00\n1至2年 1.00\n合计 2.00\n" + good), ("one", 3, "母公司财务报表"), ("one", 4, head + "1年以内 7.00\n1-2年 3.00\n合计 10.00"),
        ("two", 1, "合并财务报表"), ("two", 2, head + "1年以内 1.00\n1至2年 1.00\n合计 2.00\n1年以内 5.00\n1至2年 1.00\n合计 6.00"),
        ("bad", 1, "合并财务报表"), ("bad", 2, head + "1年以内 1.00\n1至2年 1.00\n合计 3.00"), ("bad", 3, head + "1年以内 1.00\n合计 1.00"),
        ("none", 1, "合并财务报表"), ("none", 2, "应收账款"),
    ]
    got = {r.file_id: tuple(r)[1:] for r in ex.aging_of_pages(spark.createDataFrame(rows, "file_id string, page_no int, text string")).collect()}
    assert got == {"one": (2, Decimal(100), Decimal(20), None), "two": (None, None, None, "ambiguous"), "bad": (None, None, None, "no_block")}


def test_candidates_and_rules(spark):
    s = spark.createDataFrame([("f", i, t) for i, t in enumerate(["原料价格风险上升", "汇率风险可控", "价格风险 1 2 3 4 5 6", "价格波动带来风险", "价格风险三"])], "file_id string, n int, sentence string")
    got = ex.risk_candidates(s, {"price": (("价格",), ("风险",)), "fx": (("汇率",), ("风险",))})
    assert sorted((r.item, r.n) for r in got.collect()) == [("fx", 1), ("price", 0), ("price", 3)]
    rules = spark.createDataFrame([("k", "", "0"), ("k", "steel", "1")], "key string, industry string, value string")
    for industry, value in (("steel", True), ("coal", False)):
        assert ex.rule_value(rules, "k", industry).select(ex.rule_boolean(F.col("value"))).first()[0] is value
    diff = ex.config_difference(rules.where("industry = ''").select("key", "value"), rules.where("industry = 'steel'").select("key", "value")).first()
    assert (diff.used, diff.declared) == ("0", "1") and ex.self_check({"r": rules}, {"r": 2, "x": 1}) == {"r": (2, True), "x": (-1, False)}


def words(y, *cells):
    """Characters six points wide; a figure ends at its x, words begin there."""
    out = []
    for text, x, right in cells:
        start = x - 6 * len(text) if right else x
        out += [("f", 1, c, start + 6.0 * k, start + 6.0 * k + 5, float(y), 800.0) for k, c in enumerate(text)]
    return out


def test_page_geometry(spark):
    chars = words(20, ("页眉", 100, False)) + words(100, ("合并利润表", 200, False)) + words(115, ("单位：万元", 400, False)) + words(130, ("项目", 90, False), ("附注", 200, False), ("2024年度", 270, False), ("2023年度", 390, False))
    table = [("营业收入", "1", "1,000.00", "900.00"), ("营业成本", "2", "700.00", "650.00"), ("购建固定资产支付", "3", "(12.50)", "-"), ("净利润", "4", "300.00", "250.00")]
    for k, (label, note, a, b) in enumerate(table):
        y = 150 + 20 * k
        if k == 2:
            chars += words(y - 6.8, (label[:5], 90, False)) + words(y, (note, 220, True), (a, 320, True), (b, 440, True)) + words(y + 6.8, (label[5:], 90, False))
        else:
            chars += words(y + 1.5 * (k % 2), (label, 90, False)) + words(y, (note, 220, True), (a, 320, True), (b, 440, True))
    df = spark.createDataFrame(chars, "file_id string, page_no int, c string, x0 double, x1 double, y0 double, height double")
    assert geometry.body(df).where("c = '页'").count() == 0
    reports = spark.createDataFrame([("f", None)], "file_id string, report_year string")
    read = lambda chars: statements.tables(geometry.cells(geometry.lines(geometry.body(chars))), reports)
    got = read(df)[1].collect()
    found = {(r.label, r.period): r.value for r in got}
    assert found["营业收入", "2024"] == 1000 and found["营业收入", "2023"] == 900 and found["净利润", "2023"] == 250 and {r.unit for r in got} == {"万元"}
    wrapped = [r for r in got if r.value == Decimal("-12.5")]
    assert len(wrapped) == 1 and set(wrapped[0].label) == set("购建固定资产支付") and any(r.is_dash for r in got)
    assert {r.note for r in got} == {"1", "2", "3", "4"} and {r.period_source for r in got} == {"header"}
    found, rows = read(df.where("y0 <> 115"))
    assert rows.count() == 0 and [r.refused for r in found.collect()] == ["no_unit"]
