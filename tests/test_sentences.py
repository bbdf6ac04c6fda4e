"""Sentences of report text against a plain loop with the same rules."""

import random
import re

from pyspark.sql import functions as F

from steelyard.operators import sentences as st

HEAD = re.compile(r"^\s*(?:[（(]?[一二三四五六七八九十]+[）)、.]|[（(]?\d+[）)、.]|\d+[、.])\s*[^。！？；]{0,40}$")
NUMBER = re.compile(r"^[-−—–\s]*(?:\d[\d,]*(?:\.\d+)?%?)?[-−—–\s]*$")


def column(spark, values, *exprs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")
    return [tuple(r)[1:] for r in df.select("k", *[e(F.col("t")) for e in exprs]).orderBy("k").collect()]


ROWS = [
    "甲产品        12,345    11,111    9.87    -", "本年领用材料  8,765", "其他资产  12  3.4  56  7.8  -9.1  因口径调整所致", "保证金  45.6  用于开立信用证",
    "保证金  321用于开立信用证，余额1.2亿元", "职工人数占比  12.34%  10.98%  增加1.36百分点", "2024年05月06日  电话沟通  个人  http://example.org/记录", "9876543210 54321", "\t4\t5\t6",
]
TEXT = [
    "据统计，2023 年全国产量 9.87 亿吨，同比下降 1.2%。", "本年度完成销售  123,456 件。", "5.  本年计划不是对任何人的承诺", "详见公司在网站（http://example.org）上的公告。", "", "   ", "公司  产品  销量良好", "单位：元",
]


def test_rows_of_tables_by_their_gaps(spark):
    got = column(spark, ROWS + TEXT, st.is_table_row)
    assert [g[0] for g in got] == [True] * len(ROWS) + [False] * len(TEXT)


def test_wrapped_lines_are_joined(spark):
    text = "\n".join([
        "一、经营情况", "需求回升的可", "能性不小，公司", "  12,345.6亿元的目标不变。", "下一句", "", "另起一段", "冷轧  1  2  3", "正文在表后", "数据来源：某资讯", "公司把握机遇", "(一)小标题", "其中：", "收入增长",
    ])
    assert column(spark, [text, "", None, "只有一行"], st.blocks) == [
        (["一、经营情况", "需求回升的可能性不小，公司12,345.6亿元的目标不变。", "下一句", "", "另起一段", "冷轧  1  2  3", "正文在表后", "数据来源：某资讯", "公司把握机遇", "(一)小标题", "其中：", "收入增长"],), ([""],), (None,), (["只有一行"],),
    ]


def plain(pages, shortest=8):
    """The rules as one loop over a file's sections."""
    out, year = [], None
    for section, text in pages:
        joined = []
        for line in (x.rstrip() for x in text.split("\n")):
            bare, last = line.strip(), joined[-1] if joined else None
            begins = not bare or HEAD.match(bare) or re.match(st.CAPTION, bare) or re.search(r"\s{2,}|\t", bare)
            if last is None or begins or not last.strip() or last[-1] in st.STOP or HEAD.match(last) or re.search(st.CAPTION, last) or table(last):
                joined.append(line)
            else:
                joined[-1] += line.lstrip()
        at = n = 0
        for line in joined:
            bare = line.strip()
            if m := re.match(st.PLAN_HEADING, bare):
                year = m[1]
            elif re.match(st.TOP_HEADING, bare):
                year = None
            if bare and not table(bare) and not HEAD.match(bare):
                inside = at
                for piece in re.split(f"(?<=[{st.END}])", bare):
                    if len(piece.strip()) >= shortest:
                        out.append((section, n, piece.strip(), inside, bare, year))
                        n += 1
                    inside += len(piece.strip())
            at += len(line) + 1
    return out


def table(line):
    bare = line.strip()
    cells = [c for c in re.split(r"\s{2,}|\t", bare) if c.strip()]
    number = [bool(NUMBER.match(c)) for c in cells]
    digits = sum(c.isdigit() for c in bare)
    return bool(bare) and any((
        len(cells) >= 3 and sum(number) >= len(cells) - 1,
        len(cells) == 2 and number[1] and bare[-1] not in st.STOP,
        any(all(number[k : k + 3]) for k in range(len(cells) - 2)),
        len(cells) >= 3 and sum(bool(re.match(st.BARE, c.strip())) for c in cells) == 1 and not any(set(c) & set(st.STOP) for c in cells if not re.match(st.BARE, c.strip())),
        len(cells) == 2 and re.match(st.GLUED, cells[1]) and len(cells[0]) <= 14 and not set(cells[0]) & set(st.STOP + "，、（）()") and len(re.findall("[一-鿿]", cells[0])) >= 2 and bare[-1] not in "。！？",
        len(cells) >= 3 and not set(bare) & set(st.END) and digits / len(bare) > 0.18,
        len(cells) >= 3 and not set(bare) & set("。！？") and ("http" in bare or "投资者关系活动记录表" in bare),
        len(bare) >= 8 and digits / len(bare) > 0.5,
    ))


PARTS = [
    "一、经营情况", "3、2018年经营计划", "(二)财务指标", "4、可能面对的风险", "营业收入512.34亿元，同比增长", "1.05%。成本下降明显；利润总额", "982亿元", "", "  全年产量10.1亿吨！", "热轧  12  34  5", "单位：百万元", "注：以上", "12,345.67 890", "公司把握机遇，推进降本增效工作", "应收账款  36.6  质押", "短。", "数据来", "源：某资讯",
]


def test_sentences_equal_one_loop(spark):
    r = random.Random(9)
    files = {f"f{k}": [(f"f{k}-{p}", "\n".join(r.choice(PARTS) for _ in range(r.randint(0, 25)))) for p in range(r.randint(1, 5))] for k in range(90)}
    rows = [(f, s, p, t, "x") for f, pages in files.items() for p, (s, t) in enumerate(pages)]
    got = st.sentences(spark.createDataFrame(rows, "file_id string, section_id string, position int, text string, more string").repartition(5)).collect()
    want = {(f, *row) for f, pages in files.items() for row in plain(pages)}
    assert len(got) == len(want) > 300
    assert {(r.file_id, r.section_id, r.n, r.sentence, r.char_at, r.paragraph, r.plan_year) for r in got} == want
    assert {r.plan_year for r in got} == {None, "2018"} and {r.more for r in got} == {"x"}


def test_from_lines_to_claims(spark):
    pages = {
        1: ["第三节 管理层讨论与分析", "一、经营情况讨论", "报告期内公司产品销量稳", "步增长，同比增长5%。", "热轧  12  34  5"],
        2: ["二、公司未来发展的展望", "（一）2025年度经营计划"],
        3: ["(2)预算", "营业收入512.34亿元，同比增长1.05%。", "四、可能面对的风险", "营业收入可能下降。"],
        4: ["第四节 公司治理", "营业收入100亿元，同比增长1%。"],
    }
    lines = spark.createDataFrame([("f", p, n, x) for p, ls in pages.items() for n, x in enumerate(ls)], "file_id string, page_no int, line_no int, line string")
    reports = spark.createDataFrame([("f", "p", "2024")], "file_id string, project_id string, report_period string")
    got = {r.claim_text: r for r in st.report_claims(lines, reports, {"revenue": ["营业收入"]}).collect()}
    budget = got["营业收入512.34亿元，同比增长1.05%。"]
    # the year stands in a heading of the page before
    assert budget.claim_type == "management_budget" and budget.period_norm == "2025"
    sold = got["报告期内公司产品销量稳步增长，同比增长5%。"]
    assert (sold.claim_type, sold.period_norm, sold.direction) == ("demand_sales", "2024", "up")
    assert not any("100亿元" in t or "热轧" in t for t in got)
    assert {r.claim_type for t, r in got.items() if "可能下降" in t} <= {"demand_sales", "risk"} | {r.claim_type for r in got.values()} - {"management_budget"}


def test_tasks_follow_the_sections(spark, monkeypatch):
    """Files are dealt out once, to tasks of so many sections, and the windows stay there."""
    monkeypatch.setattr(st, "SECTIONS", 4)
    rows = [(k % 3, k, k, f"订单{k}的交付进度良好，公司整体\n经营保持稳定。") for k in range(12)]
    got = st.sentences(spark.createDataFrame(rows, "file_id int, section_id int, position int, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(file_id" in plan and ", 4), REPARTITION_BY_NUM" in plan
    assert {(r.section_id, r.n, r.sentence) for r in got.collect()} == {(k, 0, f"订单{k}的交付进度良好，公司整体经营保持稳定。") for k in range(12)}
