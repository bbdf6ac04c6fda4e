"""Pages laid out in batches and statements read in one pass, against the same by rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from steelyard.plans import reports
from steelyard.sources import geometry, statements, store
from test_statements import CHARS


def odd_characters():
    r = random.Random(5)
    nan, inf = math.nan, math.inf
    x = lambda: r.choice([None, nan, inf, -inf, -0.0, 0.0, *(r.randrange(60) * 4.0 for _ in range(30))])
    y = lambda: r.choice([None, nan, inf, 20.0, 790.0, *(60.0 + r.randrange(200) / 2 for _ in range(20))])
    c = lambda: r.choice([None, "", " ", "\t", "é", "漢", "1", "😀", "￿", "ab", "，"])
    rows = [("f", p, c(), x(), x(), y(), r.choice([800.0, 800.0, 800.0, None, nan])) for p in range(80) for _ in range(r.choice([0, 1, 5, 80]))]
    tidy = [("g", p, ch, 90.0 + 6 * k, 95.0 + 6 * k, 100.0 + 20 * line, 800.0) for p in range(3) for line in range(4) for k, ch in enumerate("订单 1,2")]
    return [*rows, *rows[:20], *tidy, *tidy[:3], (None, 1, "n", 1.0, 2.0, 100.0, 800.0)]


def text(row):
    return repr(tuple(0.0 if v == 0 else v for v in row))


@pytest.mark.parametrize("skip", [True, False])
def test_pages_in_batches_equal_rows(spark, skip, monkeypatch):
    chars = spark.createDataFrame(odd_characters(), CHARS)
    want = Counter(map(text, geometry.cells(geometry.lines(geometry.body(chars, skip_header_footer=skip))).collect()))
    pages = geometry.packed(chars)
    for part in (geometry.PART, 7):
        monkeypatch.setattr(geometry, "PART", part)
        assert Counter(map(text, geometry.page_cells(pages, skip_header_footer=skip).collect())) == want and len(want) > 100
    more = pages.withColumn("chars", F.when(F.col("page_no") % 2 == 0, F.col("chars"))).unionByName(pages.limit(1).withColumn("chars", F.array().cast(pages.schema["chars"].dataType)))
    assert geometry.page_cells(more, skip_header_footer=skip).where("page_no % 2 = 1").count() == 0
    assert geometry.page_lines(pages.limit(0)).count() == 0


def test_columns_of_an_array_equal_rows(spark):
    r = random.Random(6)
    rows = [(f"f{f}", 1, k, k, r.choice(["1,2", "-", "12", "3456", "(7.5)"] if f % 3 else ["1", "22", "333"]), r.choice([None, 5.0, 6.0]), r.choice([None, math.nan, *(10.0 * v for v in range(12))])) for f in range(40) for k in range(r.randrange(14))]
    cells = spark.createDataFrame(rows, "file_id string, page_no int, line int, cell int, text string, x0 double, x1 double")
    own = cells.groupBy(*geometry.PAGE).agg(geometry.figure_columns(F.collect_list(F.struct("text", "x0", "x1"))).alias("c"))
    want = geometry.columns(cells)
    assert Counter(map(text, own.select(*geometry.PAGE, F.inline("c")).collect())) == Counter(map(text, want.collect())) and want.count() > 30
    assert own.where("c IS NULL").count() == own.join(want, geometry.PAGE, "anti").count() > 0


def test_lines_of_statements_are_shuffled_once(spark, sf, monkeypatch):
    seen = {}
    keep = store.written
    monkeypatch.setattr(store, "written", lambda df, name: keep(seen.setdefault(name, df), name))
    monkeypatch.setattr(reports, "ORDERS", 100)
    pages = reports._reports(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert pages.rdd.getNumPartitions() == orders // 100 + 1  # tasks follow the orders, not the bytes
    years = spark.createDataFrame([], "file_id long, report_year string")
    rows = statements.of_lines(geometry.page_lines(pages), years)[1]
    # the lines are written nowhere before their statements are read, and go through one exchange
    plan = seen["statements"]._jdf.queryExecution().executedPlan().toString()
    assert list(seen) == ["statements"] and plan.count("Exchange hashpartitioning(file_id") + plan.count("Exchange hashpartitioning(o_custkey") <= 3
    assert rows.count() > 0 and rows.where("period_source = 'report_year'").count() == 0
