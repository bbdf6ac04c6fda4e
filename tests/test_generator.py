"""Made-up statements fulfil the identities, and planted faults are all that is found."""

from pyspark.sql import functions as F

from steelyard.operators import checks
from steelyard.sources import generator


def test_a_hundred_thousand_companies_add_up(spark):
    rows = generator.statements(spark.range(100_000).withColumnRenamed("id", "company"), "company", 2024)
    found = checks.run_checks(rows, ["company", "period"], tolerance=1e-4).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in found} == {"passed": 100_000 * 10 * 4}


def test_years_hang_together_and_come_again(spark):
    companies = spark.createDataFrame([("a",), ("b",), (None,)], "company string")
    rows = generator.statements(companies, "company", 2024).collect()
    by = {(r.company, int(r.period)): r for r in rows}
    assert len(rows) == 20 and all(by[c, y].cash_begin == by[c, y - 1].cash_end for c in "ab" for y in range(2016, 2025))
    assert all(r.equity_parent + r.minority_interest + r.total_liabilities == r.total_assets and r.cfo + r.cfi + r.cff == r.cash_net_increase for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, generator.statements(companies.repartition(3), "company", 2024).collect()))
    other = generator.statements(companies, "company", 2024, key="other").collect()
    assert not {r.revenue for r in rows} & {r.revenue for r in other}


def test_planted_faults_are_found(spark):
    rules = list(generator.FAULTS)
    fault = F.when(F.col("company") % 10 == F.col("year") % 10, F.element_at(F.array(*map(F.lit, rules)), (F.col("company") % 4 + 1).cast("int")))
    rows = generator.statements(spark.range(400).withColumnRenamed("id", "company"), "company", 2024, fault=fault)
    found = checks.run_checks(rows, ["company", "period"]).where("status = 'failed'").collect()
    assert {(r.company, int(r.period), r.rule_key) for r in found} == {(c, y, rules[c % 4]) for c in range(400) for y in range(2015, 2025) if c % 10 == y % 10}


def test_much_work_on_few_bytes_is_spread(spark):
    """Companies of one small file are one partition; their rows aren't."""
    companies = spark.range(25_000).withColumnRenamed("id", "company").coalesce(1)
    assert generator.statements(companies, "company", 2024).rdd.getNumPartitions() == 3
