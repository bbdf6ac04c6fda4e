"""Reviewers' sheets on their way back: all errors, moved ids, all rows or none."""

from steelyard.operators import attestations as at

Q2 = "project_id string, period string, status string, receivable string, over_one_year string, revenue string, note string, source_page string"
P = "claim_id string, claim_text string, conclusion string, reviewer string"


def errors(df):
    return {r[0]: r.errors for r in df.collect()}


def test_all_errors_of_a_row(spark):
    rows = [
        ("ok", "2024", "validated", "1,000.50", "2", "3", None, "113-114（上年年报）"), ("pages", "2024", "validated", "1", "2", "3", None, "21,27-28"), ("wait", "2024", "pending", None, None, None, None, None),
        ("bad", "2024", "validated", "", "x", "3", None, "about 3"), ("why", "2024", "needs_review", None, None, None, " ", None), ("odd", "2024", "done", None, None, None, None, "x"), ("none", "2024", None, None, None, None, None, None),
    ]
    got = errors(at.checked(spark.createDataFrame(rows, Q2), at.q2_rules()))
    assert got == {"ok": [], "pages": [], "wait": [], "bad": ["receivable is empty (validated)", "over_one_year is no number (validated)", "source_page is no page"], "why": ["note is empty (unavailable_disclosure or needs_review)"], "odd": ["status is not allowed"], "none": ["status is not allowed"]}


def test_risk_sheet(spark):
    rows = [("a", "sufficient", "o", "p", "e", None), ("b", "sufficient", "o", None, " ", None), ("c", "not_applicable", None, None, None, None), ("d", "insufficient", None, None, None, "7")]
    got = errors(at.checked(spark.createDataFrame(rows, "item string, conclusion string, risk_object string, impact_path string, evidence string, source_page string"), at.r_rules()))
    assert got == {"a": [], "b": ["impact_path is empty (sufficient)", "evidence is empty (sufficient)"], "c": ["evidence is empty (not_applicable)"], "d": []}


def test_all_rows_or_none(spark):
    rows = [("a", "2024", "validated", "1", "2", "3", None, None), ("b", "2024", "pending", None, None, None, None, None)]
    key = ["project_id", "period"]
    accepted, refused = at.importable(spark.createDataFrame(rows, Q2), at.q2_rules(), key)
    assert [r.project_id for r in accepted.collect()] == ["a"] and refused.count() == 0 and accepted.columns == [c.split()[0] for c in Q2.split(", ")]
    accepted, refused = at.importable(spark.createDataFrame([*rows, ("c", "2024", "x", None, None, None, None, None)], Q2), at.q2_rules(), key)
    assert accepted.count() == 0 and errors(refused) == {"c": ["status is not allowed"]}
    accepted, refused = at.importable(spark.createDataFrame([*rows, rows[0]], Q2), at.q2_rules(), key)
    assert accepted.count() == 0 and [r.errors for r in refused.collect()] == [["key comes twice"]] * 2


def test_ids_that_moved_are_found_by_text(spark):
    claims = spark.createDataFrame([("n1", "全年产量  同比增长，销量稳步提升，结构优化。"), ("n2", "成本下降，降本增效工作取得明显成效。"), ("n3", "现金流改善"), ("n4", "现金流改善"), ("n5", "公司高端产品占比提升，品种结构持续优化一"), ("n6", "公司高端产品占比提升，品种结构持续优化二")], "claim_id string, claim_text string")
    rows = [
        ("n2", "anything", "p_penalty", "x"), ("o1", "全年产量 同比增长，销量稳步提升，结构优化。", "no_penalty", "x"), ("o2", "成本下降，降本增效工作取得", "p_penalty", "x"), ("o3", "现金流改善", "p_penalty", "x"),
        ("o4", "公司高端产品占比提升，品种结构", "p_penalty", "x"), ("o5", "不存在的主张原文在这里", "pending", None), ("o6", "不存在的另一条主张原文", "p_penalty", "x"), ("o7", "", "pending", None),
    ]
    got = at.rekeyed(spark.createDataFrame(rows, P), claims)
    assert {(r.claim_text[:4], r.claim_id, r.how) for r in got.collect()} == {
        ("anyt", "n2", "same"), ("全年产量", "n1", "exact"), ("成本下降", "n2", "prefix"), ("现金流改", "o3", "ambiguous"), ("公司高端", "o4", "ambiguous"), ("不存在的", "o5", "dropped"), ("不存在的", "o6", "lost"), ("", "o7", "dropped"),
    }
    refused = at.importable(got, at.p_rules(), ["claim_id"])[1]
    assert errors(refused)["o6"] == ["claim is not there"] and errors(refused)["o3"] == ["several claims have its text"] and errors(refused)["n2"] == ["key comes twice"]
    clean = got.where("claim_text IN ('anything', '不存在的主张原文在这里') OR how = 'exact'")
    assert {r.claim_id for r in at.importable(clean, at.p_rules(), ["claim_id"])[0].collect()} == {"n1", "n2"}
