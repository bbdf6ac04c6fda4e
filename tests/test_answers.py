"""Recorded answers: shape, quarantine, defaults, and the page of each quote."""

import json

from pyspark.sql import functions as F

from steelyard.operators import answers as an


def test_answers_to_located_claims(spark):
    good = {"claims": [
        {"text": "销量 稳步增长", "claim_type": "demand_sales", "metric_key": "revenue", "confidence": 0.7}, {"text": "跨页的一句话在这里", "claim_type": "unheard_of", "metric_key": "made_up", "confidence": "high"},
        {"text": "编造的句子", "claim_type": "demand_sales", "metric_key": "made_up"}, {"text": None}, {"text": "第三页"},
    ]}
    bad = {"s2": "not json", "s3": json.dumps({"claims": "x"}), "s4": json.dumps({"claims": [{"claim_type": "x"}]}), "s5": json.dumps({"claims": ["x"]}), "s6": json.dumps({}), "s7": "[1]", "s8": json.dumps({"claims": []})}
    rows = [("s1", json.dumps(good, ensure_ascii=False)), *bad.items()]
    requests = spark.createDataFrame([(s, "f", 1, 2, f"ask {s}") for s, _ in rows], "section_id string, file_id string, page_from int, page_to int, request string")
    cassettes = spark.createDataFrame([(f"ask {s}", r) for s, r in rows], "request string, response string").select(F.substring(F.sha2("request", 256), 1, 32).alias("key"), "response")
    pages = spark.createDataFrame([("f", 1, "报告期内销量稳步\n增长。跨页的一句"), ("f", 2, "话在这里。"), ("f", 3, "第三页 短"), ("g", 1, "编造的句子")], "file_id string, page_no int, text string")
    claims, quarantine = an.answered_claims(requests, cassettes, pages, spark.createDataFrame([("revenue",)], "metric_key string"))
    assert {r.section_id: r.reason for r in quarantine.collect()} == {"s2": "no object", "s3": "claims is no list", "s4": "a claim without text", "s5": "a claim without text", "s6": "claims is no list", "s7": "no object"}
    got = {r.n: r for r in claims.collect()}
    assert set(got) == {0, 1, 2, 3, 4} and all(r.section_id == "s1" for r in got.values())
    assert (got[0].page_no, got[0].primary_metric, got[0].confidence, got[0].needs_review) == (1, "revenue", 0.7, False)
    assert (got[1].page_no, got[1].claim_type, got[1].primary_metric, got[1].confidence) == (1, "other", None, 0.0)
    assert got[2].page_no is None and got[2].needs_review and got[2].primary_metric == "steel_sales_volume" and got[3].needs_review
    assert got[4].page_no is None  # a page outside the section doesn't count
