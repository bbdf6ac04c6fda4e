"""Pseudonyms on a cluster without a key, and in texts that the stack of a thread doesn't hold."""

import random
import re

import pytest


@pytest.fixture
def cluster(spark, monkeypatch):
    """A session that says it is on a cluster."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    return spark


def test_queries_draw_a_key_on_a_cluster(cluster, sf, monkeypatch):
    from steelyard.llm.common import table
    from steelyard.llm.pii import DEMO_KEY, KEY_SETTING, op7_pii, pseudonymize, query_key

    with pytest.warns(UserWarning, match="unset"):
        key = query_key(cluster)
        found = {r.doc_id: r.text for r in op7_pii(cluster, sf).collect()}
        assert query_key(cluster) == key and len(key) == 64 and key != DEMO_KEY
    docs = table(cluster, sf, "documents")
    assert found == {r.doc_id: r.text for r in pseudonymize(docs, key=key).collect()}
    assert found != {r.doc_id: r.text for r in pseudonymize(docs, key=DEMO_KEY).collect()}
    with pytest.warns(UserWarning, match="unset"):
        monkeypatch.setattr(type(cluster.sparkContext), "applicationId", "another")
        assert query_key(cluster) not in (key, DEMO_KEY)
    monkeypatch.undo()
    cluster.conf.set(KEY_SETTING, "own")
    try:
        assert query_key(cluster) == "own"
    finally:
        cluster.conf.unset(KEY_SETTING)


def test_a_domain_of_many_labels(spark):
    from steelyard.llm.pii import SHAPES, pseudonymize

    texts = ["a@" + "b." * 20_000 + "de and on", "a@" + "bc.d-." * 20_000 + "e_", "a@b.c.d_", "a@b_", "a@b.c_ x@y.z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.n_replaced, r.text) for r in pseudonymize(df, key="k").collect()}
    new = "[0-9a-f]{12}@[0-9a-f]{8}[.]example"
    assert [out[k][0] for k in range(5)] == [1, 1, 1, 0, 1]
    assert re.fullmatch(f"{new} and on", out[0][1]) and re.fullmatch(rf"{new}\.e_", out[1][1]) and re.fullmatch(rf"{new}\.d_", out[2][1])
    assert out[3][1] == "a@b_" and re.fullmatch(f"a@b.c_ {new}", out[4][1])
    # with and without giving back, the same is found
    was = r"(?<![._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}\-]*+\.[\p{L}\p{N}][\p{L}\p{N}\-]*+)+"
    r = random.Random(7)
    rows = [("".join(r.choice("ab@@..-_1é ") for _ in range(40)),) for _ in range(20_000)]
    both = spark.createDataFrame(rows, "t string").selectExpr(*[rf"regexp_extract_all(t, r'(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])', 0) AS {c}" for p, c in ((was, "was"), (SHAPES["email"], "now"))])
    assert both.where("size(now) > 0").count() > 1000 and both.where("was <> now").count() == 0


def test_the_pipeline_draws_a_key_on_a_cluster(cluster, sf):
    from corpus_pipeline import private
    from steelyard.llm.common import table
    from steelyard.llm.pii import pseudonymize, query_key

    docs = table(cluster, sf, "documents")
    with pytest.warns(UserWarning, match="unset"):
        found = {r.doc_id: r.text for r in private(cluster, docs, sf).collect()}
        assert found == {r.doc_id: r.text for r in pseudonymize(docs, key=query_key(cluster)).collect()}
