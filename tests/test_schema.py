"""The dictionary and rules as data, and the engine against them."""

from steelyard.operators import constraints, derived, extraction
from steelyard.sources import schema


def test_dictionary(spark):
    m = schema.metrics(spark, {"revenue": ["营业收入"], "total_revenue": ["营业总收入"]}, {"revenue": ["营业外收入"]})
    keys = {r.metric_key: r for r in m.collect()}
    assert len(keys) == m.count() == 96
    assert {s.key for s in derived.SPECS} == {k for k, r in keys.items() if r.is_derived}
    assert constraints.dictionary_problems(m).count() == 0
    bad = schema.metrics(spark, {"revenue": ["收入"], "total_revenue": ["收入"]}, {"revenue": ["收入"]})
    assert sorted(r.rule for r in constraints.dictionary_problems(bad).collect()) == ["alias is excluded", "unique"]


def test_engine_uses_the_declared_rules(spark):
    declared = schema.rules(spark).select("key", "value")
    assert extraction.config_difference(schema.engine_parameters(spark), declared).count() == 0


def test_schemas(spark):
    for name in schema.SCHEMAS:
        assert schema.empty(spark, name).count() == 0
