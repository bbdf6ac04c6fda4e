"""Commits of several tables: all or nothing, partitions replaced or emptied, one winner."""

import pytest

from steelyard.sources.catalog import Catalog, Change, Refused, merge_into


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/catalog", {"file": "file_id", "fact": "fact_id"}, {"file": "project_id", "fact": "project_id"}, [("fact", "file_id", "file")], buckets=4)


def files(spark, *rows):
    return spark.createDataFrame(rows, "file_id string, project_id string")


def facts(spark, *rows):
    return spark.createDataFrame(rows, "fact_id string, project_id string, file_id string, value int")


def keys(df):
    return sorted(r[0] for r in df.collect())


def test_partitions_are_replaced_and_emptied_together(spark, catalog):
    v1 = catalog.commit({"file": Change(files(spark, ("f1", "p"), ("f2", "q"))), "fact": Change(facts(spark, ("a", "p", "f1", 1), ("b", "q", "f2", 2), ("c", "q", None, 3)))})
    p = spark.createDataFrame([("p",)], "project_id string")
    v2 = catalog.commit({"fact": Change(facts(spark, ("d", "p", "f1", 9)), p)})
    assert keys(catalog.read("fact")) == ["b", "c", "d"] and keys(catalog.read("fact", v1)) == ["a", "b", "c"]
    # a batch without rows removes its partition
    catalog.commit({"fact": Change(facts(spark, ("x", "r", "f2", 1)).where("false"), spark.createDataFrame([("q",)], "project_id string"))})
    assert keys(catalog.read("fact")) == ["d"] and keys(catalog.read("file")) == ["f1", "f2"] and catalog.version() == v2 + 1


def test_nothing_changes_when_a_commit_fails(spark, catalog, monkeypatch):
    catalog.commit({"file": Change(files(spark, ("f1", "p"))), "fact": Change(facts(spark, ("a", "p", "f1", 1)))})
    before = catalog.manifest()
    more = {"file": Change(files(spark, ("f2", "q"))), "fact": Change(facts(spark, ("b", "q", "f9", 2)))}
    with pytest.raises(Refused, match="without a file"):
        catalog.commit(more)
    with pytest.raises(Refused, match="comes twice"):
        catalog.commit({"fact": Change(facts(spark, ("a", "q", "f1", 2)))})
    with pytest.raises(Refused, match="columns differ"):
        catalog.commit({"file": Change(files(spark, ("f2", "q")).withColumnRenamed("project_id", "other").selectExpr("file_id", "other AS project_id", "1 AS n"))})
    with pytest.raises(Refused, match="without a file"):
        catalog.commit({"file": Change(files(spark, ("f1", "p")).where("false"), spark.createDataFrame([("p",)], "project_id string"))})
    # half-way: the first table is written, the second one is not
    stage = Catalog._stage

    def broken(self, before, after, where, table, change):
        if table == "fact":
            raise OSError("disk full")
        stage(self, before, after, where, table, change)

    monkeypatch.setattr(Catalog, "_stage", broken)
    with pytest.raises(OSError, match="disk full"):
        catalog.commit({"file": Change(files(spark, ("f2", "q"))), "fact": Change(facts(spark, ("b", "q", "f2", 2)))})
    monkeypatch.setattr(Catalog, "_stage", stage)
    assert catalog.manifest() == before and keys(catalog.read("file")) == ["f1"] and keys(catalog.read("fact")) == ["a"]
    assert len(catalog._fs.listStatus(catalog._path("data"))) == 1  # what was written aside is gone


def test_of_two_commits_one_wins(spark, catalog, monkeypatch):
    catalog.commit({"file": Change(files(spark, ("f1", "p")))})
    publish = Catalog._publish

    def late(self, version, manifest):
        monkeypatch.setattr(Catalog, "_publish", publish)
        self.commit({"file": Change(files(spark, ("f3", "q")))})  # another writer is first
        publish(self, version, manifest)

    monkeypatch.setattr(Catalog, "_publish", late)
    with pytest.raises(Refused, match="another commit"):
        catalog.commit({"file": Change(files(spark, ("f2", "q")))})
    assert keys(catalog.read("file")) == ["f1", "f3"]


def test_import_into_empty_tables_alone(spark, catalog):
    new = {"file": files(spark, ("f1", "p")), "fact": facts(spark, ("a", "p", "f1", 1))}
    with pytest.raises(Refused, match="not in the data"):
        merge_into(catalog, {"file": new["file"]}, ["file", "fact"])
    merge_into(catalog, new, ["file", "fact"])
    with pytest.raises(Refused, match="rows already"):
        merge_into(catalog, new, ["file", "fact"])
    assert keys(catalog.read("fact")) == ["a"]


def test_loops_of_any_depth(spark):
    from steelyard.operators.constraints import parent_loops

    rows = [(f"l{k}", f"l{(k + 1) % 50}") for k in range(50)] + [(f"t{k}", f"t{k + 1}" if k < 30 else "l7") for k in range(31)] + [(f"c{k}", f"c{k + 1}" if k < 60 else None) for k in range(61)] + [("self", "self"), ("two", "owt"), ("owt", "two"), ("lost", "nowhere")]
    got = parent_loops(spark.createDataFrame(rows, "metric_key string, parent_key string"))
    assert {r.key for r in got.collect()} == {f"l{k}" for k in range(50)} | {"self", "two", "owt"}
    assert parent_loops(spark.createDataFrame(rows[81:142], "metric_key string, parent_key string")).count() == 0


def test_rounds_follow_the_depth_of_parents(spark, monkeypatch):
    """A thousand loops of two take as few rounds as one."""
    from steelyard.operators import constraints

    seen, written = [], constraints.store.written
    monkeypatch.setattr(constraints.store, "written", lambda df, name: seen.append(name) or written(df, name))
    got = constraints.parent_loops(spark.range(2000).selectExpr("CAST(id AS STRING) AS metric_key", "CAST(id + 1 - 2 * (id % 2) AS STRING) AS parent_key"))
    assert len(seen) <= 7 and got.count() == 2000
