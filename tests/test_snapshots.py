"""Tables that take updates: commits, lost commits, replays, races, versions and compaction."""

import pytest
from pyspark.sql import functions as F

from quire.sources.snapshots import Conflict, SnapshotTable

SCHEMA = "id long, text string, status string"


@pytest.fixture
def held(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", "id", SCHEMA)
    t.insert(spark.createDataFrame([(1, "a", "pending"), (2, "b", "pending"), (None, "c", "pending")], SCHEMA), "first")
    return t


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_updates_and_versions(spark, held):
    assert held.version() == 0 and held.read().columns == ["id", "text", "status"]
    changes = spark.createDataFrame([(1, "approved", 1), (1, "rejected", 2), (9, "approved", 1), (None, "approved", 3)], "id long, status string, at int")
    assert held.update(changes, ["at"], "one") == 1
    assert held.update(spark.createDataFrame([(1, None, 1), (2, "B", 1)], "id long, text string, at int"), ["at"], "two") == 2
    assert rows(held.read()) == [(1, None, "rejected"), (2, "B", "pending"), (None, "c", "pending")]
    assert rows(held.read(1)) == [(1, "a", "rejected"), (2, "b", "pending"), (None, "c", "pending")]
    held.insert(spark.createDataFrame([(9, "late", "pending")], SCHEMA), "three")  # its change came before it and doesn't count
    assert (9, "late", "pending") in rows(held.read())


def test_a_replay_changes_nothing(spark, held):
    changes = spark.createDataFrame([(1, "approved", 1)], "id long, status string, at int")
    assert held.update(changes, ["at"], "x") == held.update(changes.withColumn("status", F.lit("other")), ["at"], "x") == 1
    assert held.version() == 1 and (1, "a", "approved") in rows(held.read())


def test_a_writer_that_dies_before_its_commit_changes_nothing(spark, held, monkeypatch):
    changes = spark.createDataFrame([(1, "approved", 1)], "id long, status string, at int")
    before = rows(held.read())
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            held.update(changes, ["at"], "x")
    assert rows(held.read()) == before and held.version() == 0
    assert held.update(changes, ["at"], "x") == 1 and (1, "a", "approved") in rows(held.read())


def test_of_two_writers_one_takes_a_number(spark, held):
    held.commit(1, "other", "rows", "data/none", [])
    with pytest.raises(Conflict):
        held.commit(1, "mine", "rows", "data/none", [])
    assert held._log().where("version = 1").first()["token"] == "other"


def test_compaction(spark, held):
    held.update(spark.createDataFrame([(1, "approved", 1)], "id long, status string, at int"), ["at"], "x")
    before = rows(held.read())
    assert held.compact() == 2 and rows(held.read()) == before
    held.update(spark.createDataFrame([(2, "rejected", 1)], "id long, status string, at int"), ["at"], "y")
    assert (2, "b", "rejected") in rows(held.read()) and rows(held.read(1)) == before
    assert held.update(spark.createDataFrame([(2, "approved", 1)], "id long, status string, at int"), ["at"], "x") == 1  # tokens outlive it
    assert SnapshotTable(spark, held.path + "-none", "id", SCHEMA).read().count() == 0
