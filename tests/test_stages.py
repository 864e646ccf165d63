"""Stages that are kept, run again and corrected."""

import pytest
from pyspark.sql import functions as F

from spanwise.operators import stages


def test_only_what_follows_a_change_is_worked_out(spark, tmp_path):
    calls = []

    def kept(rows, least):
        calls.append("kept")
        return rows.filter(F.col("v") >= least)

    def summed(rows):
        calls.append("summed")
        return rows.groupBy("g").agg(F.sum("v").alias("v"))

    def scaled(rows, by):
        calls.append("scaled")
        return rows.withColumn("v", F.col("v") * by)

    store = stages.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 7)], "g string, v long")

    def go(least, by, table=rows, **more):
        calls.clear()
        out, report = stages.run(store, table, [("kept", kept, {"least": least}), ("summed", summed, {}), ("scaled", scaled, {"by": by})], **more)
        assert [d.name for d in report if d.computed] == calls
        return {r.g: r.v for r in out.collect()}, list(calls), report

    assert go(0, 1)[:2] == ({"a": 6, "b": 7}, ["kept", "summed", "scaled"])
    assert go(0, 1)[1] == [] and go(0, 1, rows.orderBy(F.desc("v")).repartition(3))[1] == []  # the rows' order is no change
    assert go(0, 2)[:2] == ({"a": 12, "b": 14}, ["scaled"])
    assert go(2, 2)[:2] == ({"a": 10, "b": 14}, ["kept", "summed", "scaled"])
    assert go(0, 2, again_from="summed")[1] == ["summed", "scaled"]
    assert go(0, 1, rows.union(rows.limit(1)))[1] == ["kept", "summed", "scaled"]  # a repeated row is a change
    _, _, report = go(0, 2)
    assert len(store.prune({d.key for d in report})) > 0 and go(0, 2)[1] == [] and go(2, 2)[1] != []


def test_a_failed_stage_publishes_nothing(spark, tmp_path):
    store = stages.Store(spark, str(tmp_path / "store"))
    rows = spark.range(3)

    def broken(rows):
        return rows.withColumn("x", F.raise_error(F.lit("no")))

    with pytest.raises(Exception):
        stages.run(store, rows, [("first", lambda r: r, {}), ("broken", broken, {})])
    out, report = stages.run(store, rows, [("first", lambda r: r, {}), ("broken", lambda r: r, {})])
    assert [d.computed for d in report] == [False, True] and out.count() == 3
    store.publish(rows.limit(1), report[1].key)  # a second run that comes too late
    assert store.read(report[1].key).count() == 3


def test_last_correction_of_a_cell_counts(spark):
    rows = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, "z", None)], "id long, name string, v double")
    fixes = spark.createDataFrame([(1, "name", "a", 1), (1, "name", "b", 3), (1, "name", "c", 2), (1, "v", None, 1), (2, "v", "7.5", 1), (2, "other", "q", 9), (9, "v", "1", 1)], "id long, column string, value string, at long")
    got = {r.id: (r.name, r.v) for r in stages.corrected(rows, fixes, ["id"], ["name", "v"], ["at"]).collect()}
    assert got == {1: ("b", None), 2: ("y", 7.5), 3: ("z", None)}
    assert stages.corrected(rows, fixes.limit(0), ["id"], ["v"], ["at"]).count() == 3
