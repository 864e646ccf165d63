import json

import pytest
from pyspark.sql import functions as F

from spanwise.operators import catalogue, checkpoints
from spanwise.plans import QUERIES
from spanwise.sources import documents as docs
from spanwise.streaming import states


def _scene(ident, keys):
    element = {"id": "e1", "kind": "text", "first": 0, "last": 10, "tracks": {"x": [{"t": t, "v": v} for t, v in keys]}}
    return {"id": ident, "w": 200, "h": 100, "fps": 30.0, "frames": 60, "elements": [element], "groups": [], "constraints": [{"pred": "left(a,b)", "keep": True}]}


def test_scene_documents(spark, tmp_path):
    for name, keys in (("good", [(0, 1.0), (5, 2.0)]), ("bad", [(5, 1.0), (0, 2.0)])):
        (tmp_path / f"{name}.json").write_text(json.dumps(_scene(name, keys), indent=1))
    elements = docs.elements(docs.read_scenes(spark, str(tmp_path)))
    assert docs.keys(elements).count() == 4
    assert [(r.scene, r.fault) for r in docs.element_faults(elements).collect()] == [("bad", "key order")]


def test_turn_log_skips_bad_lines(spark, tmp_path):
    log = tmp_path / "turns.json"
    log.write_text('{"schema": "v1", "id": "1", "user": "hi"}\nnot json\n{"schema": "v0", "id": "2"}\n')
    assert [r.id for r in docs.read_turns(spark, str(log), "v1").collect()] == ["1"]


def test_snapshots_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "i int, s string")
    path = str(tmp_path / "snapshots")
    assert docs.write_snapshots(rows, ["i", "s"], path).count() >= 0
    docs.write_snapshots(rows, ["i", "s"], path)
    assert spark.read.parquet(path).count() == 2


def test_versions_and_manifest(spark):
    old = spark.createDataFrame([("p", "s", 0, "v0", None, "a0")], "project string, scene string, ord int, id string, parent string, analysis_file string")
    new = docs.append_version(old, spark.createDataFrame([("p", "s", "v1")], "project string, scene string, id string")).first()
    assert (new.ord, new.parent, new.analysis_file) == (1, "v0", "a0")
    files = spark.createDataFrame([("x", bytearray(b"1")), ("z", bytearray(b"3"))], "path string, content binary")
    manifest = files.filter("path = 'x'").select("path", F.lit("wrong").alias("sha256"), F.lit(1).alias("length")).unionByName(spark.createDataFrame([("y", "s", 1)], "path string, sha256 string, length int"))
    assert {r.path: r.fault for r in docs.verify_manifest(manifest, files).collect()} == {"x": "content", "y": "missing", "z": "extra"}


def test_audit_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "seq long, action string, detail string")
    docs.write_audit_csv(rows, str(tmp_path / "audit"))
    assert spark.read.option("header", True).csv(str(tmp_path / "audit")).count() == 2


def test_catalogue(spark):
    @catalogue.operator
    def same(df):
        return df

    assert catalogue.run("same", spark.range(2)).count() == 2
    assert catalogue.load("spanwise.operators.graph:components").__name__ == "components"


def _stream(spark, tmp_path, batches, schema):
    path = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/*")


def _collect(df, name, mode, tmp_path, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name).collect()


def test_stream_of_jobs(spark, tmp_path):
    states.use_rocksdb(spark)
    events = _stream(spark, tmp_path, [[("a", 1, "start"), ("b", 1, "start")], [("a", 2, "finish"), ("a", 3, "fail")]], "job string, t long, kind string")
    rows = _collect(states.job_states(events, "job", "kind", ["t"], ("start",), ("finish", "fail")), "jobs", "update", tmp_path, spark)
    last = {}
    for r in rows:
        last[r.job] = max(last.get(r.job, (0, "")), (r.events, r.state))
    assert last == {"a": (3, "finish"), "b": (1, "running")}


def test_stream_of_runs(spark, tmp_path):
    states.use_rocksdb(spark)
    values = [0, 10, 20, 20, 20, 20, 30, 40, 40, 40, 40]
    events = _stream(spark, tmp_path, [[("a", i, float(v)) for i, v in enumerate(values)]], "e string, i long, v double")
    rows = _collect(states.motion_runs(events, "e", "i", "v", 5.0), "runs", "append", tmp_path, spark)
    assert sorted((r["first"], r["last"], r.n) for r in rows) == [(1, 2, 2), (6, 7, 2)]


def test_stream_of_silence_and_sessions(spark, tmp_path):
    states.use_rocksdb(spark)
    beats = _stream(spark, tmp_path, [[("a", 1000), ("b", 1000)], [("b", 1050)], [("b", 1400)], [("b", 1420)]], "device string, s long").withColumn("at", F.timestamp_seconds("s"))
    rows = _collect(states.lost_devices(beats, "device", "at", 60, "0 seconds"), "lost", "append", tmp_path, spark)
    lost = {(r.device, int(r.lost_after.timestamp())) for r in rows}
    assert ("a", 1000) in lost and ("b", 1420) not in lost
    (tmp_path / "two").mkdir()
    spans = states.sessions(beats, "device", "at", "60 seconds", "0 seconds")
    rows = _collect(spans, "spans", "append", tmp_path / "two", spark)
    assert ("a", 1) in {(r.device, r.n) for r in rows} and ("b", 2) in {(r.device, r.n) for r in rows}


def test_spread_tables_have_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(checkpoints, "ROWS", 10)
    rows = spark.range(95).withColumn("o", F.col("id") % 40)
    spread = checkpoints.spread(rows, "o")
    assert spread.rdd.getNumPartitions() == 10 and spread.count() == 95
    assert checkpoints.spread(rows.limit(0), "o").rdd.getNumPartitions() == 1
    again = spread.groupBy("o", "id").count().join(spread.groupBy("o").count().withColumnRenamed("count", "n").hint("merge"), "o")
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(o") == 2  # each side's own, none after it


@pytest.mark.parametrize("name", ["foreign_cover", "verified_boxes"])
def test_lines_are_spread_once_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr(checkpoints, "ROWS", 1000)
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
