"""Declared graphs, cascades, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.operators import agenda, lww
from factloom.plans import cascade, graph
from factloom.plans.registry import Registry
from factloom.sources import frames
from factloom.sources.registry import UnknownSource, conflate, options_for, route
from factloom.streaming import facts as streams


def reading(spark, *values):
    return spark.createDataFrame([(k, 7, "reading", str(v)) for k, v in enumerate(values)], "cause_id long, entity long, component string, value string")


@pytest.mark.parametrize("run", [cascade.unrolled, cascade.to_fixpoint])
def test_chain(spark, run):
    out = run(reading(spark, 42.0, 3.0), queries.alert_rules()).collect()
    assert len(out) == 4  # two rules for each reading
    assert {(r.cause_id, r.component): r.value for r in out} == {(0, "alert"): "true", (0, "notification"): "ALERT: reading exceeded threshold", (1, "alert"): "false", (1, "notification"): "OK: reading normal"}


def test_stock(spark):
    levels = spark.createDataFrame([(1, "level", 30), (2, "level", 10), (3, "level", 80)], "entity long, component string, value long")
    out = cascade.unrolled(levels, queries.stock_rules()).collect()
    assert {(r.entity, r.component) for r in out} == {(1, "low"), (2, "low"), (2, "critical")}


def test_sources_are_told_apart(spark):
    r = Registry()
    r.source("A", {"status": "v long", "seen": "v long"})
    r.source("B", {"status": "v long"})
    r.rule(["A::status"], writes=["A::seen"])(lambda df: df.withColumn("component", F.lit("seen")))
    rows = spark.createDataFrame([("A", 1, "status", 5), ("B", 2, "status", 6)], "source string, entity long, component string, value long")
    for run in (cascade.unrolled, cascade.to_fixpoint):
        assert [(x.source, x.entity, x.component) for x in run(rows, r).collect()] == [("A", 1, "seen")]
    with pytest.raises(ValueError, match="source"):
        cascade.unrolled(rows.drop("source"), r)
    dirty = rows.withColumnRenamed("value", "dirty_id")
    assert [x.dirty_id for x in agenda.agenda(dirty, r.watchers(spark), r.rule_table(spark)).collect()] == [5]
    assert [x.dirty_id for x in agenda.unwatched(dirty, r.watchers(spark)).collect()] == [6]
    r.rule(["B::status"])(lambda df: df)
    with pytest.raises(ValueError, match="source"):
        agenda.agenda(dirty.drop("source"), r.watchers(spark), r.rule_table(spark))


def test_rules_read_what_was_written(spark):
    """A later round sees the writes of the earlier one, and the lower priority's write stays."""
    r = Registry()
    r.source("S", {c: "v string" for c in ("in", "mid", "out")})
    r.rule(["S::in"], priority=9, writes=["S::mid"])(lambda df: df.withColumns({"component": F.lit("mid"), "value": F.lit("first")}))
    r.rule(["S::in"], priority=1, writes=["S::mid"])(lambda df: df.withColumns({"component": F.lit("mid"), "value": F.lit("second")}))

    @r.rule(["S::mid"], writes=["S::out"])
    def last(df, context):
        got = context.get(context.get(df, "S::mid", "mid"), "S::other", "other", "none")
        return got.withColumns({"component": F.lit("out"), "value": F.concat_ws("/", "mid", "other", F.date_format(context.now, "yyyy"))}).drop("mid", "other")

    rows = spark.createDataFrame([(1, "in", "x")], "entity long, component string, value string")
    out = cascade.to_fixpoint(rows, r, now=F.lit("2024-05-01").cast("timestamp"))
    facts = {(x.component): x.value for x in cascade.settled(out).collect()}
    assert facts == {"mid": "second", "out": "second/none/2024"}


def test_atomic_cascades(spark):
    rows = spark.createDataFrame([(1, 1, "reading", "95"), (2, 1, "reading", "50.5"), (3, 1, "reading", "5"), (4, 1, "reading", "60")], "cause_id long, entity long, component string, value string")
    got = cascade.atomic(rows, queries.failing_rules()).collect()
    assert {(x.cause_id, x.kind, x.reason) for x in got if x.kind != "put"} == {(1, "failed", "trap"), (2, "failed", "queue full"), (3, "ack", None), (4, "ack", None)}
    assert {(x.cause_id, x.component, x.status) for x in got if x.kind == "put"} == {(3, "checked", 3), (3, "many", 0), (4, "checked", 0), (4, "many", 0)}
    few = cascade.atomic(rows.where("cause_id = 4"), queries.failing_rules(), max_entries=2).collect()
    assert [(x.kind, x.reason) for x in few] == [("failed", "max depth exceeded")]


def test_rules_come_and_go(spark):
    r = queries.event_rules()
    r.source("Other", {"x": "value double", "y": "n long"})
    named = r.rule(["Other::x"])(lambda df: df)
    assert named and r.watches("<lambda>") == ["Events::view", "Events::click"]
    assert r.of_type("value double")[-1] == "Other::x" and len(r.of_type("n long")) == 1
    gone = r.unload("<lambda>")
    assert gone.rule_id == 0 and [x.rule_id for x in r.rules] == [1, 2, 3, 4]
    r.rule(["Other::y"])(lambda df: df)
    assert r.rules[-1].rule_id == 5 and [x.rule_id for x in r.ranked()][:2] == [1, 2]


def test_cycles_and_depth(spark):
    r = Registry()
    r.source("S", {"a": "v long", "b": "v long"})
    r.rule(["S::a"], writes=["S::b"])(lambda df: df.withColumn("component", F.lit("b")))
    back = r.rule(["S::b"], writes=["S::a"])(lambda df: df.withColumns({"component": F.lit("a"), "value": F.col("value") - 1}).where("value > 0"))
    start = spark.createDataFrame([(1, "a", 3)], "entity long, component string, value long")
    with pytest.raises(ValueError, match="cycle"):
        cascade.unrolled(start, r)
    assert cascade.to_fixpoint(start, r, max_depth=10).count() == 5  # b3 a2 b2 a1 b1
    with pytest.raises(cascade.MaxDepthExceeded):
        cascade.to_fixpoint(start, r, max_depth=3)
    assert back and r.edges() == [("S::a", "S::b"), ("S::b", "S::a")]


def test_long_paths(spark):
    """A chain of 20 nodes and a cycle of 18: both are longer than 16 links."""
    links = spark.createDataFrame([(k, k + 1) for k in range(19)] + [(100 + k, 100 + (k + 1) % 18) for k in range(18)], "src long, dst long")
    want = {(a, b, b - a) for a in range(20) for b in range(a + 1, 20)} | {(100 + a, 100 + b, (b - a - 1) % 18 + 1) for a in range(18) for b in range(18)}
    pairs = graph.reachable(spark, links).collect()
    assert {tuple(r) for r in pairs} == want and len(pairs) == len(want)
    assert {tuple(r) for r in graph.on_cycles(spark, links).collect()} == {(100 + k, 18) for k in range(18)}
    with pytest.raises(graph.MostRoundsExceeded):
        graph.reachable(spark, links, most_rounds=3)


def test_registry(spark):
    r = Registry()
    r.source("orders", {"status": "s string", "total": "t bigint"})
    r.rule(["orders::status"], priority=10)(lambda df: df)
    assert r.component_ids() == {"orders::status": 0, "orders::total": 1}
    assert [tuple(x) for x in r.watchers(spark).collect()] == [(0, "orders", "status", 0)]
    assert r.rule_table(spark).first().priority == 10
    with pytest.raises(KeyError):
        r.rule(["orders::nothing"])(lambda df: df)
    with pytest.raises(ValueError):
        r.rule(["orders::status"], priority=256)
    lenient = Registry(lenient=True)
    lenient.rule(["x::y"])(lambda df: df)
    assert lenient.rules[0].watch == []


def test_sources(spark):
    assert route("/api/x", "n") == "api/x" and route("", "n") == "n"
    with pytest.raises(UnknownSource):
        options_for("carrier-pigeon", {})
    with pytest.raises(ValueError, match="host"):
        options_for("tcp", {"port": "1"})
    rows = spark.createDataFrame([("s", "2024-01-01 00:00:05", 1), ("s", "2024-01-01 00:00:50", 2), ("s", "2024-01-01 00:01:01", 3)], "source string, ts string, seq long").withColumn("ts", F.to_timestamp("ts"))
    assert {r.seq for r in conflate(rows, "ts", ["source"], "seq").collect()} == {2, 3}


def test_frames_to_facts_exactly_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.jsonl").write_text("".join(json.dumps({"route": "/ns/level", "body": json.dumps({"v": k * 10 + j})}) + "\n" for j in range(2)) + json.dumps({"route": "other", "body": "x"}) + "\n" + json.dumps({"route": "/ns/level", "body": ""}) + "\n")
    stream = frames.received(frames.frames(spark, str(folder), ["/ns/level"]))
    failed = []

    def derive(batch):
        if not failed:
            failed.append(1)
            raise RuntimeError("once")
        return batch

    for _ in range(2):
        q = streams.commit_batches(stream, str(tmp_path / "ck"), str(tmp_path / "out"), derive)
        try:
            q.awaitTermination()
        except Exception:  # the failure planted above
            assert failed == [1]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and out.select("frame").distinct().count() == 6


def test_stream_facts(spark, tmp_path):
    ddl = "entity long, component string, value double, wall long, logical long, seq long"
    rows = [(k % 3, "c", float(k), 100 - k if k % 2 else 100 + k, 0, k) for k in range(30)]
    log = spark.createDataFrame(rows, ddl)
    log.repartition(1).write.parquet(str(tmp_path / "log"))
    hlc = F.struct("wall", "logical")
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "log")).withColumn("hlc", hlc)
    q = streams.facts(stream, ["entity", "component"]).writeStream.outputMode("complete").format("memory").queryName("facts_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.entity, r.value) for r in lww.latest(log.withColumn("hlc", hlc), ["entity", "component"]).collect()}
    assert {(r.entity, r.value) for r in spark.table("facts_test").collect()} == want


def test_stream_facts_are_no_driver_table(spark, tmp_path):
    """The result is read from files of the executors, not from rows that the driver holds."""
    ddl = "event_id long, user_id long, event_type string, value double, ts timestamp"
    events = spark.range(60).selectExpr("id AS event_id", "id % 5 AS user_id", "'c' AS event_type", "double(id) AS value", "timestamp_seconds(1700000000 + id * 37 % 60) AS ts")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = queries.stream_lww_equals_batch(spark, str(tmp_path))
    assert got.inputFiles()
    want = queries.lww_latest(spark, str(tmp_path)).collect()
    assert len(want) == 5 and sorted(got.select(*want[0].asDict()).collect()) == sorted(want)
    stream = spark.readStream.schema(f"{ddl}, entity long, seq long, hlc struct<wall: long>").parquet(str(tmp_path / "none*"))
    (tmp_path / "none").mkdir()
    assert streams.facts_at_end(stream, ["entity"], str(tmp_path / "at")).count() == 0


def test_alert_sink(spark):
    def send(key, text):
        if key == "2":
            raise OSError
        return 201

    alerts = spark.createDataFrame([(1, "low"), (2, "low")], "alert_id long, text string")
    assert {r.alert_id: r.status for r in streams.post_alerts(alerts, send).collect()} == {"1": 201, "2": 0}


def test_keyed_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl = "entity long, component string, value double, wall long, logical long, seq long"
    rows = [(k % 3, "c", float(k), [100 - k, 100 + k][k % 2], 0, k) for k in range(30)]
    log = spark.createDataFrame(rows, ddl)
    log.where("seq < 15").coalesce(1).write.parquet(str(tmp_path / "log"))
    log.where("seq >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = streams.accepted_stream(stream).writeStream.format("memory").queryName("keyed_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.entity, r.value, r.wall) for r in spark.table("keyed_test").collect()]
    for entity in range(3):  # what is accepted only rises, and ends at the fact
        walls = [w for e, _, w in got if e == entity]
        best = max(r[3] for r in rows if r[0] == entity)
        assert walls == sorted(set(walls)) and walls[-1] == best
