"""Streams fed in pieces give what the batch operators give on the whole."""

import time

import pytest
from pyspark.sql import functions as F

from runlens.operators import incidents, lines, templates, traces
from runlens.streaming import live


@pytest.fixture(autouse=True)
def rocks(spark):
    live.stateful_conf(spark)


def run(spark, tmp_path, frames, build, name, mode="append"):
    """Write each frame as one file, read them as a stream one file per batch, collect the output."""
    src = str(tmp_path / "in")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name)


def pieces(df, order, cuts):
    bounds = [-1, *cuts, 10**12]
    return [df.where((F.col(order) > a) & (F.col(order) <= b)) for a, b in zip(bounds, bounds[1:])]


def test_folding(spark, lines_of, tmp_path):
    text = "10:00:00 INFO a.b: one\n  File \"x.py\", line 1\nValueError: no\n10:00:01 INFO a.b: two\n10:00:02 INFO a.b: ┌ t\n10:00:02 INFO a.b: │ r\n10:00:03 INFO a.b: last"
    df = lines_of(text)
    src = str(tmp_path / "in")
    for frame in pieces(df, "line_no", [1, 4]):
        frame.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.stream_events(stream, idle_s=8.0).writeStream.format("memory").queryName("t1").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="2 seconds").start()
    want = [tuple(r) for r in lines.fold_continuations(lines.parse_lines(df)).select("event_no", "text", "folded_lines").orderBy("event_no").collect()]
    got, until = [], time.time() + 120
    while len(got) < len(want) and time.time() < until:  # the last event comes by the idle timer
        time.sleep(1)
        got = sorted(tuple(r) for r in spark.table("t1").select("event_no", "text", "folded_lines").collect())
    q.stop()
    assert got == want
    step, on_idle = live.folding_step()
    assert on_idle({"held": {"event_no": 6, "level": "INFO", "ts_text": None, "head": "last", "more": []}})[1]["event_no"] == [6]


def test_linking(spark, tmp_path):
    rows = [("s", i, float(i), x) for i, x in enumerate(["request received", "work", "responded", "lone", "order_id=ORD-1 a", "mine", "order_id=ORD-1 closed", "none"])]
    df = spark.createDataFrame(rows, "source_id string, event_no long, sec double, text_redacted string")
    got = run(spark, tmp_path, pieces(df, "event_no", [0, 4]), live.stream_link, "t3")
    want = traces.link_traces(df)
    assert {(r.event_no, r.correlation_basis) for r in got.collect()} == {(r.event_no, r.correlation_basis) for r in want.collect()}


def test_minutes_runs_and_dedup(spark, tmp_path):
    rows = [("s", i, 6000 + i * 7, "ab"[i % 2], f"r{i // 6}", "ERROR" if i == 3 else "INFO") for i in range(60)] + [("s", 99, 19000, "a", "zz", "INFO")]
    df = spark.createDataFrame(rows, "source_id string, event_no long, s long, template_id string, trace_id string, level string").withColumn("ts", F.timestamp_seconds("s"))
    frames = pieces(df, "event_no", [20, 40, 70])
    got = run(spark, tmp_path / "m", frames, live.stream_template_minutes, "t2")
    want = {(r.template_id, r.minute, r.n_events) for r in templates.template_minutes(df.where("event_no < 99")).collect()}
    assert {(r.template_id, r.minute, r.n_events) for r in got.collect()} == want
    runs = run(spark, tmp_path / "r", frames, lambda s: live.stream_runs(s, ["b"], 10.0), "t5").collect()
    assert {(r.trace_id, r.verdict) for r in runs} == {("r0", "failed")} | {(f"r{k}", "degraded") for k in range(1, 10)}
    polled = df.select(F.col("ts").alias("collected_ts"), F.col("s").cast("string").alias("collected_at"), F.col("template_id").alias("payload"), "event_no")
    once = run(spark, tmp_path / "d", [*pieces(polled, "event_no", [30]), polled.where("event_no < 10")], lambda s: live.stream_dedup(s.drop("event_no")), "t7")
    assert once.count() == polled.select("collected_at", "payload").distinct().count()


def test_detection_and_incidents(spark, tmp_path):
    rows = [("s", i, float(i), "INFO", "t", "web", f"step done in {500 if i in (30, 31, 99) else 10}ms") for i in range(120)]
    df = spark.createDataFrame(rows, "source_id string, event_no long, sec double, level string, template_id string, service string, text_redacted string")
    got = run(spark, tmp_path / "x", pieces(df, "event_no", [25, 60]), live.stream_detect, "t4")
    assert {(r.detector, r.event_no) for r in got.collect()} == {("LatencyShift", 30), ("LatencyShift", 99)}
    sig = spark.createDataFrame([("s", n, sec, "o", "web", tr, tpl, "D", "P2") for n, (sec, tr, tpl) in enumerate([(0, "a", "T1"), (5, "a", "T2"), (4000, "b", "T1"), (4001, "c", "T7")])], "source_id string, signal_no long, sec long, onset string, service string, trace_id string, template_id string, detector string, severity string")
    inc = run(spark, tmp_path / "y", pieces(sig, "signal_no", [0, 2]), live.stream_incidents, "t6").orderBy("signal_no").collect()
    _, want = incidents.grouping_step(live.DEFAULT)({}, {c: [r[c] for r in sig.orderBy("signal_no").collect()] for c in sig.columns if c != "source_id"})
    assert [r.incident_no for r in inc] == want["incident_no"]
