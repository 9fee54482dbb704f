"""From closed log segments to signals and incident timelines: one streaming query gives what the batch operators give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from runlens.config import Config
from runlens.operators import detect, incidents, lines, templates, traces
from runlens.sources import ingest
from runlens.streaming import live, signals


def log_of(seed, events=1500):
    """Lines of one source: rhythms, a burst, an outage, a silence, slow and dear steps, tracebacks, runs with and without keys."""
    rng = random.Random(seed)
    out, t = [], 8 * 3600
    for i in range(events):
        t += rng.choice([0, 0, 1, 1, 2, 4])
        if i in (600, 1100):
            t += 400 + i  # silences
        clock = f"2026-03-04 {t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}"
        kind, key = rng.choice("abbccd"), rng.choice(["", "", f" order_id=ORD-{i // 9}"])
        if i % 600 < 60:
            key = ""  # after the silence nothing is open, so runs are guessed
        if 700 < i < 1000 and kind == "d":
            kind = "a"  # d stops
        if 300 < i < 420 or 1300 < i < 1360:
            kind = "e"
        slow = 50 if rng.random() < 0.02 else 1
        line = {
            "a": f"INFO app.web: request served in {rng.randint(5, 15) * slow}ms{key}",
            "b": f"INFO app.db: query finished took {rng.randint(20, 40) * slow}ms user@mail.example",
            "c": f"INFO app.llm: node=plan total_tokens={rng.randint(50, 90) * slow}{key}",
            "d": f"INFO app.tick: heartbeat {rng.randint(1, 99)} fine",
            "e": f"ERROR app.pay: charge {rng.randint(1, 9999)} refused{key}",
        }[kind]
        if i % 600 in (5, 25):
            line = "INFO app.web: request received"
        elif rng.random() < 0.01:
            line = rng.choice(["INFO app.web: request received", "INFO app.web: response sent", f"WARN app.x: odd word{i} seen"])
        out.append(f"{clock} {line}")
        if kind == "e" and rng.random() < 0.3:
            out += ["Traceback (most recent call last):", f'  File "/srv/app/pay.py", line {rng.randint(1, 9)}, in charge', "ValueError: refused"]
    return out


SENTINEL = "2026-03-04 23:59:59 INFO app.end: last"  # opens an event that stays held, and so releases the one before it


@pytest.fixture(scope="module")
def segments(spark, tmp_path_factory):
    live.stateful_conf(spark)
    folder = tmp_path_factory.mktemp("segments")
    logs = {"shop": log_of(1), "depot": log_of(2, 700)}
    rows = []
    for part in range(3):
        for source, text in logs.items():
            cut = len(text) // 3 + 7
            own = text[part * cut:(part + 1) * cut]
            rows += [(source, (part << 32) + i, x, source) for i, x in enumerate(own)]
            (folder / f"{source}-{part:03d}.log").write_text("\n".join([*own, *([SENTINEL] if part == 2 else [])]) + "\n")
            time.sleep(0.05)
        time.sleep(1.1)
    raw = spark.createDataFrame(rows, "source_id string, line_no long, payload string, service string")
    return str(folder), raw


def streamed(spark, folder, build, name, tmp_path):
    stream = ingest.stream_log_lines(spark, folder, files_per_batch=2)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(600)
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    return spark.table(name)


@pytest.fixture(scope="module")
def batch(segments):
    _, raw = segments
    events = lines.lines_to_events(raw)
    events = templates.assign_templates(events, templates.mine_templates(events))
    return traces.link_traces(detect.stream_clock(events)).cache()


def shape(rows):
    return sorted(
        (r.source_id, r.detector, r.event_no, r.metric, round(r.observed, 6), round(r.baseline, 6), round(r.ratio, 6), r.sustained_s, r.severity, r.service,
         r.template_id, r.trace_id, tuple(r.evidence), r.sec, r.ts)
        for r in rows)


def test_linked_events(spark, segments, batch, tmp_path):
    folder, _ = segments
    got = streamed(spark, folder, live.stream_linked_events, "linked", tmp_path)
    cols = ("source_id", "event_no", "sec", "ts", "service", "level", "text_redacted", "folded_lines", "template_id", "trace_id", "correlation_basis")
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(map(tuple, batch.select(*cols).collect()), key=str)
    novel = {tuple(r) for r in got.where("is_novel").select("source_id", "event_no").collect()}
    assert novel == {tuple(r) for r in templates.first_events(batch).select("source_id", "event_no").collect()}
    assert got.where("trace_id like 'req-%'").count() and got.where("folded_lines > 0").count()


def test_signals_of_all_seven_detectors(spark, segments, batch, tmp_path):
    folder, _ = segments
    got = shape(streamed(spark, folder, live.stream_signals, "hits", tmp_path).collect())
    want = shape(detect.detect_all(batch).collect())
    assert {r[1] for r in want} == {"NoveltyDetector", "SilenceDetector", "RateSpike", "RateDrop", "LatencyShift", "ErrorRatio", "CostAnomaly"}
    assert got == want


def test_incident_timelines(spark, segments, batch, tmp_path):
    folder, _ = segments
    cfg = Config(resolve_quiet_s=120.0)  # so that some come back
    got = streamed(spark, folder, lambda s: live.stream_lines_to_incidents(s, cfg), "told", tmp_path)
    members = incidents.group_incidents(detect.detect_all(batch, cfg), cfg)
    life = incidents.incident_lifecycle(members, batch, cfg)
    cols = ("source_id", "incident_no", "at_s", "kind", "detail", "grouped_by")
    want = sorted(map(tuple, incidents.incident_timeline(members, life, cfg).select(*cols).collect()))
    assert sorted(map(tuple, got.select(*cols).collect())) == want
    assert {r[3] for r in want} == {"signal", "opened", "presented", "resolved", "recurred"}
    # the last status told of an incident is the one the batch finds
    last = {}
    for r in got.collect():
        key = (r.source_id, r.incident_no)
        order = (r.at_s, ("opened", "recurred", "signal", "presented", "resolved").index(r.kind))
        last[key] = max(last.get(key, ((-1, 0), "")), (order, r.status))
    assert {k: v[1] for k, v in last.items()} == {(r.source_id, r.incident_no): r.status for r in life.collect()}


def walk_runs(rows, purpose, p95, quiet=20.0):
    """Every event in order: whoever has been quiet for long enough on the source's clock is judged, once."""
    runs, judged, clock = {}, {}, None
    for _, at, trace, template, level in rows:
        clock = at if clock is None else max(clock, at)
        for name, run in runs.items():
            if name not in judged and len(run) >= 2 and clock - max(x[0] for x in run) >= quiet:
                span = max(x[0] for x in run) - min(x[0] for x in run)
                wrong = any(x[2] == "ERROR" for x in run)
                hollow = not any(x[1] in purpose for x in run)
                judged[name] = ("failed" if wrong else "unknown" if not purpose else "hollow" if hollow else "degraded" if span > 1.5 * p95 else "achieved", len(run))
        if trace is not None and trace not in judged:
            runs.setdefault(trace, []).append((at, template, level))
    return judged


def test_runs_are_judged_once(spark, tmp_path):
    rng = random.Random(4)
    rows, t = {"s": [], "u": []}, 0
    for i in range(400):
        t += rng.choice([0, 1, 2, 5])
        for source in rows:
            trace = rng.choice([f"r{i // 12}", f"r{i // 12}", None, f"r{max(0, i // 12 - 3)}"])  # some come back after a pause
            rows[source].append((i, t, trace, rng.choice("aaab"), "ERROR" if rng.random() < 0.02 else "INFO"))
    flat = [(s, *r) for s, own in rows.items() for r in own]
    df = spark.createDataFrame(flat, "source_id string, event_no long, s long, trace_id string, template_id string, level string").withColumn("ts", F.timestamp_seconds("s"))
    purpose = spark.createDataFrame([("s", "b")], "source_id string, template_id string")
    p95 = spark.createDataFrame([("s", 20.0), ("u", 1.0)], "source_id string, p95_s double")
    live.stateful_conf(spark)
    src = str(tmp_path / "in")
    for k in range(4):
        df.where(F.col("event_no").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.stream_runs(stream, purpose, p95).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = spark.table("runs").collect()
    want = {(s, n): v for s, own in rows.items() for n, v in walk_runs(own, {"b"} if s == "s" else set(), 20.0).items()}
    assert {(r.source_id, r.trace_id): (r.verdict, r.n_events) for r in got} == want
    assert len(got) == len(want)  # one verdict each
    verdicts = {s: {v[0] for (x, _), v in want.items() if x == s} for s in rows}
    assert verdicts["s"] >= {"failed", "hollow", "achieved", "degraded"} and verdicts["u"] == {"failed", "unknown"}


def test_a_run_that_pauses_is_not_judged_again():
    step = live.run_step_of_source()
    at = [0.0, 1.0, 2.0, 27.0, 28.0, 60.0]
    rows = {"at": at, "trace_id": ["r", "r", "x", "r", "r", "x"], "wrong": [0] * 6, "is_purpose": [True] * 6, "p95_s": [None] * 6}
    state, out = step({}, rows)
    assert out["trace_id"] == ["r"] and out["n_events"] == [2]
    assert state["judged"]["r"] == 27


def test_windows_hold_a_count_per_second():
    step = signals.track_step(Config())
    rows = {"event_no": list(range(5000)), "sec": [float(i // 1000) for i in range(5000)], "kind": ["rate"] * 5000, "value": [None] * 5000, "metric": [""] * 5000}
    state, _ = step({}, rows)
    assert state["ring"] == [[float(s), 1000] for s in range(5)]
    ring = signals.Seconds(None, 60, 1)
    for now in range(0, 1000, 3):
        ring.add(float(now), 1)
    assert len(ring.entries) == 21 and ring.sums == [21]
