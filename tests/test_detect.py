"""Detectors against a plain event-by-event walk over the same stream."""

import random
import statistics
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from runlens.config import Config
from runlens.operators import detect, gates, incidents
from runlens.plans import catalog
from runlens.streaming import live

SMALL = replace(Config(), segment_rows=40, fold_rows=40)


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(2600):
        calm = i % 900 < 820
        t += rng.choice([0, 0, 1, 2, 3, 5, 9]) if calm else rng.choice([0, 0, 0, 1])
        if i in (400, 1000, 1600, 1900):
            t += {400: 200, 1000: 205, 1600: 400, 1900: 300}[i]
        kind = rng.choice("aaabbc") if calm else "a"
        if 700 < i < 1300 and kind == "b":
            kind = "a"
        level = "ERROR" if rng.random() < (0.05 if calm else 0.7) else "INFO"
        slow = 40 if rng.random() < 0.02 else 1
        text = f"step {kind} done in {rng.randint(5, 15) * slow}ms total_tokens={rng.randint(50, 90) * slow}"
        rows.append(("s", i, t, level, kind, f"r{i % 7}", text))
    df = spark.createDataFrame(rows, "source_id string, event_no long, sec long, level string, template_id string, trace_id string, text_redacted string")
    df = df.withColumns({"ts": F.timestamp_seconds("sec"), "service": F.lit("web")}).repartition(5).cache()
    return df, rows


def found(df):
    return sorted((r.event_no, r.template_id, round(r.observed, 6), round(r.baseline, 6)) for r in df.collect())


@pytest.mark.parametrize("cfg", [Config(), SMALL], ids=["whole", "segmented"])
def test_rate_spike(stream, cfg):
    df, rows = stream
    tracks, want = {}, []
    for _, no, now, _, kind, _, _ in rows:
        tr = tracks.setdefault(kind, {"first": now, "all": [], "since": None, "clear": None, "on": False})
        tr["all"].append(now)
        window = [x for x in tr["all"] if now - x <= 60]
        past = now - tr["first"]
        if past < 300:
            continue
        base = (len(tr["all"]) - len(window)) / max((past - 60) / 60, 1)
        above = len(window) >= 5 and len(window) >= 8 * max(base, 0.1)
        below = len(window) <= 2 * max(base, 0.1)
        if not tr["on"]:
            tr["since"] = (tr["since"] if tr["since"] is not None else now) if above else None
            if above and now - tr["since"] >= 20:
                tr["on"], tr["clear"] = True, None
                want.append((no, kind, float(len(window)), round(base, 6)))
        else:
            tr["clear"] = (tr["clear"] if tr["clear"] is not None else now) if below else None
            if below and now - tr["clear"] >= 60:
                tr["on"], tr["since"] = False, None
    got = detect.detect_rate_spike(df, cfg)
    assert found(got) == sorted(want)
    for r in got.collect():
        last = [x[6] for x in rows if x[4] == r.template_id and x[1] <= r.event_no][-3:]
        assert r.evidence == last


@pytest.mark.parametrize("cfg", [Config(), SMALL], ids=["whole", "segmented"])
def test_silence(stream, cfg):
    df, rows = stream
    gaps, before, longest, want = [], None, 0.0, []
    for _, no, now, _, kind, _, _ in rows:
        if before is not None:
            gap = now - before
            if len(gaps) >= 50:
                usual = statistics.median(gaps[-200:])
                if gap >= max(10 * usual, 120, 1.05 * longest):
                    longest = max(longest, gap)
                    want.append((no, kind, float(gap), round(float(usual), 6)))
            gaps.append(gap)
        before = now
    assert len(want) >= 2
    assert found(detect.detect_silence(df, cfg)) == sorted(want)


def test_a_clock_that_jumps_back_is_no_silence(spark):
    from runlens.operators import lines

    seconds = [68_400 + i for i in range(120)] + [64_800 + i for i in range(60)] + [65_400 + i for i in range(5)]
    df = spark.createDataFrame(
        [("s", i, s, "INFO", "tick", "", "tick") for i, s in enumerate(seconds)],
        "source_id string, event_no long, clock_s long, level string, template_id string, trace_id string, text_redacted string",
    )
    unrolled = lines.unroll_clock(df, "clock_s").withColumn("ts", F.timestamp_seconds("sec")).withColumn("service", F.lit(""))
    got = detect.detect_silence(unrolled).collect()
    assert [(r.event_no, r.observed) for r in got] == [(180, 541.0)]


@pytest.mark.parametrize("cfg", [Config(), SMALL], ids=["whole", "segmented"])
def test_error_ratio(stream, cfg):
    df, rows = stream
    total = errors = 0
    window, gate, want = [], {"on": False, "at": None}, []
    for _, no, now, level, kind, _, _ in rows:
        past, base_errors = total, errors
        total, errors = total + 1, errors + (level == "ERROR")
        window = [w for w in window if now - w[0] <= 60] + [(now, level == "ERROR")]
        if past < 100:
            continue
        share, base = sum(e for _, e in window) / len(window), base_errors / past
        above = len(window) >= 8 and share >= max(0.3, 4 * base)
        below = share <= max(0.05, 1.5 * base)
        hold = below if gate["on"] else above
        gate["at"] = (gate["at"] if gate["at"] is not None else now) if hold else None
        if hold and now - gate["at"] >= (60 if gate["on"] else 20):
            gate.update(on=not gate["on"], at=None)
            if gate["on"]:
                want.append((no, kind, round(share, 6), round(base, 6)))
    assert want
    got = detect.detect_error_ratio(df, cfg)
    assert found(got) == sorted(want)
    for r in got.collect():
        assert r.evidence == [x[6] for x in rows if x[3] == "ERROR" and x[1] <= r.event_no][-12:]


@pytest.mark.parametrize("cfg", [Config(), SMALL], ids=["whole", "segmented"])
def test_rate_drop(stream, cfg):
    df, rows = stream
    tracks, want = {}, []
    for _, no, now, _, kind, _, _ in rows:
        own = tracks.setdefault(kind, {"first": now, "n": 0})
        own.update(last=now, n=own["n"] + 1, dropped=False)
        for other, tr in tracks.items():
            if other == kind or tr["dropped"]:
                continue
            active = (tr["last"] - tr["first"]) / 60
            if tr["n"] < 10 or active < 5 or tr["n"] / active < 0.5:
                continue
            expected = 60 / (tr["n"] / active)
            if now - tr["last"] >= max(5 * expected, 60):
                tr["dropped"] = True
                want.append((no, other, float(now - tr["last"]), round(expected, 6)))
    assert want
    got = detect.detect_rate_drop(df, cfg)
    assert found(got) == sorted(want)
    for r in got.collect():
        other = next(w[1] for w in want if w[0] == r.event_no and round(r.baseline, 6) == w[3])
        assert r.evidence == [x[6] for x in rows if x[4] == other and x[1] < r.event_no][-3:]


@pytest.mark.parametrize("cfg", [Config(), SMALL], ids=["whole", "segmented"])
def test_history_detectors_equal_the_streaming_step(stream, cfg):
    df, _ = stream
    tracks = live.detection_tracks(df)
    walk = {}
    for r in tracks.orderBy("event_no").collect():
        walk.setdefault(r.track, []).append(r)
    want = set()
    for rs in walk.values():
        columns = {c: [getattr(r, c) for r in rs] for c in ("event_no", "sec", "kind", "metric", "value")}
        _, out = live.track_step(cfg)({}, columns)
        want |= {(d, n, m) for d, n, m in zip(out["detector"], out["event_no"], out["metric"])}
    got = set()
    for part in (detect.detect_rate_spike(df, cfg), detect.detect_latency_shift(df, cfg), detect.detect_cost_anomaly(df, cfg)):
        got |= {(r.detector, r.event_no, r.metric) for r in part.collect()}
    assert {d for d, _, _ in want} == {"RateSpike", "LatencyShift", "CostAnomaly"}
    assert got == want


def test_novelty_and_muting(spark, stream):
    df, _ = stream
    extra = spark.createDataFrame([("s", 2700, 99999, "INFO", "new", "r", "x"), ("s", 2701, 99999, "WARN", "warn", "r", "y")], "source_id string, event_no long, sec long, level string, template_id string, trace_id string, text_redacted string").withColumns({"ts": F.timestamp_seconds("sec"), "service": F.lit("web")})
    both = df.unionByName(extra.select(df.columns))
    got = {r.template_id: r.severity for r in detect.detect_novelty(both).collect()}
    assert got["new"] == "P4" and got["warn"] == "P2" and len(got) <= 3
    muted = spark.createDataFrame([("s", "new")], "source_id string, template_id string")
    assert "new" not in {r.template_id for r in detect.detect_novelty(detect.apply_suppressions(both, muted)).collect()}


def test_gate_steps():
    gate = gates.gate_step(20, 60)
    flapping = {"sec": list(range(0, 90, 2)), "above": [i % 2 == 0 for i in range(45)], "below": [i % 2 == 1 for i in range(45)]}
    assert gate({}, flapping)[1]["change"] == []
    held = {"sec": [0, 10, 20, 30, 90, 150], "above": [True] * 3 + [False] * 3, "below": [False] * 3 + [True] * 3}
    assert gate({}, held)[1] == {"sec": [20, 90], "change": ["fire", "clear"]}


def _signals(spark, rows):
    cols = "sec long, detector string, template_id string, trace_id string, service string, severity string"
    df = spark.createDataFrame(rows, cols)
    return df.withColumns({
        "source_id": F.lit("s"), "event_no": F.col("sec"), "ts": F.timestamp_seconds("sec"), "metric": F.lit("m"),
        "observed": F.lit(1.0), "baseline": F.lit(1.0), "evidence": F.array(F.concat(F.lit("line "), F.col("template_id"))),
    })


def test_incidents_group_on_two_facts(spark):
    same_trace = [(i, "D", f"T{i}", "tr1", "web", "P2") for i in range(5)]
    got = incidents.group_incidents(_signals(spark, same_trace)).collect()
    assert {r.incident_no for r in got} == {1}
    same_service = [(0, "D", "T1", None, "web", "P2"), (50, "E", "T2", None, "web", "P2")]
    assert incidents.group_incidents(_signals(spark, same_service)).select("incident_no").distinct().count() == 2
    again = [(0, "D", "T1", "a", "web", "P2"), (7200, "D", "T1", "b", "web", "P2"), (9000, "N", "T9", None, "web", "P4")]
    got = incidents.group_incidents(_signals(spark, again)).orderBy("sec").collect()
    assert [(r.incident_no, r.recurred) for r in got] == [(1, False), (1, True), (None, False)]
    clock = _signals(spark, [(9100, "x", "x", "x", "x", "P2")])
    life = incidents.incident_lifecycle(incidents.group_incidents(_signals(spark, again)), clock).first()
    assert (life.status, life.n_signals, life.resolved_s) == ("resolved", 2, 7500)


def test_incidents_do_not_depend_on_segments(spark):
    rng = random.Random(6)
    t, rows = 0, []
    for _ in range(300):
        t += rng.choice([0, 1, 20, 80, 200, 700])
        rows.append((t, rng.choice("DEN"), f"T{rng.randint(0, 25)}", rng.choice([None, "a", "b", "c"]), rng.choice(["web", "db"]), rng.choice(["P2", "P3", "P4"])))
    cols = ("signal_no", "incident_no", "rules", "opened", "recurred")
    a = incidents.group_incidents(_signals(spark, rows)).select(*cols)
    b = incidents.group_incidents(_signals(spark, rows), SMALL).select(*cols)
    assert a.exceptAll(b).count() == 0 and a.count() == 300


def _walked(rows, cfg):
    """Incident and rules of every signal, each compared with all incidents there are."""
    known, out = [], []
    for now, detector, template, trace, service, severity in rows:
        best, best_rules = None, []
        for i in known:
            rules = [name for name, holds in (
                ("trace", trace and trace in i["trace"]), ("adjacency", service and service in i["service"]),
                ("temporal", now - i["last"] <= cfg.temporal_s), ("coincident", i["last"] == now and cfg.coincident_s >= 0)) if holds]
            again = template in i["template"] and detector in i["detector"]
            rules += ["recurrence", "recurrence-confirmed"] if again else []
            telling = again or set(rules) & {"trace", "coincident"} or "adjacency" not in rules or len(i["service"]) > 1
            if (again or now - i["last"] < cfg.resolve_quiet_s) and len(rules) >= 2 and telling and len(rules) > len(best_rules):
                best, best_rules = i, rules
        if best is None and severity != "P4":
            best, best_rules = {"no": len(known) + 1, "last": now, "trace": set(), "service": set(), "template": set(), "detector": set()}, ["first"]
            known.append(best)
        out.append((best and best["no"], " ".join(best_rules)))
        if best is not None:
            best["last"] = now
            for field, value in (("trace", trace), ("service", service), ("template", template), ("detector", detector)):
                if value or field == "service":
                    best[field].add(value)
    return out


def _stepped(rows, cfg, parts=1):
    names = ("sec", "detector", "template_id", "trace_id", "service", "severity")
    step, state, out = incidents.grouping_step(cfg), {}, []
    size = -(-len(rows) // parts)
    for at in range(0, len(rows), size):
        part = dict(zip(names, map(list, zip(*rows[at:at + size]))))
        part |= {"signal_no": part["sec"], "onset": [str(s) for s in part["sec"]]}
        state, got = step(state, part)
        out += zip(got["incident_no"], got["rules"])
    return out


@pytest.mark.parametrize("quiet", [300.0, 60.0])
def test_quiet_incidents_that_others_stand_for(quiet):
    rng, cfg = random.Random(7), replace(Config(), resolve_quiet_s=quiet)
    t, rows = 0, []
    for _ in range(3_000):
        t += rng.choice([0, 1, 20, 80, 200, 700])
        rows.append((t, rng.choice("DENX"), f"T{rng.randint(0, 40)}", rng.choice([None, None, *"abcdef"]), rng.choice([None, "web", "db", "api", "job"]), rng.choice(["P2", "P3", "P4"])))
    want = _walked(rows, cfg)
    assert len({no for no, _ in want}) > 20 and _stepped(rows, cfg) == want == _stepped(rows, cfg, 5)


def test_quiet_incidents_of_one_template_are_not_walked_through():
    rows = [(1_000 * i, f"D{i}", "T", None, "web", "P2") for i in range(8_000)]
    began = time.process_time()
    got = _stepped(rows, Config())
    assert [no for no, _ in got] == list(range(1, 8_001)) and time.process_time() - began < 5  # 32 million comparisons


def test_windows_left_empty_by_disorder_have_no_share(spark):
    rows = [("s", i, 10_000, "INFO") for i in range(400)] + [("s", 400 + i, i, "ERROR") for i in range(300)]
    df = spark.createDataFrame(rows, "source_id string, event_no long, sec long, level string")
    got = {r.event_no: (r.observed, r.above) for r in detect.error_conditions(df).collect()}
    assert got[299] == (None, False) and got[300][0] is not None


def test_the_cause_says_where_the_flow_runs(spark):
    rows = [(0, "D", "T1", "tr1", "web", "P2"), (5, "E", "T2", "tr1", "db", "P2"), (9, "E", "T2", "tr1", "db", "P2"), (5000, "D", "T8", "x", "web", "P2")]
    members = incidents.group_incidents(_signals(spark, rows))
    assert {r.incident_no for r in members.collect()} == {1, 2}
    lines = F.when(F.col("sec") == 5, F.array(F.lit("[cache] miss"))).when(F.col("sec") == 9, F.array(F.lit(""))).otherwise(F.array(F.lit("plain words")))
    members = members.withColumn("evidence", lines)
    ranks = spark.createDataFrame([("s", "web", 0.1), ("s", "cache", 0.0), ("s", "queue", 0.9)], "source_id string, component string, rank double")
    why = {r.incident_no: r.cause_why for r in incidents.rank_cause(members, ranks).collect()}
    assert why == {1: "earliest onset of 3 member(s); 3 member(s) share its trace tr1; flow context: cache → web", 2: "earliest onset of 1 member(s)"}
    alone = {r.cause_why for r in incidents.rank_cause(members, ranks.limit(1)).collect()}
    assert all(w.endswith("no flow graph yet - ranked by timing alone") for w in alone)


def test_timelines_tell_every_resolution_and_what_stays_open(spark):
    rows = [(0, "D", "T1", "a", "web", "P2"), (7200, "D", "T1", "b", "web", "P2"), (9000, "D", "T1", "c", "web", "P2")]
    members = incidents.group_incidents(_signals(spark, rows))
    clock = _signals(spark, [(9100, "x", "x", "x", "x", "P2")])
    life = incidents.incident_lifecycle(members, clock)
    told = [(r.at_s, r.kind) for r in incidents.incident_timeline(members, life, ended=True).orderBy("at_s", "kind").collect() if r.kind != "signal"]
    assert told == [(0, "opened"), (45, "presented"), (300, "resolved"), (7200, "recurred"), (7500, "resolved"), (9000, "note"), (9000, "recurred")]


def test_trailing_sums_equal_brute_force_without_a_sliding_frame(spark):
    rng = random.Random(3)
    cfg = replace(Config(), window_s=50_000)
    rows = [(s, t, rng.randint(1, 4), rng.choice([None, 0, 1])) for s in ("a", None) for t in sorted(rng.sample(range(300_000), 400))]
    rows += [("b", t, 1, 1) for t in (86_399, 86_400, 136_399, 136_400, 136_401)]  # window and chunk ends
    df = spark.createDataFrame(rows, "key string, sec long, n long, e long")
    got = detect._trailing(df, ["key"], cfg, {"w_n": F.col("n"), "w_e": F.col("e")})
    want = [(s, t, n, e, sum(r[2] for r in rows if r[0] == s and t - 50_000 <= r[1] < t), sum(r[3] or 0 for r in rows if r[0] == s and t - 50_000 <= r[1] < t)) for s, t, n, e in rows]
    order = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    # a frame that slides adds up its whole window for each row: quadratic in the rows of a window
    assert "rangeframe" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_timeline_query_tells_every_entry_of_every_incident(spark, monkeypatch):
    rows = [(0, "D", "T1", "a", "web", "P2"), (20, "E", "T2", "a", "db", "P3"), (90_000, "D", "T1", "b", "web", "P2")]
    members = incidents.group_incidents(_signals(spark, rows).withColumn("observed", F.col("sec") + 0.5), catalog.HOURS)
    monkeypatch.setattr(catalog, "_members", lambda *_: (members, _signals(spark, [(90_100, "x", "x", "x", "x", "P2")])))
    told = catalog.CATALOG["incident_timeline"](spark, "").orderBy("at_s", "kind", "detail").collect()
    assert {(r.source_id, r.incident_no) for r in told} == {("s", 1)}
    assert [(r.at_s, r.kind, r.detail, r.grouped_by, r.observed, r.baseline) for r in told] == [
        (0, "opened", "opened by D (P2)", "", None, None), (0, "signal", "D m", "first", 0.5, 1.0), (20, "signal", "E m", "trace temporal", 20.5, 1.0),
        (900, "presented", incidents.PRESENTED, "", None, None), (7220, "resolved", incidents.RESOLVED, "", None, None),
        (90_000, "note", incidents.STILL_OPEN, "", None, None), (90_000, "recurred", incidents.RECURRED, "", None, None),
        (90_000, "signal", "D m", "adjacency recurrence recurrence-confirmed", 90_000.5, 1.0)]
