"""T4: all seven detectors on a stream, as step functions over narrow rows.

Two kinds of keys. A *track* is one template (rate), one operation (duration) or one unit of work (cost). The *source* track
follows what only the order of a whole source can tell: first occurrences, silence, the share of errors, templates that stopped; its rows
are narrow and its state is bounded: counts of 61 seconds, 200 gaps, 12 evidence lines, and per template of the source five
numbers and three examples. Rate windows are counts per second as well, so a burst does not grow the state. Absence needs
no wall clock: every template carries the second at which it is overdue, and the next event of the source past it speaks.

Results equal ``operators.detect`` on the same events in order. ``sec`` is whole seconds that never go back (T1).
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, measure
from ..operators import gates

Rows = dict[str, list]
SOURCE_TRACK = "s"
#: what a hit says beside the event it belongs to
SAID = ("detector", "metric", "observed", "baseline", "ratio", "sustained_s", "severity", "template_id", "evidence")


class Seconds:
    """Counts per second of the trailing window: at most ``window_s + 1`` entries however many events."""

    def __init__(self, entries: list[list] | None, window_s: int, width: int) -> None:
        self.entries, self.window_s = entries if entries is not None else [], window_s
        self.sums = [sum(e[1 + i] for e in self.entries) for i in range(width)]

    def add(self, now: float, *counts: int) -> list[int]:
        """Adds to the present second and returns the sums of the window that ends with it."""
        if self.entries and self.entries[-1][0] == now:
            last = self.entries[-1]
            last[1:] = [a + b for a, b in zip(last[1:], counts, strict=True)]
        else:
            self.entries.append([now, *counts])
        self.sums = [a + b for a, b in zip(self.sums, counts, strict=True)]
        while self.entries[0][0] < now - self.window_s:
            gone = self.entries.pop(0)
            self.sums = [a - b for a, b in zip(self.sums, gone[1:], strict=True)]
        return self.sums


def track_step(cfg: Config = DEFAULT):
    """D2, D5 and D7 for one track, event by event."""
    gate = gates.gate_step(cfg.sustain_s, cfg.clear_sustain_s)

    def rate(state: dict, now: float, line: str | None) -> dict | None:
        born, total = state.get("born", now), state.get("total", 0) + 1
        ring = Seconds(state.get("ring"), cfg.window_s, 1)
        (within,) = ring.add(now, 1)
        shown = [*state.get("shown", []), line][-3:]
        state.update(born=born, total=total, ring=ring.entries, shown=shown)
        age = now - born
        if age < cfg.min_history_s:
            return None
        minutes_before = max((age - cfg.window_s) / cfg.window_s, 1.0)
        usual = (total - within) / minutes_before
        floor = max(usual, cfg.rate_floor_per_min)
        condition = {"sec": [now], "above": [within >= max(cfg.rate_min_events, floor * cfg.rate_spike_ratio)], "below": [within <= floor * cfg.rate_clear_ratio]}
        state["gate"], moved = gate(state.get("gate", {}), condition)
        if moved["change"] != ["fire"]:
            return None
        return {"detector": "RateSpike", "observed": float(within), "baseline": usual, "ratio": within / floor, "sustained_s": cfg.sustain_s, "severity": "P2", "evidence": shown}

    def against_history(past: dict, now: float, value: float, least: int, factor: float, upper: bool) -> tuple[float, float, float] | None:
        """The value against the median of the kept values before it; the value is kept afterwards."""
        arrived, ordered = past.setdefault("arrived", []), past.setdefault("ordered", [])
        n, hit = len(ordered), None
        if n >= least:
            usual = ordered[n // 2] if upper or n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2
            if usual > 0 and value >= usual * factor:
                hit = (value, usual, value / usual)
        arrived.append(value)
        insort(ordered, value)
        if len(arrived) > cfg.max_samples:
            del ordered[bisect_left(ordered, arrived.pop(0))]
        return hit

    def cooled(state: dict, now: float, hit: tuple | None, pause: float) -> tuple | None:
        if hit is None or (state.get("fired") is not None and now - state["fired"] < pause):
            return None
        state["fired"] = now
        return hit

    def step(state: dict, rows: Rows) -> tuple[dict, Rows]:
        out: Rows = {c: [] for c in ("at", "event_no", "sec", *SAID)}
        size = len(rows["event_no"])
        service, ev = rows.get("service", [None] * size), rows.get("line", [None] * size)
        for i, now in enumerate(rows["sec"]):
            kind, value = rows["kind"][i], rows["value"][i]
            if kind == "rate":
                said = rate(state, now, ev[i])
            else:
                priced = kind == "cost"
                # an operation has a history in each service, and one pause for all of them
                past = state.setdefault("past", {}).setdefault("" if priced else service[i] or "", {})
                least, factor = (cfg.cost_min_samples, cfg.cost_ratio) if priced else (cfg.min_samples, cfg.spike_ratio)
                hit = against_history(past, now, value, least, factor, priced)
                hit = cooled(state, now, hit, cfg.cost_cooldown_s if priced else cfg.latency_cooldown_s)
                said = hit and {"detector": "CostAnomaly" if priced else "LatencyShift", "observed": hit[0], "baseline": hit[1], "ratio": hit[2], "severity": "P3"}
            if said:
                _say(out, i, rows, {"metric": rows["metric"][i], **said})
        return state, out

    return step


def _say(out: Rows, i: int, rows: Rows, said: dict) -> None:
    out["at"].append(i)
    out["event_no"].append(rows["event_no"][i])
    out["sec"].append(rows["sec"][i])
    for name in SAID:
        default = 0.0 if name == "sustained_s" else rows["template_id"][i] if name == "template_id" and "template_id" in rows else None
        out[name].append(said.get(name, default))


def source_step(cfg: Config = DEFAULT, muted: frozenset[str] = frozenset()):
    """D1, D3, D4 and D6 over all events of one source; templates in ``muted`` only show that it lives."""
    gate = gates.gate_step(cfg.sustain_s, cfg.clear_sustain_s)

    def overdue_at(track: list) -> float | None:
        """Second from which a template that has a rhythm is missing."""
        first, last, total, _ = track
        minutes = (last - first) / 60.0
        if total < cfg.drop_min_events or minutes < cfg.drop_min_active_min or total / minutes < cfg.drop_min_rate:
            return None
        return math.ceil(last + max(cfg.drop_factor * 60.0 / (total / minutes), cfg.drop_min_gap_s))

    def stopped(state: dict, now: float, own: str) -> list[dict]:
        if state.get("next_due") is None or now < state["next_due"]:
            return []
        said, due = [], state["due"]
        for name in sorted(n for n, at in due.items() if at <= now and n != own):
            first, last, total, shown = state["tracks"][name]
            usual = 60.0 / (total / ((last - first) / 60.0))
            said.append({"detector": "RateDrop", "metric": "silence_gap_s", "observed": float(now - last), "baseline": usual, "ratio": (now - last) / usual,
                         "severity": "P3", "template_id": name, "evidence": list(shown)})
            del due[name]  # once, until it is back
        state["next_due"] = min(due.values(), default=None)
        return said

    def seen(state: dict, now: float, own: str, line: str | None) -> None:
        track = state.setdefault("tracks", {}).setdefault(own, [now, now, 0, []])
        track[1], track[2], track[3] = now, track[2] + 1, [*track[3], line][-3:]
        due, at = state.setdefault("due", {}), overdue_at(track)
        due.pop(own, None)
        if at is not None:
            due[own] = at
            state["next_due"] = at if state.get("next_due") is None else min(at, state["next_due"])

    def quiet(state: dict, now: float) -> dict | None:
        before = state.get("last")
        if before is None:
            return None
        gap, gaps, said = float(now - before), state.setdefault("gaps", []), None
        if len(gaps) >= cfg.silence_min_gaps and gap >= cfg.silence_min_s:
            ordered = sorted(gaps)
            n = len(ordered)
            usual = float(ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2)
            if gap >= usual * cfg.silence_factor and gap >= state.get("longest", 0.0) * cfg.silence_record:
                state["longest"] = max(gap, state.get("longest", 0.0))
                said = {"detector": "SilenceDetector", "metric": "silence_gap_s", "observed": gap, "baseline": usual, "ratio": gap / max(usual, 0.01), "severity": "P3"}
        gaps.append(gap)
        del gaps[:-cfg.silence_gaps]
        return said

    def errors(state: dict, ring: Seconds, now: float, wrong: bool, evidence: list[str]) -> dict | None:
        events, failed = state.get("events", 0), state.get("failed", 0)
        state["events"], state["failed"] = events + 1, failed + wrong
        if wrong:
            state["wrong"] = [*state.get("wrong", []), *evidence][-12:]
        within, bad = ring.add(now, 1, int(wrong))
        if events < cfg.error_min_history:
            return None
        share, usual = bad / within, failed / max(events, 1)
        condition = {"sec": [now], "above": [within >= cfg.error_min_window and share >= max(cfg.error_floor, usual * cfg.error_ratio)],
                     "below": [share <= max(cfg.error_clear_floor, usual * cfg.error_clear_ratio)]}
        state["gate"], moved = gate(state.get("gate", {}), condition)
        if moved["change"] != ["fire"]:
            return None
        return {"detector": "ErrorRatio", "metric": "error_share", "observed": share, "baseline": usual, "ratio": share / max(usual, 0.001),
                "sustained_s": cfg.sustain_s, "severity": "P2", "evidence": list(state.get("wrong", []))}

    def first(state: dict, known: set, own: str, level: str | None) -> dict | None:
        state["heard"] = state.get("heard", 0) + 1
        if own in known:
            return None
        known.add(own)
        loud = level in ("ERROR", "WARN", "WARNING", "CRITICAL")
        if not loud and state["heard"] <= cfg.novelty_warmup_events:
            return None
        return {"detector": "NoveltyDetector", "metric": "first_occurrence", "observed": 1.0, "baseline": 0.0, "ratio": 0.0, "severity": "P2" if loud else "P4"}

    def step(state: dict, rows: Rows) -> tuple[dict, Rows]:
        out: Rows = {c: [] for c in ("at", "event_no", "sec", *SAID)}
        ring, known = Seconds(state.get("ring"), cfg.window_s, 2), set(state.get("known", []))
        for i, now in enumerate(rows["sec"]):
            own, evidence = rows["template_id"][i], list(rows["evidence"][i] if rows["evidence"][i] is not None else [])
            if own in muted:
                state["last"] = now if now is not None else state.get("last")
                continue
            said = [first(state, known, own, rows["level"][i])]
            if now is not None:
                said.append(quiet(state, now))
                seen(state, now, own, rows["line"][i])
                said += stopped(state, now, own)
                said.append(errors(state, ring, now, rows["wrong"][i], evidence))
                state["last"] = now
            for hit in said:
                if hit:
                    _say(out, i, rows, hit)
        state.update(ring=ring.entries, known=sorted(known))
        return state, out

    return step


def detection_tracks(events: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per event and track it belongs to (``more``: further columns of the event)."""
    head = classify.head_line(F.col("text_redacted"))
    cost = measure.extract_cost(head)
    base = events.withColumns({"__m": measure.measurement(head), "__c": cost}).withColumns({
        "__d": F.col("__m.value_ms"), "__o": measure.operation_name(head, F.col("__m.text")),
    })

    def track(kind: str, name: Column, metric: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("track"), metric.alias("metric"), value.alias("value"))

    none = F.lit(None).cast("double")
    tracks = F.array_compact(F.array(
        track("rate", F.concat(F.lit("t:"), F.col("template_id")), F.lit("events_per_min"), none),
        F.when(F.col("__d").isNotNull(), track("duration", F.concat(F.lit("d:"), F.col("__o")), F.concat("__o", F.lit(" ms")), F.col("__d"))),
        F.when(F.col("__c").isNotNull(), track("cost", F.concat(F.lit("c:"), F.col("__c.label")), F.concat("__c.label", F.lit(" tokens")), F.col("__c.amount"))),
    ))
    rows = base.select("source_id", "event_no", F.col("sec").cast("double").alias("sec"), "service", *more, F.explode(tracks).alias("t"))
    return rows.where("sec is not null").select("source_id", "t.track", "t.kind", "t.metric", "t.value", "event_no", "sec", "service", *more)


def source_rows(events: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """One narrow row per event for the source track, in the shape of ``detection_tracks``."""
    return events.select(
        "source_id", F.lit(SOURCE_TRACK).alias("track"), F.lit("source").alias("kind"), F.lit("").alias("metric"), F.lit(None).cast("double").alias("value"),
        "event_no", F.col("sec").cast("double").alias("sec"), "service", *more)


HITS = ("event_no long, sec long, ts timestamp, service string, detector string, metric string, observed double, baseline double, ratio double, "
        "sustained_s double, severity string, trace_id string, template_id string, evidence array<string>")


def all_tracks(events: DataFrame, muted: DataFrame | None = None) -> DataFrame:
    """Rows of every track with what the steps and the signals need of the event."""
    for name, kind in (("trace_id", "string"), ("template_pattern", "string"), ("ts", "timestamp")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    evidence = classify.evidence_lines(F.col("text_redacted"))
    told = events.withColumns({
        "evidence": evidence, "line": F.array_join(evidence, "\n"), "wrong": classify.error_like(F.col("level"), F.col("template_pattern")),
        "ts_us": F.unix_micros("ts"),
    })
    more = ("template_id", "trace_id", "level", "wrong", "evidence", "line", "ts_us")
    heard = told
    if muted is not None:
        told = told.join(muted.select("source_id", "template_id").distinct().withColumn("is_muted", F.lit(True)), ["source_id", "template_id"], "left")
        told = told.withColumn("is_muted", F.coalesce("is_muted", F.lit(False)))
        heard = told.where("not is_muted")
        more = (*more, "is_muted")
    return detection_tracks(heard, more).unionByName(source_rows(told, more))


def detector_step(cfg: Config = DEFAULT, ticks: bool = False):
    """The step of whichever kind of track the rows belong to. ``ticks``: the source track ends every batch with a row that
    only tells its clock (no detector), for what ages on it."""
    tracks, source = track_step(cfg), source_step(cfg)
    names = [x.strip().split()[0] for x in HITS.split(", ")]

    def step(state: dict, rows: Rows) -> tuple[dict, Rows]:
        whole = rows["kind"][0] == "source"
        if whole and "is_muted" in rows:
            quiet_rows = [t if m else None for t, m in zip(rows["template_id"], rows["is_muted"], strict=True)]
            run = source_step(cfg, frozenset(t for t in quiet_rows if t is not None))
        else:
            run = source if whole else tracks
        state, hits = run(state, rows)
        out: Rows = {c: [] for c in names}
        for n, i in enumerate(hits["at"]):
            own = {c: rows[c][i] for c in ("service", "trace_id")}
            row = {**own, "event_no": hits["event_no"][n], "sec": hits["sec"][n], "ts": rows["ts_us"][i], **{c: hits[c][n] for c in SAID}}
            if row["evidence"] is None:
                row["evidence"] = list(rows["evidence"][i] if rows["evidence"][i] is not None else [])
            for c in names:
                out[c].append(row[c])
        if ticks and whole and state.get("last") is not None:
            for c in names:
                out[c].append({"event_no": rows["event_no"][-1], "sec": state["last"]}.get(c))
        return state, out

    return step
