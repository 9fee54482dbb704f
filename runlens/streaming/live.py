"""Streaming twins of the batch operators.

Stateless parts (parsing, keys, measures) are the same column expressions as in batch,
and sequential rules are the same step functions; only the carrier differs: state lives
in a state store, time is event time. Late data: events up to ``delay`` late are used,
a jump back of more than a minute is a new day (``unroll_clock`` in batch). The
stateful operators need the RocksDB state store provider (see ``stateful_conf``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..functions import keys, parse
from ..operators import incidents, lines, traces
from . import signals
from .assign import stream_templates
from .signals import detection_tracks, track_step  # noqa: F401  (part of this module's interface)

Rows = dict[str, list]


def stateful_conf(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class StepProcessor(StatefulProcessor):
    """Carries the JSON state of a step function ``(state, rows) -> (state, output)``.

    ``flush_after_s``: processing-time silence after which ``on_idle`` may emit what is held.
    """

    def __init__(
        self, step: Callable[[dict, Rows], tuple[dict, Rows]], order: str, keys: list[str], names: list[str],
        on_idle: Callable[[dict], tuple[dict, Rows]] | None = None, flush_after_s: float = 0.0,
    ) -> None:
        self.step, self.order, self.keys, self.names = step, order, keys, names
        self.on_idle, self.flush_after_s = on_idle, flush_after_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("json", T.StringType())]))

    def _frame(self, key: tuple, out: Rows) -> pd.DataFrame:
        size = len(next(iter(out.values()))) if out else 0
        data = {k: [key[i]] * size for i, k in enumerate(self.keys)}
        data.update({n: out[n] for n in self.names})
        # plain objects: the declared schema decides the types
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in data.items()})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        pdf = pdf.astype(object).where(pdf.notna(), None)
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        state, out = self.step(state, {c: pdf[c].tolist() for c in pdf.columns if c not in self.keys})
        self.state.update((json.dumps(state),))
        if self.on_idle is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(
                timerValues.getCurrentProcessingTimeInMs() + int(self.flush_after_s * 1000)
            )
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.on_idle is None or not self.state.exists():
            return
        state, out = self.on_idle(json.loads(self.state.get()[0]))
        self.state.update((json.dumps(state),))
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def run_step(
    df: DataFrame, keys: list[str], order: str, step, out_schema: str | T.StructType, on_idle=None, flush_after_s: float = 0.0
) -> DataFrame:
    """A step function as a stateful streaming operator, output appended per micro-batch."""
    fields = T.StructType.fromDDL(out_schema) if isinstance(out_schema, str) else out_schema
    schema = T.StructType([*[df.schema[k] for k in keys], *fields.fields])
    processor = StepProcessor(step, order, keys, fields.names, on_idle, flush_after_s)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="ProcessingTime" if on_idle else "None",
    )


# ------------------------------------------------------------------ T1: folding


def folding_step(cfg: Config = DEFAULT):
    """Holds the open event of a source until a line shows that it is complete."""
    head = ("event_no", "level", "ts_text", "head", "service", "sec")

    def release(held: dict, out: Rows) -> None:
        for c in head:
            out[c].append(held.get(c))
        out["text"].append("\n".join([held["head"], *held["more"]]))
        out["folded_lines"].append(len(held["more"]))

    def empty() -> Rows:
        return {c: [] for c in (*head, "text", "folded_lines")}

    def step(state: dict, rows: Rows) -> tuple[dict, Rows]:
        out, held, last, second, clock = empty(), *(state.get(c) for c in ("held", "last", "second", "clock"))
        for i, no in enumerate(rows["line_no"]):
            last = rows["ts_text"][i] or last
            second = second if rows["ts_sec"][i] is None else int(rows["ts_sec"][i])
            if held and rows["is_cont"][i] and len(held["more"]) < cfg.max_continuation_lines:
                held["more"].append(rows["content"][i])
                continue
            if held:
                release(held, out)
            if second is not None:  # the clock of a source never goes back
                clock = second if clock is None else max(clock, second)
            held = {"event_no": no, "level": rows["level"][i], "ts_text": last, "head": rows["head"][i], "service": rows["service"][i], "sec": clock, "more": []}
        return {"held": held, "last": last, "second": second, "clock": clock}, out

    def on_idle(state: dict) -> tuple[dict, Rows]:
        out = empty()
        if state.get("held"):
            release(state["held"], out)
        return {**state, "held": None}, out

    return step, on_idle


def stream_events(raw_lines: DataFrame, cfg: Config = DEFAULT, idle_s: float = 3.0) -> DataFrame:
    """Folded events per source with its service and clock (``sec``); the last one is released after ``idle_s`` of silence
    (0: with the next line only, so that the operator can run in front of others without timers)."""
    if "service" not in raw_lines.columns:
        raw_lines = raw_lines.withColumn("service", F.lit(""))
    parsed = lines.parse_lines(lines.truncate_long_lines(raw_lines.where(F.trim("payload") != ""), cfg=cfg))
    message = F.when(F.col("message") == "", F.col("line")).otherwise(F.col("message"))
    content = parse.strip_short_scaffold(
        F.when(F.col("message") == "", parse.rstrip(F.col("payload"))).otherwise(F.col("message"))
    )
    narrow = parsed.select(
        "source_id", "line_no", "is_cont", "level",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"),
        F.floor(F.unix_micros("ts") / 1_000_000).alias("ts_sec"), "service",
        message.alias("head"), content.alias("content"),
    )
    step, on_idle = folding_step(cfg)
    return run_step(
        narrow, ["source_id"], "line_no", step,
        "event_no long, level string, ts_text string, head string, service string, sec long, text string, folded_lines long",
        on_idle if idle_s else None, idle_s,
    ).withColumn("ts", F.to_timestamp("ts_text")).drop("ts_text")


# -------------------------------------------------------- T2, T5, T7: built-in windows


def stream_template_minutes(events: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """Events per template and minute."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("source_id", "template_id", F.window("ts", "1 minute"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("source_id", "template_id", F.col("window.start").alias("minute"), "n_events")
    )


def run_step_of_source(cfg: Config = DEFAULT, any_purpose: bool = True):
    """T5 over the events of one source in order: a run is judged the first time the source's clock is ``quiet_s`` past its
    last event, and never again. State: runs that still wait (those of the last seconds), and judged names for ``judged_kept_s``."""

    def verdict(run: dict) -> str:
        if run["errors"]:
            return "failed"
        if not any_purpose or run["purpose"] is None:
            return "unknown"
        if not run["purpose"]:
            return "hollow"
        slow = run["p95"] is not None and run["p95"] > 0 and run["last"] - run["first"] > run["p95"] * cfg.slow_factor
        return "degraded" if slow else "achieved"

    def step(state: dict, rows: Rows) -> tuple[dict, Rows]:
        waiting, judged = state.get("waiting", {}), state.get("judged", {})
        names = ("trace_id", "verdict", "n_events", "n_errors", "duration_s", "ended_us", "judged_sec")
        out: Rows = {c: [] for c in names}

        def settle(now: float) -> None:
            for name in [n for n, run in waiting.items() if now - run["last"] >= cfg.quiet_s]:
                run = waiting[name]
                if run["n"] < cfg.min_judged_events:
                    continue  # it may still grow
                del waiting[name]
                judged[name] = now
                for c, v in zip(names, (name, verdict(run), run["n"], run["errors"], run["last"] - run["first"], int(run["last"] * 1_000_000), now), strict=True):
                    out[c].append(v)

        clock = state.get("clock")
        for i, at in enumerate(rows["at"]):
            if at is None:
                continue
            second = math.floor(at)
            if clock is None or second > clock:
                clock = second
                settle(clock)
            name = rows["trace_id"][i]
            if name is None or name in judged:
                continue
            run = waiting.setdefault(name, {"n": 0, "errors": 0, "purpose": None, "first": at, "last": at, "p95": None})
            run["n"] += 1
            run["errors"] += rows["wrong"][i]
            if rows["is_purpose"][i] is not None:
                run["purpose"] = bool(run["purpose"]) or rows["is_purpose"][i]
            run["first"], run["last"] = min(run["first"], at), max(run["last"], at)
            run["p95"] = rows["p95_s"][i]
        keep = None if clock is None else clock - cfg.judged_kept_s
        judged = {n: at for n, at in judged.items() if at >= keep}
        waiting = {n: run for n, run in waiting.items() if run["n"] >= cfg.min_judged_events or run["last"] >= keep}
        return {"waiting": waiting, "judged": judged, "clock": clock}, out

    return step


def stream_runs(
    events: DataFrame, critical: list[str] | DataFrame, p95_s: float | DataFrame | None = None, cfg: Config = DEFAULT,
) -> DataFrame:
    """T5: a run is judged once, when its source has been quiet about it for ``quiet_s`` of the source's own clock.

    ``critical``: template ids, or a table (source_id, template_id) of purpose steps; ``p95_s``: seconds, or a table (source_id, p95_s).
    Tables are joined with every batch. A source without purpose steps has runs of unknown purpose."""
    at = F.unix_micros("ts") / F.lit(1_000_000.0)
    rows = events.withColumns({"at": at, "wrong": F.col("level").isin("ERROR", "CRITICAL").cast("int")})
    if isinstance(critical, DataFrame):
        steps = critical.select("source_id", "template_id").distinct().withColumn("hit", F.lit(True))
        sources = critical.select("source_id").distinct().withColumn("has", F.lit(True))
        rows = rows.join(steps, ["source_id", "template_id"], "left").join(sources, "source_id", "left")
        rows = rows.withColumn("is_purpose", F.when(F.col("has"), F.coalesce("hit", F.lit(False))))
    else:
        rows = rows.withColumn("is_purpose", F.col("template_id").isin(critical) if critical else F.lit(None).cast("boolean"))
    if isinstance(p95_s, DataFrame):
        rows = rows.join(p95_s.groupBy("source_id").agg(F.max("p95_s").alias("p95_s")), "source_id", "left")
    else:
        rows = rows.withColumn("p95_s", F.lit(p95_s).cast("double"))
    judged = run_step(
        rows.select("source_id", "event_no", "trace_id", "at", "wrong", "is_purpose", "p95_s"), ["source_id"], "event_no", run_step_of_source(cfg),
        "trace_id string, verdict string, n_events long, n_errors long, duration_s double, ended_us long, judged_sec long",
    )
    return judged.withColumn("ended_at", F.timestamp_micros("ended_us")).drop("ended_us")


def stream_dedup(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A record polled twice is passed on once."""
    return records.withWatermark("collected_ts", delay).dropDuplicatesWithinWatermark(["collected_at", "payload"])


# -------------------------------------------------------------- T3, T4, T6: automata


def stream_link(events: DataFrame, cfg: Config = DEFAULT, text: str = "text_redacted") -> DataFrame:
    """Every event with its run: stated key, or the session rules over the open sessions. Guessed runs are numbered per
    source in the order they open, as in batch. Other columns of the event pass through."""
    step = traces.session_step(cfg.idle_timeout_s, cfg.max_synthetic_events)
    kept = [c for c in events.columns if c not in ("source_id", "trace_id", "correlation_basis")]

    def both(state: dict, rows: Rows) -> tuple[dict, Rows]:
        inner, found = step({"open": state.get("open", [])}, rows)
        guessed, name = state.get("guessed", 0), state.get("name")
        run_of = {}
        for no, session, opened in zip(found["event_no"], found["session"], found["opened_no"], strict=True):
            if opened is not None and opened == no:
                guessed += 1
                name = f"req-{guessed:06d}"
            run_of[no] = session if opened is None else name
        out: Rows = {c: rows[c] for c in kept}
        out["trace_id"] = [run_of.get(no) if key is None else key for no, key in zip(rows["event_no"], rows["key"], strict=True)]
        out["correlation_basis"] = [
            "extracted" if key is not None else "inferred" if no in run_of else "none" for no, key in zip(rows["event_no"], rows["key"], strict=True)]
        return {"open": inner["open"], "guessed": guessed, "name": name}, out

    features = traces.session_features(events, text)
    t = F.col(text)
    named = events.select("source_id", *kept, keys.extract_key(t).alias("key"), *[
        getattr(keys, c)(t).alias(c) for c in features.columns if c not in ("source_id", "event_no", "sec", "key")])
    schema = T.StructType([events.schema[c] for c in kept]).add("trace_id", "string").add("correlation_basis", "string")
    return run_step(named, ["source_id"], "event_no", both, schema)


def stream_detect(events: DataFrame, cfg: Config = DEFAULT, muted: DataFrame | None = None, ticks: bool = False) -> DataFrame:
    """T4: the seven detectors of ``operators.detect`` on a stream, state per (source, track) and per source. ``muted``
    (source_id, template_id): a table read with every batch. ``ticks`` adds a row without detector per source and batch that tells its clock."""
    hits = run_step(
        signals.all_tracks(events, muted), ["source_id", "track"], "event_no", signals.detector_step(cfg, ticks),
        signals.HITS.replace("ts timestamp", "ts long"),
    )
    return hits.withColumn("ts", F.timestamp_micros("ts"))


def stream_incidents(signals: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Signals to incidents by the same grouping step; status follows from the clock."""
    return run_step(
        signals.select("source_id", "signal_no", "sec", "onset", "service", "trace_id", "template_id", "detector", "severity"),
        ["source_id"], "signal_no", incidents.grouping_step(cfg),
        "signal_no long, incident_no long, rules string, opened boolean, recurred boolean",
    )


def timeline_step(cfg: Config = DEFAULT):
    """Signals and clock readings of one source in order to the entries of its incidents' timelines.

    Every row first lets the source's clock run: incidents that were held long enough are presented, quiet ones resolved, each at the
    second it became due. State is what grouping needs; incidents resolved longer than ``forget_s`` ago leave it."""
    grouping = incidents.grouping_step(cfg)

    def step(state: dict, rows: Rows) -> tuple[dict, Rows]:
        groups, open_ones, clock = state.get("groups", {}), state.get("open", {}), state.get("clock")
        out: Rows = {c: [] for c in ("incident_no", "at_s", "kind", "detail", "grouped_by", "status", "observed", "baseline")}

        def tell(no: int, at: float, kind: str, detail: str, status: str, grouped_by: str = "", observed: float | None = None, baseline: float | None = None) -> None:
            for c, v in zip(out, (no, int(at), kind, detail, grouped_by, status, observed, baseline), strict=True):
                out[c].append(v)

        def age(now: float) -> None:
            for no, i in sorted(open_ones.items(), key=lambda x: int(x[0])):
                if i["status"] == "forming" and now - i["opened"] >= cfg.hold_s:
                    i["status"] = "open"
                    tell(int(no), i["opened"] + cfg.hold_s, "presented", incidents.PRESENTED, "open")
                if now - i["last"] >= cfg.resolve_quiet_s:
                    tell(int(no), i["last"] + cfg.resolve_quiet_s, "resolved", incidents.RESOLVED, "resolved")
                    del open_ones[no]

        for n, now in enumerate(rows["sec"]):
            if clock is None or now > clock:
                clock = now
                age(now)
            if not rows["detector"][n]:
                continue
            groups, put = grouping(groups, {c: [rows[c][n]] for c in ("signal_no", "sec", "onset", "service", "trace_id", "template_id", "detector", "severity")})
            if put["incident_no"][0] is None:
                continue
            no = put["incident_no"][0]
            if put["opened"][0]:
                open_ones[str(no)] = {"opened": now, "last": now, "status": "forming"}
                tell(no, now, "opened", f"opened by {rows['detector'][n]} ({rows['severity'][n]})", "forming")
            elif put["recurred"][0]:
                open_ones[str(no)] = {"opened": now, "last": now, "status": "open"}
                tell(no, now, "recurred", incidents.RECURRED, "open")
            open_ones[str(no)]["last"] = now
            tell(no, now, "signal", f"{rows['detector'][n]} {rows['metric'][n]}", open_ones[str(no)]["status"], put["rules"][0], rows["observed"][n], rows["baseline"][n])
        if cfg.forget_s is not None and groups:
            groups["incidents"] = [i for i in groups["incidents"] if clock - i["last"] < cfg.resolve_quiet_s + cfg.forget_s]
        return {"groups": groups, "open": open_ones, "clock": clock}, out

    return step


def stream_incident_timeline(hits: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What happened to which incident when: opened, signal, presented, resolved, recurred, and the status after it.

    ``hits``: signals of ``stream_detect(..., ticks=True)``; its clock rows let incidents age while nothing is wrong. A source's
    rows are few: signals, and one clock row per batch."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(d) for d in incidents.DETECTOR_ORDER]), F.col("detector")), F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = hits.where("sec is not null").select(
        "source_id", "sec", "event_no", "detector", "metric", "service", "trace_id", "template_id", "severity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("onset"),
        "observed", "baseline", F.lit(0).cast("long").alias("signal_no"),
        # clock readings come after the signals of their second
        F.struct(
            "sec", F.col("detector").isNull().alias("is_clock"), "event_no", rank.alias("rank"), text("template_id").alias("t"), text("metric").alias("m"),
            text("trace_id").alias("r")).alias("place"),
    ).withColumn("place", F.concat_ws(
        "\u0001", F.lpad(F.col("place.sec").cast("string"), 20, "0"), F.col("place.is_clock").cast("int").cast("string"), F.lpad(F.col("place.event_no").cast("string"), 20, "0"),
        F.col("place.rank").cast("string"), "place.t", "place.m", "place.r"))
    return run_step(
        rows, ["source_id"], "place", timeline_step(cfg), "incident_no long, at_s long, kind string, detail string, grouped_by string, status string, observed double, baseline double")


# ------------------------------------------------------------------- the whole way


def stream_linked_events(raw_lines: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """T1, P10-P11, R5 and T3 in one plan: raw lines of a stream to folded, redacted, templated and linked events."""
    folded = lines.protect_and_mask(stream_events(raw_lines, cfg, idle_s=0.0))
    narrow = folded.select("source_id", "event_no", "sec", "ts", "service", "level", "text_redacted", "mask", "folded_lines")
    return stream_link(stream_templates(narrow, cfg), cfg)


def stream_signals(raw_lines: DataFrame, cfg: Config = DEFAULT, muted: DataFrame | None = None, ticks: bool = False) -> DataFrame:
    """Raw lines to the signals of all detectors, as one query."""
    return stream_detect(stream_linked_events(raw_lines, cfg), cfg, muted, ticks)


def stream_lines_to_incidents(raw_lines: DataFrame, cfg: Config = DEFAULT, muted: DataFrame | None = None) -> DataFrame:
    """Raw lines to the timelines of incidents, as one query."""
    return stream_incident_timeline(stream_signals(raw_lines, cfg, muted, ticks=True), cfg)
