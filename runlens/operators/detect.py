"""Statistical detectors over ordered event streams.

All detectors read events with ``source_id, event_no, sec, ts, service, level,
template_id, trace_id, text_redacted``. ``sec`` is whole seconds and never goes back
inside a source (see ``stream_clock``); a rate is therefore a function of per-second
counts, and a template of any size becomes at most 86,400 rows per day before any
window is laid over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, measure
from ..plans import scan
from . import baselines, gates, templates

TRACK = ["source_id", "template_id"]
SIGNAL = (
    "source_id", "detector", "event_no", "sec", "ts", "service", "metric", "observed", "baseline",
    "ratio", "sustained_s", "severity", "trace_id", "template_id", "evidence",
)


def stream_clock(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Whole seconds per event, never going back inside a source."""
    sec = F.floor(F.unix_micros("ts") / 1_000_000)
    return scan.running(
        events.withColumn("__sec", sec), ["source_id"], "event_no",
        {"sec": scan.highest(F.col("__sec"))}, cfg.segment_rows,
    ).drop("__sec")


def apply_suppressions(events: DataFrame, muted: DataFrame) -> DataFrame:
    """Events without the muted templates (``muted``: source_id, template_id)."""
    return events.join(muted.select("source_id", "template_id").distinct(), TRACK, "left_anti")


def per_second(events: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Occurrences per key and second."""
    return events.where(F.col("sec").isNotNull()).groupBy(*keys, "sec").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_no").alias("first_no")
    )


def _chunk_s(cfg: Config) -> int:
    return max(86_400, cfg.window_s)


def _trailing(seconds: DataFrame, keys: list[str], cfg: Config, sums: dict[str, Column]) -> DataFrame:
    """Sums over the ``window_s`` seconds before each second (that second excluded).

    A second's counts enter with it and leave ``window_s + 1`` seconds later, so one running sum over both moves gives every
    window; a sliding frame would add up its whole window again for each second."""
    cut = scan.with_context(seconds, "sec", _chunk_s(cfg), cfg.window_s)
    enters = F.struct(F.col("sec").alias("at"), F.lit(False).alias("leaves"))
    leaves = F.struct((F.col("sec") + cfg.window_s + 1).alias("at"), F.lit(True).alias("leaves"))
    moves = cut.withColumn("__m", F.explode(F.array(enters, leaves)))
    frame = Window.partitionBy(*keys, "chunk").orderBy("__m.at", F.desc("__m.leaves")).rowsBetween(Window.unboundedPreceding, -1)
    moved = {n: F.coalesce(F.sum(F.when(F.col("__m.leaves"), -c).otherwise(c)).over(frame), F.lit(0)) for n, c in sums.items()}
    return (
        moves.withColumns(moved)
        .where(~F.col("is_context") & ~F.col("__m.leaves"))
        .drop("chunk", "is_context", "__m")
    )


def trailing_rate(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per template and second, the events of the trailing window up to that second."""
    return _trailing(per_second(events), TRACK, cfg, {"before": F.col("n")}).select(
        *TRACK, "sec", (F.col("before") + F.col("n")).alias("rate")
    )


def _signals(
    hits: DataFrame, events: DataFrame, detector: str, metric: Column, severity: Column,
    sustained: float = 0.0, own_template: bool = True,
) -> DataFrame:
    """Signal rows for hits (source_id, event_no, observed, baseline, ratio, ...).

    Hits are few; the event they refer to is looked up by (source_id, event_no)."""
    has_evidence = "evidence" in hits.columns
    at = events.select(
        "source_id", "event_no", "sec", "ts", "service", "trace_id",
        F.col("template_id").alias("__own"), classify.evidence_lines(F.col("text_redacted")).alias("__ev"),
    )
    keep = hits.drop(*[c for c in ("sec", "ts", "service", "trace_id") if c in hits.columns])
    joined = at.join(keep, ["source_id", "event_no"])
    template = F.col("__own") if own_template else F.col("template_id")
    return joined.select(
        "source_id", F.lit(detector).alias("detector"), "event_no", "sec", "ts", "service",
        metric.alias("metric"), F.col("observed").cast("double"), F.col("baseline").cast("double"),
        F.col("ratio").cast("double"), F.lit(float(sustained)).alias("sustained_s"),
        severity.alias("severity"), "trace_id", template.alias("template_id"),
        (F.coalesce("evidence", "__ev") if has_evidence else F.col("__ev")).alias("evidence"),
    )


def detect_novelty(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """First occurrence of a template; harmless ones only after the warm-up."""
    firsts = templates.first_events(events)
    newest_of_warmup = (
        events.withColumn(
            "__r", F.row_number().over(Window.partitionBy("source_id").orderBy("event_no"))
        )
        .where(F.col("__r") <= cfg.novelty_warmup_events)
        .groupBy("source_id")
        .agg(F.max("event_no").alias("__warm"))
    )
    loud = F.col("level").isin("ERROR", "WARN", "WARNING", "CRITICAL")
    hits = (
        events.select("source_id", "event_no", "level")
        .join(firsts, ["source_id", "event_no"])
        .join(newest_of_warmup, "source_id")
        .where(loud | (F.col("event_no") > F.col("__warm")))
        .select(
            "source_id", "event_no",
            F.when(loud, "P2").otherwise("P4").alias("severity"),
            F.lit(1.0).alias("observed"), F.lit(0.0).alias("baseline"), F.lit(0.0).alias("ratio"),
        )
    )
    return _signals(
        hits, events, "NoveltyDetector", F.lit("first_occurrence"), F.col("severity")
    )


def _numbered_lines(hits: DataFrame, events: DataFrame, keys: list[str], upto: Column, n: int, cfg: Config) -> DataFrame:
    """The last ``n`` of the first ``upto`` events of each hit's key: keys, hit_no, no, text_redacted.

    Events are numbered without their texts, and only those of keys that have a hit; numbers and texts are joined by
    equality, so no second or key has to be searched."""
    narrow = events.join(hits.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("event_no").alias("no"))
    placed = scan.numbered(narrow, keys, "no", "pos", cfg.segment_rows)
    wanted = hits.select(*keys, F.col("event_no").alias("hit_no"), F.explode(F.sequence(F.greatest(upto - n, F.lit(0)), upto - 1)).alias("pos"))
    found = placed.join(wanted, [*keys, "pos"])
    return found.join(events.select("source_id", F.col("event_no").alias("no"), "text_redacted"), ["source_id", "no"])


def _occurrences(hits: DataFrame, events: DataFrame, upto: Column, cfg: Config) -> DataFrame:
    """Evidence of a rate signal: the last three of the first ``upto`` occurrences of its template."""
    lines = _numbered_lines(hits, events.where(F.col("sec").isNotNull()), TRACK, upto, 3, cfg)
    return lines.groupBy(*TRACK, F.col("hit_no").alias("event_no")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("no", "text_redacted"))),
            lambda x: F.array_join(classify.evidence_lines(x["text_redacted"]), "\n"),
        ).alias("evidence")
    )


def rate_conditions(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Gate input of D2: per template and second the conditions at its first and last event.

    Inside one second the window only grows while the history stays the same, so the
    conditions change at most once between the two.
    """
    seconds = _trailing(per_second(events), TRACK, cfg, {"w": F.col("n")})
    tracked = scan.running(
        seconds, TRACK, "sec", {"upto": scan.total(F.col("n")), "first": scan.lowest(F.col("sec"))},
        cfg.segment_rows,
    )
    history = F.col("sec") - F.col("first")
    completed = F.col("upto") - F.col("n") - F.col("w")
    usual = completed / F.greatest((history - cfg.window_s) / F.lit(float(cfg.window_s)), F.lit(1.0))
    bar = F.greatest(F.col("usual"), F.lit(cfg.rate_floor_per_min))

    def above(rate: Column) -> Column:
        return (rate >= cfg.rate_min_events) & (rate >= bar * cfg.rate_spike_ratio)

    def below(rate: Column) -> Column:
        return rate <= bar * cfg.rate_clear_ratio

    at_first, at_last = F.col("w") + 1, F.col("w") + F.col("n")
    return (
        tracked.where(history >= cfg.min_history_s)
        .withColumn("usual", usual)
        .select(
            *TRACK, "sec", F.col("first_no").alias("event_no"), "usual", (F.col("upto") - F.col("n") + 1).alias("seen"),
            at_first.cast("double").alias("observed"),
            above(at_first).alias("above"), below(at_first).alias("below"),
            above(at_last).alias("above_end"), below(at_last).alias("below_end"),
        )
    )


def detect_rate_spike(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The rate of a template against its own history, through the hysteresis gate."""
    rows = scan.durable(rate_conditions(events, cfg))
    breached = rows.where("above or above_end").select(*TRACK).distinct()
    gated = scan.chained_fold(
        rows.join(breached, TRACK, "left_semi"), TRACK, "sec",
        gates.gate_step(cfg.sustain_s, cfg.clear_sustain_s),
        "sec long, event_no long, usual double, seen long, observed double, change string", cfg.fold_rows, dense=True,
    )
    fired = scan.durable(gated.where("change = 'fire'").select(
        *TRACK, "event_no", "observed", F.col("usual").alias("baseline"),
        (F.col("observed") / F.greatest("usual", F.lit(cfg.rate_floor_per_min))).alias("ratio"), "seen",
    ))
    # the last three occurrences up to the one that fired, by their numbers
    shown = _occurrences(fired, events, F.col("seen"), cfg)
    hits = fired.drop("seen").join(shown, [*TRACK, "event_no"], "left")
    return _signals(
        hits, events, "RateSpike", F.lit("events_per_min"), F.lit("P2"), cfg.sustain_s,
        own_template=False,
    )


def detect_rate_drop(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """D3: a steady template that stopped, noticed at the next event of another one.

    The first event of the source at or after the due time is found by a range join
    whose buckets hold at most an hour of per-second rows.
    """
    seconds = scan.durable(per_second(events))
    tracked = scan.running(
        seconds, TRACK, "sec", {"upto": scan.total(F.col("n")), "first": scan.lowest(F.col("sec"))},
        cfg.segment_rows,
    )
    following = scan.running(
        tracked, TRACK, "sec",
        {"next": scan.lag(F.struct(F.col("sec").alias("sec"), F.col("first_no").alias("no")))},
        cfg.segment_rows, reverse=True,
    )
    active = (F.col("sec") - F.col("first")) / 60.0
    due = F.greatest(F.col("expected") * cfg.drop_factor, F.lit(cfg.drop_min_gap_s))
    candidates = (
        following.withColumn("active", active)
        .where(
            (F.col("upto") >= cfg.drop_min_events) & (F.col("active") >= cfg.drop_min_active_min)
            & (F.col("upto") / F.col("active") >= cfg.drop_min_rate)
        )
        .withColumn("expected", F.lit(60.0) / (F.col("upto") / F.col("active")))
        .withColumn("due", F.ceil(F.col("sec") + due))
        .where(F.col("next").isNull() | (F.col("next.sec") >= F.col("due")))
        .select(*TRACK, F.col("sec").alias("stopped"), "upto", "expected", "due", F.col("next.no").alias("back_no"))
        .withColumn("bucket", F.expr("due div 3600"))
    )
    stream = scan.running(
        seconds.groupBy("source_id", "sec").agg(F.min("first_no").alias("first_no")), ["source_id"], "sec",
        {"before": scan.lag(F.col("sec"))}, cfg.segment_rows,
    )
    covered = stream.where("before is not null").select(
        "source_id", F.col("sec").alias("seen"), "before", "first_no",
        F.explode(F.sequence(F.expr("(before + 1) div 3600"), F.expr("sec div 3600"))).alias("bucket"),
    )
    hits = (
        candidates.join(covered, ["source_id", "bucket"])
        .where((F.col("due") > F.col("before")) & (F.col("due") <= F.col("seen")))
        .where(F.col("back_no").isNull() | (F.col("first_no") < F.col("back_no")))
        .withColumn("observed", (F.col("seen") - F.col("stopped")).cast("double"))
        .select(
            *TRACK, F.col("first_no").alias("event_no"), "observed", F.col("expected").alias("baseline"),
            (F.col("observed") / F.col("expected")).alias("ratio"), "upto",
        )
    )
    # the last three occurrences before the template stopped, by their numbers
    seen = _occurrences(hits, events, F.col("upto"), cfg)
    return _signals(
        hits.drop("upto").join(seen, [*TRACK, "event_no"], "left"), events, "RateDrop",
        F.lit("silence_gap_s"), F.lit("P3"), own_template=False,
    )


def detect_silence(
    events: DataFrame, cfg: Config = DEFAULT, muted: DataFrame | None = None
) -> DataFrame:
    """The whole source went quiet, seen when it resumes.

    Only gaps over the absolute minimum can fire, so the median of the 200 gaps before
    is looked up for those alone (an equi-join on gap numbers). A clock that jumped back
    (``day_no`` of ``unroll_clock``) is a restart: it is no gap, and gaps before it say
    nothing about those after it.
    """
    day = F.col("day_no") if "day_no" in events.columns else F.lit(0)
    timed = events.where(F.col("sec").isNotNull()).select("source_id", day.cast("long").alias("day_no"), "event_no", "sec", "template_id")
    gaps = scan.running(
        scan.durable(timed), ["source_id", "day_no"], "event_no", {"before": scan.lag(F.col("sec"))}, cfg.segment_rows
    ).withColumn("gap", (F.col("sec") - F.col("before")).cast("double"))
    if muted is not None:
        gaps = apply_suppressions(gaps, muted)
    placed = scan.durable(scan.numbered(
        gaps.where(F.col("gap") >= 0).select("source_id", "day_no", "event_no", "sec", "gap"),
        ["source_id", "day_no"], "event_no", "pos", cfg.segment_rows,
    ))
    long = placed.where((F.col("gap") >= cfg.silence_min_s) & (F.col("pos") >= cfg.silence_min_gaps))
    prior = long.select(
        "source_id", "day_no", F.col("event_no").alias("hit_no"),
        F.explode(F.sequence(F.greatest(F.col("pos") - cfg.silence_gaps, F.lit(0)), F.col("pos") - 1)).alias("pos"),
    )
    medians = (
        placed.select("source_id", "day_no", "pos", "gap")
        .join(prior, ["source_id", "day_no", "pos"])
        .groupBy("source_id", F.col("hit_no").alias("event_no"))
        .agg(F.percentile("gap", 0.5).alias("usual"))
    )
    due = scan.durable(long.join(medians, ["source_id", "event_no"]).where(
        F.col("gap") >= F.col("usual") * cfg.silence_factor
    ))
    # a gap can only beat the longest reported one if it beats every candidate before it
    records = scan.running(
        due.select("source_id", "event_no", "gap", "usual"), ["source_id"], "event_no",
        {"top": scan.highest(F.col("gap"))}, cfg.segment_rows,
    )
    before = scan.running(
        records, ["source_id"], "event_no", {"top_before": scan.lag(F.col("top"))}, cfg.segment_rows
    ).where(F.col("top_before").isNull() | (F.col("gap") > F.col("top_before")))
    kept = scan.chained_fold(
        before.select("source_id", "event_no", "gap", "usual"), ["source_id"], "event_no",
        gates.record_step(cfg.silence_record), "event_no long, gap double, usual double",
        cfg.fold_rows, in_turn=True, dense=True,
    )
    hits = kept.select(
        "source_id", "event_no", F.col("gap").alias("observed"), F.col("usual").alias("baseline"),
        (F.col("gap") / F.greatest("usual", F.lit(0.01))).alias("ratio"),
    )
    return _signals(hits, events, "SilenceDetector", F.lit("silence_gap_s"), F.lit("P3"))


def _cooled(hits: DataFrame, keys: list[str], seconds: float, cfg: Config) -> DataFrame:
    cols = [c for c in hits.columns if c not in keys]
    ddl = ", ".join(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in cols)
    return scan.chained_fold(
        hits, keys, "event_no", gates.cooldown_step(seconds), ddl, cfg.fold_rows, dense=True
    )


def detect_latency_shift(
    events: DataFrame, cfg: Config = DEFAULT, samples: DataFrame | None = None
) -> DataFrame:
    """A duration far above the operation's own history, at most one per cooldown."""
    if samples is None:
        samples = baselines.duration_samples(events)
    spikes = baselines.spike_vs_history(samples, cfg)
    timed = spikes.join(
        events.where(F.col("sec").isNotNull()).select("source_id", "event_no", F.col("sec").alias("__sec")),
        ["source_id", "event_no"],
    )
    cooled = _cooled(
        timed.select(
            "source_id", "operation", "event_no", F.col("__sec").alias("sec"),
            F.col("value_ms").alias("observed"), F.col("median_ms").alias("baseline"), "ratio",
        ),
        ["source_id", "operation"], cfg.latency_cooldown_s, cfg,
    )
    return _signals(
        cooled, events, "LatencyShift", F.concat("operation", F.lit(" ms")), F.lit("P3")
    )


def error_conditions(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Gate input of D6: error share of the trailing window against the share so far."""
    pattern = F.col("template_pattern") if "template_pattern" in events.columns else F.lit(None).cast("string")
    flagged = scan.durable(events.where(F.col("sec").isNotNull()).select(
        "source_id", "event_no", "sec", classify.error_like(F.col("level"), pattern).cast("long").alias("err"),
    ))
    so_far = scan.running(
        flagged, ["source_id"], "event_no",
        {"total": scan.count(), "errors": scan.total(F.col("err"))}, cfg.segment_rows,
    )
    seconds = flagged.groupBy("source_id", "sec").agg(
        F.count(F.lit(1)).alias("n"), F.sum("err").alias("e")
    )
    opened = scan.running(
        _trailing(seconds, ["source_id"], cfg, {"w_n": F.col("n"), "w_e": F.col("e")}),
        ["source_id"], "sec", {"c_n": scan.total(F.col("n")), "c_e": scan.total(F.col("e"))},
        cfg.segment_rows,
    ).select(
        "source_id", "sec", "w_n", "w_e",
        (F.col("c_n") - F.col("n")).alias("b_n"), (F.col("c_e") - F.col("e")).alias("b_e"),
    )
    history, base_errors = F.col("total") - 1, F.col("errors") - F.col("err")
    in_window = F.col("w_n") + F.col("total") - F.col("b_n")
    # events that are not numbered in time order can leave a window empty: it has no share
    share = F.try_divide(F.col("w_e") + F.col("errors") - F.col("b_e"), in_window)
    base = base_errors / F.greatest(history, F.lit(1))
    return (
        so_far.join(opened, ["source_id", "sec"])
        .where(history >= cfg.error_min_history)
        .select("source_id", "event_no", "sec", "errors", in_window.alias("in_window"), share.alias("observed"), base.alias("usual"))
        .withColumns({
            "above": (F.col("in_window") >= cfg.error_min_window)
            & (F.col("observed") >= F.greatest(F.lit(cfg.error_floor), F.col("usual") * cfg.error_ratio)),
            "below": F.col("observed")
            <= F.greatest(F.lit(cfg.error_clear_floor), F.col("usual") * cfg.error_clear_ratio),
        })
        .drop("in_window")
    )


def detect_error_ratio(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Share of error-like events against the stream's own share, through the gate."""
    rows = scan.durable(error_conditions(events, cfg))
    breached = rows.where("above").select("source_id").distinct()
    state = F.struct("sec", "above", "below")
    marked = scan.running(
        rows.join(breached, "source_id", "left_semi"), ["source_id"], "event_no",
        {"was": scan.lag(state)}, cfg.segment_rows,
    )
    # inside one second and one condition nothing can change after the first event
    changing = marked.where(F.col("was").isNull() | ~F.col("was").eqNullSafe(state)).drop("was", "errors")
    gated = scan.chained_fold(
        changing, ["source_id"], "event_no", gates.gate_step(cfg.sustain_s, cfg.clear_sustain_s),
        "event_no long, sec long, observed double, usual double, change string", cfg.fold_rows, dense=True,
    )
    fired = gated.where("change = 'fire'").select(
        "source_id", "event_no", "sec", "observed", F.col("usual").alias("baseline"),
        (F.col("observed") / F.greatest("usual", F.lit(0.001))).alias("ratio"),
    )
    # the last twelve evidence lines come from the last twelve error-like events, wherever they are
    pattern = F.col("template_pattern") if "template_pattern" in events.columns else F.lit(None).cast("string")
    wrong = events.where(F.col("sec").isNotNull() & classify.error_like(F.col("level"), pattern))
    counted = fired.join(rows.select("source_id", "event_no", "errors"), ["source_id", "event_no"])
    last12 = _numbered_lines(counted, wrong, ["source_id"], F.col("errors"), 12, cfg)
    evidence = last12.groupBy("source_id", F.col("hit_no").alias("event_no")).agg(
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("no", "text_redacted"))),
            lambda x: classify.evidence_lines(x["text_redacted"]),
        )).alias("__all")
    ).select(
        "source_id", "event_no",
        F.slice("__all", F.greatest(F.size("__all") - 12, F.lit(0)) + 1, F.lit(12)).alias("evidence"),
    )
    return _signals(
        fired.drop("sec").join(evidence, ["source_id", "event_no"], "left"), events, "ErrorRatio",
        F.lit("error_share"), F.lit("P2"), cfg.sustain_s,
    )


def cost_samples(events: DataFrame, text: str = "text_redacted") -> DataFrame:
    """P14 over events: one row per line that states a cost."""
    priced = events.where(F.col("sec").isNotNull()).withColumn(
        "c", measure.extract_cost(classify.head_line(F.col(text)))
    )
    return (
        scan.computed_once(priced)
        .where("c is not null")
        .select("source_id", F.col("c.label").alias("label"), F.col("c.amount").alias("amount"), "event_no", "sec")
    )


def cost_spikes(costs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Costs at 2.5 times the upper median of the (up to 200) costs of the same work before."""
    prior = scan.sliding(
        costs.select("source_id", "label", "event_no", "sec", "amount"), ["source_id", "label"],
        "event_no", "amount", cfg.max_samples, scan.UPPER_MEDIAN, segment_rows=cfg.segment_rows,
    )
    return prior.where(
        (F.col("prior_n") >= cfg.cost_min_samples) & (F.col("prior") > 0)
        & (F.col("amount") >= F.col("prior") * cfg.cost_ratio)
    )


def detect_cost_anomaly(
    events: DataFrame, cfg: Config = DEFAULT, costs: DataFrame | None = None
) -> DataFrame:
    """Tokens per unit of work against that work's own history."""
    spikes = cost_spikes(cost_samples(events) if costs is None else costs, cfg)
    cooled = _cooled(
        spikes.select(
            "source_id", "label", "event_no", "sec", F.col("amount").alias("observed"),
            F.col("prior").alias("baseline"), (F.col("amount") / F.col("prior")).alias("ratio"),
        ),
        ["source_id", "label"], cfg.cost_cooldown_s, cfg,
    )
    return _signals(cooled, events, "CostAnomaly", F.concat("label", F.lit(" tokens")), F.lit("P3"))


def detect_all(
    events: DataFrame, cfg: Config = DEFAULT, muted: DataFrame | None = None,
    samples: DataFrame | None = None, costs: DataFrame | None = None, conformance: DataFrame | None = None,
) -> DataFrame:
    """Every detector over one event table, with the conformance signals of its judged runs if
    there are any; muted templates only keep the stream alive."""
    heard = events if muted is None else apply_suppressions(events, muted)
    parts = [
        detect_novelty(heard, cfg),
        detect_silence(events, cfg, muted),
        detect_rate_spike(heard, cfg),
        detect_rate_drop(heard, cfg),
        detect_latency_shift(heard, cfg, samples),
        detect_error_ratio(heard, cfg),
        detect_cost_anomaly(heard, cfg, costs),
        *([] if conformance is None else [conformance.select(*SIGNAL)]),
    ]
    return reduce(DataFrame.unionByName, parts).select(*SIGNAL)
