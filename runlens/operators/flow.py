"""Flow specs, run verdicts and run views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, measure
from ..plans import scan

RUN = ["source_id", "trace_id"]


def first_positions(events: DataFrame, item: str, cfg: Config = DEFAULT) -> DataFrame:
    """Per run and item: the first position in the run as a share 0..1, and the run size."""
    linked = events.where(F.col("trace_id").isNotNull())
    placed = scan.numbered(
        linked.select(*RUN, "event_no", item), RUN, "event_no", "pos", cfg.segment_rows
    )
    sizes = linked.groupBy(*RUN).agg(F.count(F.lit(1)).alias("run_events"))
    firsts = placed.groupBy(*RUN, item).agg(F.min("pos").alias("pos"))
    return firsts.join(sizes, RUN).withColumn(
        "position", F.col("pos") / F.greatest(F.col("run_events") - 1, F.lit(1))
    )


def run_spans(events: DataFrame) -> DataFrame:
    """Per run: number of events, first and last time, seconds between them."""
    return (
        events.where(F.col("trace_id").isNotNull())
        .groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("run_events"),
            F.min("ts").alias("opened_at"),
            F.max("ts").alias("ended_at"),
        )
        .withColumn(
            "span_s",
            F.coalesce(
                (F.unix_micros("ended_at") - F.unix_micros("opened_at")) / F.lit(1_000_000.0), F.lit(0.0)
            ),
        )
    )


def mine_flow(
    events: DataFrame, cfg: Config = DEFAULT, duration: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(steps, spec) per source from the runs with enough events.

    steps: presence, required, median position and p95 duration per template, ordered by
    position. spec: number of runs mined and the p50 / p95 of their span.
    """
    spans = run_spans(events).where(F.col("run_events") >= cfg.min_trace_events)
    usable = events.join(spans.select(*RUN), RUN, "left_semi")
    mined = spans.groupBy("source_id").agg(F.count(F.lit(1)).alias("traces_mined"))
    timed = spans.where("ended_at is not null")
    spec = mined.join(
        scan.quantile_at(
            timed, ["source_id"], "span_s", {"p50_s": scan.MEDIAN, "p95_s": scan.P95_FLOOR}
        ).drop("n"),
        "source_id", "left",
    )
    positions = scan.durable(first_positions(usable, "template_id", cfg))
    seen = positions.groupBy("source_id", "template_id").agg(F.count(F.lit(1)).alias("n_runs"))
    ranks = scan.quantile_at(
        positions, ["source_id", "template_id"], "position", {"median_rank": scan.MEDIAN}
    ).drop("n")
    steps = seen.join(ranks, ["source_id", "template_id"]).join(mined, "source_id")
    measured = duration
    if measured is None and "text_redacted" in events.columns:
        measured = measure.extract_duration(classify.head_line(F.col("text_redacted")))
    if measured is not None:
        longest = scan.quantile_at(
            usable.select("source_id", "template_id", measured.alias("d")),
            ["source_id", "template_id"], "d", {"max_duration_ms": scan.P95_FLOOR},
        ).drop("n")
        steps = steps.join(longest, ["source_id", "template_id"], "left")
    else:
        steps = steps.withColumn("max_duration_ms", F.lit(None).cast("double"))
    if "text_redacted" in events.columns:
        label = F.min_by(classify.step_label(F.col("text_redacted")), "event_no")
        steps = steps.join(
            usable.groupBy("source_id", "template_id").agg(label.alias("label")),
            ["source_id", "template_id"],
        )
    else:
        steps = steps.withColumn("label", F.col("template_id"))
    share = F.col("n_runs") / F.col("traces_mined")
    steps = steps.select(
        "source_id", "template_id", "label", "n_runs",
        share.alias("presence"),
        (share >= cfg.required_presence).alias("required"),
        F.lit(False).alias("critical"),
        "median_rank",
        F.coalesce("max_duration_ms", F.lit(0.0)).alias("max_duration_ms"),
    )
    return steps, spec


def mark_purpose(steps: DataFrame, purpose: list[str]) -> DataFrame:
    """The steps a run exists for; unknown ids change nothing."""
    return steps.withColumn("critical", F.col("template_id").isin(list(purpose)))


def _expectations(steps: DataFrame) -> DataFrame:
    """Per source: the required and the critical steps as arrays (one row per source)."""
    step = F.struct("template_id", "label", "presence", "median_rank")
    return steps.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("required") & ~F.col("critical"), step))).alias("required_steps"),
        F.array_sort(F.collect_list(F.when(F.col("critical"), step))).alias("critical_steps"),
    )


def _present_steps(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Events of runs, reduced to templates that the spec names (bounded set per run)."""
    named = steps.where("required or critical").select("source_id", "template_id")
    return events.where(F.col("trace_id").isNotNull()).join(named, ["source_id", "template_id"], "left_semi")


def missing_steps(events: DataFrame, steps: DataFrame) -> DataFrame:
    """One P3 row per run and required, non-critical step that never ran."""
    runs = events.where(F.col("trace_id").isNotNull()).select(*RUN).distinct()
    present = _present_steps(events, steps).groupBy(*RUN).agg(F.collect_set("template_id").alias("present"))
    absent = F.filter(
        "required_steps",
        lambda s: ~F.array_contains(F.coalesce(F.col("present"), F.array().cast("array<string>")), s["template_id"]),
    )
    return (
        runs.join(present, RUN, "left")
        .join(_expectations(steps), "source_id")
        .select(*RUN, F.explode(absent).alias("s"))
        .select(
            *RUN,
            F.lit("missing_step").alias("type"),
            F.col("s.template_id").alias("step_id"),
            F.col("s.presence").alias("presence"),
            F.lit("P3").alias("severity"),
        )
    )


def judge_runs(
    events: DataFrame, steps: DataFrame, spec: DataFrame, cfg: Config = DEFAULT
) -> DataFrame:
    """One verdict per run: failed > unknown > hollow > degraded > achieved.

    One aggregation over the runs; the flags of the few critical steps arrive by a
    small join, so neither run size nor source size matters. The first three error lines
    of a failed run are ranked on error rows only, which Spark cuts before the shuffle.
    """
    critical = steps.where("critical").select(
        "source_id", "template_id", F.lit(True).alias("__critical")
    )
    step = F.struct("median_rank", "template_id", F.left("label", F.lit(36)).alias("label"))
    has_purpose = steps.where("critical").groupBy("source_id").agg(
        F.lit(True).alias("__marked"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(step)), 1, 3), lambda x: x["label"]), ", ").alias("__family"),
    )
    error = F.col("level").isin("ERROR", "CRITICAL")
    text = F.col("text_redacted") if "text_redacted" in events.columns else F.col("template_id")
    head = F.left(classify.head_line(text), F.lit(160))
    service = F.col("service") if "service" in events.columns else F.lit("")
    linked = events.where(F.col("trace_id").isNotNull())
    nth = F.row_number().over(Window.partitionBy(*RUN).orderBy("event_no"))
    errors = (
        linked.where(error).select(*RUN, "event_no", head.alias("__line")).withColumn("__nth", nth).where("__nth <= 3")
        .groupBy(*RUN).agg(F.transform(F.array_sort(F.collect_list(F.struct("__nth", "__line"))), lambda x: x["__line"]).alias("__errors"))
    )
    runs = (
        linked
        .join(critical, ["source_id", "template_id"], "left")
        .groupBy(*RUN)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if(error).alias("n_errors"),
            F.coalesce(F.bool_or("__critical"), F.lit(False)).alias("purpose_ran"),
            F.min("ts").alias("opened_at"),
            F.max("ts").alias("ended_at"),
            F.min_by(head, "event_no").alias("__first"),
            F.max_by(head, "event_no").alias("__last"),
            F.min_by(service, "event_no").alias("service"),
            F.max("event_no").alias("last_event_no"),
        )
    )
    span = F.coalesce(
        (F.unix_micros("ended_at") - F.unix_micros("opened_at")) / F.lit(1_000_000.0), F.lit(0.0)
    )
    judged = (
        runs.join(has_purpose, "source_id", "left")
        .join(spec.select("source_id", "p95_s"), "source_id", "left")
        .join(errors, RUN, "left")
        .withColumn("duration_s", span)
        .withColumn("slow", F.coalesce((F.col("p95_s") > 0) & (F.col("duration_s") > F.col("p95_s") * cfg.slow_factor), F.lit(False)))
    )
    marked = F.coalesce("__marked", F.lit(False))
    verdict = (
        F.when(F.col("n_errors") > 0, "failed")
        .when(~marked, "unknown")
        .when(~F.col("purpose_ran"), "hollow")
        .when(F.col("slow"), "degraded")
        .otherwise("achieved")
    )
    evidence = (
        F.when(F.col("verdict") == "failed", F.col("__errors"))
        .when(F.col("verdict") == "hollow", F.array("__first", "__last"))
        .when(F.col("verdict") == "degraded", F.array("__last"))
        .otherwise(F.array().cast("array<string>"))
    )
    took, usual = F.format_string("%.0fs", "duration_s"), F.format_string("%.0fs", "p95_s")
    deviation = lambda kind, severity, expected, observed: F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), expected.alias("expected"), observed.alias("observed"))
    deviations = F.array_compact(F.array(
        F.when(marked & ~F.col("purpose_ran"), deviation(
            "purpose_never_ran", "P2", F.concat(F.lit("one of the purpose steps ("), F.col("__family"), F.lit("...)")), F.lit("no purpose step ran; no error raised"))),
        F.when(F.col("slow"), deviation("slow_flow", "P3", F.concat(F.lit("<= "), usual, F.lit(" (p95)")), took)),
    ))
    reason = (
        F.when(F.col("verdict") == "failed", F.concat(F.col("n_errors").cast("string"), F.lit(" error event(s) in the trace")))
        .when(F.col("verdict") == "unknown", "no step is marked as the purpose of these runs")
        .when(F.col("verdict") == "hollow", "ended without an error, but none of its purpose steps ran")
        .when(F.col("verdict") == "degraded", F.concat(F.lit("achieved its purpose in "), took, F.lit(" against a p95 of "), usual))
        .otherwise("purpose steps ran, no errors, usual duration")
    )
    return judged.withColumn("verdict", verdict).select(
        *RUN, "verdict", reason.alias("reason"), "n_events", "n_errors", "duration_s", "opened_at", "ended_at", "service",
        "last_event_no", evidence.alias("evidence"), deviations.alias("deviations"),
    )


def complete_runs(verdicts: DataFrame, events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """C4: runs that have been quiet long enough on their source's clock to be judged."""
    clock = events.groupBy("source_id").agg(F.max("ts").alias("__now"))
    quiet = (F.unix_micros("__now") - F.unix_micros("ended_at")) / F.lit(1_000_000.0) >= cfg.quiet_s
    return (
        verdicts.join(clock, "source_id")
        .where((F.col("n_events") >= cfg.min_judged_events) & quiet)
        .drop("__now")
    )


def conformance_signals(verdicts: DataFrame) -> DataFrame:
    """One signal per P2 deviation of a judged run, at its last event and with the columns of every other signal."""
    flow = F.concat(F.lit("flow '"), F.col("source_id"), F.lit("': "), F.col("d.expected"), F.lit(" - observed: "), F.col("d.observed"))
    return (
        verdicts.select("*", F.explode("deviations").alias("d"))
        .where("d.severity = 'P2'")
        .select(
            "source_id",
            F.lit("ConformanceRate").alias("detector"),
            F.col("last_event_no").alias("event_no"),
            F.floor(F.unix_micros("ended_at") / 1_000_000).alias("sec"),
            F.col("ended_at").alias("ts"),
            "service",
            F.col("d.type").alias("metric"),
            F.lit(0.0).alias("observed"),
            F.lit(1.0).alias("baseline"),
            F.lit(0.0).alias("ratio"),
            F.lit(0.0).alias("sustained_s"),
            F.lit("P2").alias("severity"),
            "trace_id",
            F.lit("").alias("template_id"),
            F.concat(F.array(flow), F.coalesce("evidence", F.array().cast("array<string>"))).alias("evidence"),
        )
    )


def run_view(events: DataFrame, steps: DataFrame, shown: int = 25) -> DataFrame:
    """Per run its first steps, its service, and whether each purpose step ran."""
    linked = events.where(F.col("trace_id").isNotNull())
    early = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.col("ts").asc_nulls_last(), "event_no"))
    text = F.col("text_redacted") if "text_redacted" in events.columns else F.col("template_id")
    service = F.col("service") if "service" in events.columns else F.lit("")
    first = (
        linked.withColumns({"__text": F.left(classify.head_line(text), F.lit(150)), "__service": service})
        .withColumn("__r", early)
        .where(F.col("__r") <= shown)
        .groupBy(*RUN)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("__r", "ts", "__text", "__service"))),
                lambda s: F.struct(s["ts"].alias("ts"), s["__text"].alias("text"), s["__service"].alias("service")),
            ).alias("steps"),
            F.min_by("__service", F.when(F.col("__service") != "", F.col("__r"))).alias("service"),
        )
    )
    ran = _present_steps(linked, steps).groupBy(*RUN).agg(F.collect_set("template_id").alias("present"))
    reached = F.transform(
        F.slice("critical_steps", F.lit(1), F.lit(6)),
        lambda s: F.struct(
            F.left(s["label"], F.lit(70)).alias("label"),
            F.array_contains(F.coalesce(F.col("present"), F.array().cast("array<string>")), s["template_id"]).alias("ran"),
        ),
    )
    return (
        run_spans(events).select(*RUN, "run_events", "opened_at")
        .join(first, RUN)
        .join(ran, RUN, "left")
        .join(_expectations(steps), "source_id")
        .withColumn("expected", reached)
        .select(*RUN, "opened_at", "run_events", "service", "steps", "expected")
    )
