"""Every operator as a query over the given tables: name -> function(spark, folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import classify, keys, mask, measure, parse, redact
from ..operators import (
    audit, baselines, detect, flow, gates, incidents, lines, memory, profile, reports, templates, topology,
    tracker, traces, verify,
)
from ..sources import ingest, tables
from . import chain, scan

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

# ``events`` is sparse (one event in four minutes), so minute-scale thresholds become hours
HOURS = Config(
    window_s=6 * 3600, min_history_s=86_400, rate_spike_ratio=1.5, rate_clear_ratio=1.2,
    sustain_s=1200, clear_sustain_s=3600, drop_factor=4, drop_min_rate=0.01, drop_min_gap_s=600,
    silence_min_s=1200, silence_factor=3, error_ratio=1.3, error_floor=0.2, error_clear_ratio=1.1, latency_cooldown_s=3600,
    cost_cooldown_s=3600, cost_ratio=1.8, hold_s=900, temporal_s=1800, resolve_quiet_s=7200,
    min_trace_events=2, slow_factor=1.1, rank_margin=0.001,
)
PURPOSE = ["purchase"]
AS_OF = datetime(2024, 1, 25)


def query(fn: Query) -> Query:
    """Register a query; the tables hold times without a zone, which are read as UTC."""

    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, folder)

    CATALOG[fn.__name__] = run
    return run


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables.activity_events(spark, d)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(
        "source_id", F.col("service").alias("component"), F.col("template_id").alias("operation"),
        "value_ms", "event_no", "ts", "sec",
    )


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(
        "source_id", F.col("template_id").alias("label"), "amount", "event_no", "sec"
    )


def _steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = _events(spark, d)
    steps, spec = flow.mine_flow(ev, HOURS, duration=F.col("value_ms"))
    return ev, flow.mark_purpose(steps, PURPOSE), spec


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return flow.judge_runs(*_steps(spark, d), HOURS)


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    return tracker.annotate_events(
        lines.parse_lines(tables.mixed_lines(spark, d).where("payload <> ''")).withColumnRenamed("line_no", "event_no")
    )


def _list(col, sep: str = "|"):
    return F.array_join(col, sep)


# ------------------------------------------------------------------ sources and sinks


@query
def read_log_lines(spark, d):  # S1
    path = f"{scan.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    tables.activity_lines(spark, d).select("payload").write.text(path)
    return ingest.read_log_lines(spark, path, service="web").select("service", "payload")


@query
def truncate_long_lines(spark, d):  # S2
    docs = tables.spread(tables.load(spark, d, "documents")).select("doc_id", F.col("text").alias("payload"))
    return lines.truncate_long_lines(docs, cfg=Config(max_line_chars=2000)).select("doc_id", F.md5("payload").alias("digest"))


@query
def limit_backfill(spark, d):  # S3
    kept = lines.limit_backfill(tables.document_lines(spark, d), replace(Config(), backfill_bytes=50_000))
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


@query
def combine_sources(spark, d):  # S4
    both = ingest.combine_sources("p1", tables.activity_lines(spark, d), tables.document_lines(spark, d))
    return both.groupBy("project_id", "source_id").agg(F.count(F.lit(1)).alias("n_lines"))


def _vendor_rows(spark, d):
    e = _events(spark, d)
    text = lambda c: F.col(c).cast("string")
    return e.select("event_no", F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct(
            F.col("text_redacted").alias("body"),
            F.when(F.col("level") == "ERROR", "ERROR").otherwise("").alias("severity_text"),
            F.create_map(F.lit("trace_id"), F.col("trace_id"), F.lit("http.route"), F.concat(F.lit("/a b/"), F.col("template_id"))).alias("attributes_string"),
            F.create_map(F.lit("k"), F.col("amount").cast("int")).alias("attributes_number"),
            F.create_map(
                F.lit("service.name"), F.concat(F.when(F.col("event_no") % 3 == 0, "pay-uat-").when(F.col("event_no") % 3 == 1, "prod-").otherwise("x-"), F.col("service")),
                F.lit("env"), F.when(F.col("event_no") % 5 == 0, "blue").otherwise("unknown"),
            ).alias("resources_string"),
        ).alias("data"),
    )).alias("row"))


@query
def normalize_connector_rows(spark, d):  # S5, S6
    return ingest.normalize_connector_rows(_vendor_rows(spark, d))


@query
def infer_environment(spark, d):  # S6
    named = ingest.normalize_connector_rows(_vendor_rows(spark, d))
    return named.groupBy("service", "host").agg(F.count(F.lit(1)).alias("records"))


def _service_lines(spark, d):
    return _events(spark, d).select("event_no", "ts", "service", "level", F.col("text_redacted").alias("payload"))


@query
def query_logs(spark, d):  # S7
    return ingest.query_logs(
        _service_lines(spark, d), "svc-3", datetime(2024, 1, 5), "error by", 200, "event_no"
    ).select("event_no", "payload")


@query
def list_services(spark, d):  # S8
    return ingest.list_services(_service_lines(spark, d), datetime(2024, 1, 10))


@query
def fair_share_sample(spark, d):  # S9
    return ingest.fair_share_sample(_service_lines(spark, d), 500, "event_no").select("service", "event_no")


@query
def dedup_polled(spark, d):  # S10
    polled = _service_lines(spark, d).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("collected_at"), "payload")
    return ingest.dedup_polled(polled.unionByName(polled.where(F.length("payload") > 15)))


@query
def parse_tabular_reply(spark, d):  # S11
    e = _events(spark, d)
    row = F.concat_ws(
        " | ", F.concat(F.lit("t"), F.col("event_no").cast("string")), "template_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("value_ms").cast("string"),
        F.when(F.col("level") == "ERROR", "Timeout").otherwise(F.when(F.col("event_no") % 2 == 0, "none").otherwise("")),
    )
    replies = e.groupBy("trace_id").agg(
        F.concat(F.lit("found rows\nid | name | start_time | duration_ms | error_type\n"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_no", row.alias("r")))), lambda x: x["r"]), "\n")).alias("reply")
    )
    return ingest.parse_tabular_reply(replies).select("trace_id", "payload")


@query
def flatten_record(spark, d):  # S12
    o = tables.load(spark, d, "orders")
    record = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("priority"),
        F.struct(F.col("o_custkey").alias("customer"), F.lit(None).cast("string").alias("none")).alias("who"),
        F.array("o_orderstatus", F.lit("x")).alias("states"), F.repeat(F.lit("y"), 61).alias("long"),
    ))
    return o.select("o_orderkey", _list(ingest.flatten_record(record), " ").alias("pairs"))


@query
def select_reply_lines(spark, d):  # S13
    c = tables.load(spark, d, "conversations")
    replies = c.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("body"))
    ).alias("lines")).alias("result"))).alias("reply"))
    return ingest.select_reply_lines(replies, "result.lines", "body").select(
        "conv_id", F.col("row_no").cast("long"), F.md5("payload").alias("digest")
    )


@query
def enrich_with_detail(spark, d):  # S14
    o = tables.load(spark, d, "orders")
    rows = o.select("o_orderkey", F.concat(F.lit("INFO order completed priority="), F.left("o_orderpriority", F.lit(1)),
                                           F.lit(" trace_id=o"), F.col("o_orderkey").cast("string")).alias("payload"))
    details = o.where("o_orderkey % 2 = 0").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
        F.to_json(F.struct(
            F.struct(F.lit("n").alias("name"), F.col("o_custkey").alias("customer"), F.lit("zz").alias("priority")).alias("trace"),
            F.array(F.struct(F.lit(None).cast("string").alias("model")), F.struct(F.concat(F.lit("m"), F.col("o_orderstatus")).alias("model"))).alias("spans"),
        )).alias("record"),
    )
    return ingest.enrich_with_detail(rows, details).select("o_orderkey", "payload")


@query
def merge_counts(spark, d):  # S15
    minutes = lambda ev: templates.template_minutes(ev)
    ev = _events(spark, d)
    merged = ingest.merge_counts(
        minutes(ev.where("event_no % 3 = 0")), minutes(ev.where("event_no % 3 <> 0")),
        ["source_id", "template_id", "minute"], ["n_events"],
    )
    return merged.select("template_id", F.unix_seconds("minute").alias("minute_s"), "n_events")


# ------------------------------------------------------------------ line expressions


@query
def parse_lines(spark, d):  # P1-P6
    p = lines.parse_lines(tables.activity_lines(spark, d))
    return p.select("line_no", "ts_date", "clock", F.unix_seconds("ts").alias("ts_s"), "level", "message")


@query
def parse_mixed_lines(spark, d):  # P2, P5, P6
    p = lines.parse_lines(tables.mixed_lines(spark, d).where("payload <> ''"))
    return p.select("line_no", "clock", "level", "message")


@query
def strip_ansi(spark, d):  # P1
    c = tables.load(spark, d, "conversations")
    painted = F.concat(F.lit("\x1b[1;31m"), F.col("role"), F.lit("\x1b[0m "), F.col("text"))
    return c.select("conv_id", "turn", F.md5(parse.strip_ansi(painted)).alias("digest"))


@query
def line_predicates(spark, d):  # P7-P9
    p = lines.parse_lines(tables.mixed_lines(spark, d).where("payload <> ''"))
    return p.select("line_no", "is_cont", "is_noise")


@query
def redact_documents(spark, d):  # P10
    docs = redact.redact(tables.spread(tables.load(spark, d, "documents")), "text")
    return docs.select("doc_id", F.explode("redactions").alias("label", "n"))


@query
def redact_emails(spark, d):  # P10, one rule
    docs = tables.spread(tables.load(spark, d, "documents"))
    return docs.select(
        "doc_id",
        F.regexp_count("text", F.lit(redact.EMAIL)).cast("long").alias("emails"),
        F.md5(F.regexp_replace("text", redact.EMAIL, "<EMAIL>")).alias("digest"),
    )


@query
def mask_lines(spark, d):  # P11
    return tables.activity_lines(spark, d).groupBy(mask.mask_key(F.col("payload")).alias("mask")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )


@query
def mask_documents(spark, d):  # P11
    return tables.document_lines(spark, d).select("line_no", F.md5(mask.mask_key(F.col("payload"))).alias("digest"))


@query
def extract_durations(spark, d):  # P12, P13
    p = F.col("payload")
    return tables.activity_lines(spark, d).select(
        "line_no", measure.extract_duration(p).alias("value_ms"), measure.operation_name(p).alias("operation")
    )


@query
def extract_costs(spark, d):  # P14
    return tables.activity_lines(spark, d).select(
        "line_no", measure.extract_cost(F.col("payload")).alias("c")
    ).select("line_no", "c.label", "c.amount")


@query
def extract_keys(spark, d):  # P15, P16
    p = F.col("payload")
    return tables.activity_lines(spark, d).select(
        "line_no", keys.extract_key(p).alias("key"), keys.opens_unkeyed(p).alias("opens"),
        keys.closes_unkeyed(p).alias("closes"), keys.ends_generic(p).alias("ends"), keys.closes_hard(p).alias("hard"),
    )


@query
def to_seconds(spark, d):  # P17
    clock = F.date_format("ts", "HH:mm:ss")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")
    return _events(spark, d).select(
        "event_no", parse.to_seconds(clock).alias("clock_s"),
        (parse.to_seconds(iso) * 1_000_000).cast("long").alias("instant_us"), parse.to_seconds(F.col("template_id")).alias("none_s"),
    )


@query
def component_of(spark, d):  # P18
    tag = keys.component_of(F.col("payload"), F.lit("app"))
    leaf = keys.component_of(F.regexp_replace("payload", r"\[\w+\] ", ""), F.lit("app"))
    return tables.activity_lines(spark, d).groupBy(tag.alias("component"), leaf.alias("logger")).agg(F.count(F.lit(1)).alias("n_lines"))


@query
def infer_components(spark, d):  # P19
    return tables.activity_lines(spark, d).groupBy(
        classify.infer_component(F.regexp_replace("payload", r"^.*?\] ", "")).alias("component")
    ).agg(F.count(F.lit(1)).alias("n_lines"))


@query
def name_components(spark, d):  # P20
    al = tables.activity_lines(spark, d)
    named = tracker.name_components(al.withColumn("message", F.col("payload")), profile.learn_profile(al))
    return named.groupBy("component").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def infer_transitions(spark, d):  # P21, P22
    a = _annotated(spark, d)
    return a.groupBy("transition.stage", "transition.status", "transition.label", "is_start", "is_end").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def infer_causes(spark, d):  # P23
    m = F.col("payload")
    p = tables.activity_lines(spark, d).withColumn("level", parse.parse_level(m))
    cause = classify.infer_cause(m, F.col("level"))
    return p.groupBy(cause["cause"].alias("cause"), F.size(cause["fixes"]).alias("n_fixes"), _list(classify.additional_causes(m)).alias("hints")).agg(F.count(F.lit(1)).alias("n_lines"))


@query
def detect_branches(spark, d):  # P24
    a = _annotated(spark, d)
    return a.groupBy("branch.kind", "branch.label", "skipped_component").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def evidence_lines(spark, d):  # P25
    c = tables.load(spark, d, "documents")
    return c.select("doc_id", F.md5(_list(classify.evidence_lines(F.col("text")))).alias("digest"))


@query
def error_like_events(spark, d):  # P26
    pattern = F.when(F.col("event_no") % 4 == 0, F.lit("GET <PATH> HTTP/1.1 sc5xx")).otherwise("GET <PATH> HTTP/1.1 sc2xx")
    return _events(spark, d).where(classify.error_like(F.col("level"), pattern)).select("event_no")


@query
def extract_targets(spark, d):  # P27
    pages = tables.load(spark, d, "pages")
    text = F.concat(F.col("url"), F.lit(" via localhost:"), (F.col("page_id") % 9 + 8000).cast("string"), F.lit(" and localhost:8001 "), F.col("html"))
    return pages.select("page_id", F.explode(keys.extract_targets(text)).alias("t")).select("page_id", "t.*")


@query
def cause_words(spark, d):  # P28
    docs = tables.load(spark, d, "documents")
    return docs.select("doc_id", F.md5(_list(classify.cause_tokens(F.col("text")))).alias("tokens"), F.md5(_list(classify.query_terms(F.col("text")))).alias("terms"))


@query
def step_labels(spark, d):  # P29
    return tables.load(spark, d, "documents").select("doc_id", classify.step_label(F.concat(F.lit("INFO shop.web: "), F.col("text"))).alias("label"))


# ------------------------------------------------------------------ row assembly


@query
def fold_continuations(spark, d):  # R1, R3
    e = lines.fold_continuations(lines.parse_lines(tables.mixed_lines(spark, d).where("payload <> ''")))
    return e.select("source_id", "event_no", "level", "clock", "folded_lines", F.md5("text").alias("digest"))


@query
def fold_bounded(spark, d):  # R1 with a small bound, segments far smaller than a source
    cfg = Config(max_continuation_lines=1, segment_rows=97)
    e = lines.fold_continuations(lines.parse_lines(tables.mixed_lines(spark, d).where("payload <> ''")), cfg)
    return e.select("source_id", "event_no", "folded_lines")


@query
def fold_tracker_detail(spark, d):  # R2
    e = tracker.fold_tracker_detail(tables.mixed_lines(spark, d))
    return e.select("source_id", "event_no", F.size("detail").cast("long").alias("kept"), F.col("n_detail").cast("long").alias("n_detail"))


@query
def carry_timestamp(spark, d):  # R3
    p = tables.mixed_lines(spark, d).withColumn("ts", parse.clock_text(F.col("payload")))
    return lines.carry_timestamp(p).select("source_id", "line_no", "ts_carried")


@query
def unroll_clock(spark, d):  # R4
    e = _events(spark, d).withColumn("sod", F.expr("sec % 86400").cast("double"))
    return lines.unroll_clock(e.drop("sec"), "sod").select("event_no", "day_no", F.col("sec").cast("long").alias("sec"))


@query
def mine_templates(spark, d):  # R5
    e = tables.activity_lines(spark, d).select("source_id", F.col("line_no").alias("event_no"), mask.mask_key(F.col("payload")).alias("mask"))
    t = templates.mine_templates(e)
    return t.select("source_id", "mask", "template_id", "template_pattern")


@query
def mine_document_templates(spark, d):  # R5 on high-cardinality masks
    e = tables.document_lines(spark, d).select("source_id", F.col("line_no").alias("event_no"), mask.mask_key(F.col("payload")).alias("mask"))
    t = templates.mine_templates(e)
    return t.groupBy("source_id", "template_id", "template_pattern").agg(F.count(F.lit(1)).alias("n_masks"))


@query
def flag_novel(spark, d):  # R6
    return templates.flag_novel(_events(spark, d)).where("is_novel").select("template_id", "event_no")


@query
def link_traces(spark, d):  # R7
    e = tables.mixed_lines(spark, d).where("payload <> ''").select(
        "source_id", F.col("line_no").alias("event_no"), F.col("payload").alias("text_redacted"),
        parse.seconds_of_day(parse.clock_text(F.col("payload"))).alias("sec"),
    )
    linked = traces.link_traces(e, replace(Config(), idle_timeout_s=1800.0))
    return linked.select("source_id", "event_no", "trace_id", "correlation_basis")


@query
def coverage(spark, d):  # R7, A15
    e = tables.activity_lines(spark, d).select(
        "source_id", F.col("line_no").alias("event_no"), F.col("payload").alias("text_redacted"),
        F.unix_seconds(parse.parse_timestamp(F.col("payload"))).cast("double").alias("sec"),
    )
    return traces.coverage(traces.link_traces(e))


@query
def order_events(spark, d):  # R8
    own = Window.partitionBy("trace_id").orderBy(F.col("ts").asc_nulls_last(), "event_no")
    return lines.order_events(_events(spark, d)).withColumn("nth", F.row_number().over(own).cast("long")).select("trace_id", "event_no", "nth")


@query
def segment_runs(spark, d):  # R9, A12
    return tracker.segment_runs(_annotated(spark, d)).withColumn("components", _list(F.col("components")))


@query
def skip_nodes(spark, d):  # R10
    return tracker.skip_nodes(_annotated(spark, d))


# ------------------------------------------------------------------ aggregations


@query
def template_counts(spark, d):  # A1
    c = templates.template_counts(_events(spark, d), "text_redacted")
    return c.select("template_id", "total_count", F.unix_seconds("first_seen").alias("first_s"), F.unix_seconds("last_seen").alias("last_s"), "pattern", "example")


@query
def top_templates(spark, d):  # A1
    c = templates.template_counts(_events(spark, d).withColumn("template_id", F.concat_ws("/", "template_id", "service")), "text_redacted")
    return templates.top_templates(c, 10).select("template_id", "total_count")


@query
def template_minutes(spark, d):  # A2
    return templates.template_minutes(_events(spark, d)).select("template_id", F.unix_seconds("minute").alias("minute_s"), "n_events")


@query
def template_activity(spark, d):  # A2
    m = templates.template_minutes(_events(spark, d))
    return templates.template_activity(m, ["error", "purchase"], datetime(2024, 1, 15)).select("template_id", "n_events")


@query
def duration_samples(spark, d):  # A3
    e = lines.parse_lines(tables.activity_lines(spark, d)).select(
        "source_id", F.col("line_no").alias("event_no"), "ts", F.lit("web").alias("service"), F.col("message").alias("text_redacted")
    )
    return baselines.duration_samples(e).select("component", "operation", "value_ms", "event_no")


@query
def baseline_summary(spark, d):  # A4
    b = baselines.baseline_summary(_samples(spark, d))
    return b.select("component", "operation", "n_samples", "ready", "median_ms", "p95_ms", F.unix_seconds("first_seen").alias("first_s"))


@query
def drift(spark, d):  # A5
    return baselines.drift(_samples(spark, d), replace(Config(), drift_ratio=1.2)).drop("source_id")


@query
def window_drift(spark, d):  # A5 over whole windows
    return baselines.window_drift(_samples(spark, d), replace(Config(), drift_ratio=1.05)).drop("source_id")


@query
def known_operations(spark, d):  # A6
    return baselines.known_operations(_samples(spark, d)).drop("source_id")


@query
def keep_last_n(spark, d):  # A7
    return ingest.prune_durations(_samples(spark, d), keep=50).select("component", "operation", "event_no")


@query
def mine_flow(spark, d):  # A8
    _, steps, _ = _steps(spark, d)
    return steps.select("template_id", "n_runs", "presence", "required", "median_rank", "max_duration_ms")


@query
def flow_duration(spark, d):  # A8
    _, _, spec = _steps(spark, d)
    return spec.select("traces_mined", "p50_s", "p95_s")


@query
def conversation_flow(spark, d):  # A8 on another table
    steps, _ = flow.mine_flow(tables.conversation_events(spark, d).drop("text_redacted"), HOURS)
    return steps.select("template_id", "n_runs", "presence", "required", "median_rank")


@query
def topology_edges(spark, d):  # A9
    return topology.component_edges(_events(spark, d)).drop("source_id")


@query
def topology_nodes(spark, d):  # A9
    return topology.component_nodes(_events(spark, d)).drop("source_id")


@query
def topology_ranks(spark, d):  # A9
    return topology.component_ranks(_events(spark, d)).drop("source_id")


@query
def topology_pairs(spark, d):  # A9
    return topology.component_pairs(_events(spark, d)).drop("source_id")


@query
def transition_counts(spark, d):  # A10
    return topology.transition_counts(_events(spark, d)).drop("source_id")


@query
def likely_successor(spark, d):  # A10
    return topology.likely_successor(topology.transition_counts(_events(spark, d))).drop("source_id")


@query
def lane_status(spark, d):  # A11
    return tracker.lane_status(_annotated(spark, d))


@query
def run_metrics(spark, d):  # A12
    return tracker.run_metrics(_annotated(spark, d))


@query
def learn_profile(spark, d):  # A13
    both = tables.activity_lines(spark, d).unionByName(tables.mixed_lines(spark, d))
    p = profile.learn_profile(both)
    return p.select("source_id", "lines_seen", "line_format", "timestamp_style", "has_continuations", _list(F.col("components")).alias("components"), "method", "confident")


@query
def verdict_counts(spark, d):  # A14
    return reports.verdict_counts(_verdicts(spark, d)).drop("source_id")


def _chain_input(spark, d):
    """Raw lines, what their runs are for, and thresholds; kinds of lines differ in few words, so templates must agree in more."""
    raw = tables.activity_lines(spark, d).where("payload <> ''")
    return raw, F.col("template_pattern").contains("payment completed"), replace(HOURS, similarity=0.8)


def _chain(spark, d):
    return chain.lines_to_incidents(*_chain_input(spark, d))


@query
def funnel(spark, d):  # A15
    c = _chain(spark, d)
    return reports.funnel(tables.activity_lines(spark, d), c.events, c.signals, c.lifecycle)


@query
def pipeline_incidents(spark, d):  # I1-I4 at the end of the whole chain
    c = _chain(spark, d)
    view = incidents.incident_view(c.members, c.lifecycle, HOURS)
    return view.select(
        "source_id", "incident_no", "status", "severity", "n_signals", _list(F.col("detectors")).alias("detectors"),
        "n_traces", "n_deviations", "cause_detector", "cause_why",
    )


@query
def pipeline_verdicts(spark, d):  # C3 at the end of the chain
    _, verdicts = chain.lines_to_verdicts(*_chain_input(spark, d))
    ended = F.when(F.col("verdict") == "degraded", "achieved").otherwise(F.col("verdict"))
    return verdicts.groupBy("source_id", ended.alias("verdict")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_events").alias("n_events"))


def _report(spark, d):
    runs = _verdicts(spark, d).select("source_id", "trace_id", "verdict", F.col("ended_at").alias("recorded_at"))
    return audit.audit_report(runs, _samples(spark, d).withColumn("recorded_at", F.col("ts")), AS_OF, "week")


@query
def audit_verdicts(spark, d):  # A16
    return _report(spark, d)["verdict_counts"].drop("source_id")


@query
def audit_drifts(spark, d):  # A16
    return _report(spark, d)["drifts"].select("component", "operation", "n_samples", "ratio", F.col("rank").cast("long").alias("rank"))


@query
def audit_spikes(spark, d):  # A16, W2
    return _report(spark, d)["spikes"].select("component", "operation", "value_ms", "median_ms", F.col("rank").cast("long").alias("rank"))


@query
def audit_summary(spark, d):  # A16
    return _report(spark, d)["summary"].select("total_runs", "n_notable", "n_drifts", "n_spikes", "summary")


def _labelled(spark, d):
    docs = tables.load(spark, d, "documents").select("doc_id", "source")
    marks = tables.load(spark, d, "labels")
    outcome = F.when(F.col("toxic") == 1, "wrong_diagnosis").when(F.col("quality") == 1, "worked").when(F.col("quality") == 0, "did_not_work")
    return docs.join(marks, "doc_id", "left").select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("incident_no"), F.lit("2024-01-01").alias("opened_at"),
        outcome.alias("outcome"), F.when(F.col("doc_id") % 7 == 0, "auto-verified: x").alias("outcome_note"),
    )


@query
def accuracy(spark, d):  # A17
    return memory.accuracy(_labelled(spark, d))


def _archive(spark, d):
    """One archived incident per user and week: its event kinds, services and first words."""
    e = _events(spark, d)
    return e.groupBy(
        "source_id", F.split("trace_id", "-")[0].cast("long").alias("incident_no"), F.date_trunc("week", "ts").alias("opened_at")
    ).agg(
        F.when(F.count_if(F.col("level") == "ERROR") > 2, "P2").otherwise("P3").alias("severity"),
        F.sort_array(F.collect_set("service")).alias("services"),
        F.sort_array(F.collect_set(F.when(F.col("value_ms") > 60, F.concat(F.lit("d-"), F.col("template_id"))))).alias("detectors"),
        F.sort_array(F.collect_set("template_id")).alias("templates"),
        F.min_by("text_redacted", "event_no").alias("cause"),
        F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("outcome_note"),
    ).withColumn("cause_tokens", classify.cause_tokens(F.col("cause")))


@query
def recurring_patterns(spark, d):  # A18
    return memory.recurring_patterns(_archive(spark, d)).drop("source_id")


@query
def dependency_report(spark, d):  # A19
    return reports.dependency_report(tables.activity_lines(spark, d))


@query
def gap_report(spark, d):  # A20
    ev, steps, spec = _steps(spark, d)
    linked = ev.withColumn("correlation_basis", F.when(F.col("event_no") % 3 == 0, "extracted").otherwise("none"))
    unmarked = flow.mark_purpose(steps, [])
    members = ev.where("level = 'ERROR'").withColumns({"incident_no": F.col("event_no") % 50})
    timed = ev.where("service in ('svc-1', 'svc-2')").select("source_id", "service")
    cost = ev.groupBy("source_id").agg(F.lit(True).alias("looks_like_model_app"), F.bool_or(F.col("amount") < 0).alias("sees_cost"))
    gaps = reports.gap_report(traces.coverage(linked), flow.judge_runs(ev, unmarked, spec, HOURS), unmarked, members, timed, cost)
    return gaps.select("kind", "measured")


# ------------------------------------------------------------------ windows and detectors


@query
def trailing_rate(spark, d):  # W1
    return detect.trailing_rate(_events(spark, d), HOURS).drop("source_id")


@query
def spike_vs_history(spark, d):  # W2
    s = baselines.spike_vs_history(_samples(spark, d))
    return s.select("component", "operation", "event_no", "value_ms", "median_ms", "n_samples")


@query
def hysteresis_gate(spark, d):  # W3
    e = _events(spark, d).select(
        "source_id", "event_no", "sec", (F.col("value_ms") >= 30).alias("above"), (F.col("value_ms") < 90).alias("below"), "service"
    )
    return scan.chained_fold(
        e, ["source_id", "service"], "event_no", gates.gate_step(3600, 7200), "event_no long, sec long, change string", dense=True
    ).drop("source_id")


@query
def cooldown(spark, d):  # W4
    e = _events(spark, d).where("level = 'ERROR'").select("source_id", "service", "event_no", "sec")
    return detect._cooled(e, ["source_id", "service"], 7200, HOURS).select("service", "event_no")


def _signal(df):
    return df.select("event_no", "template_id", "metric", "observed", "baseline", "severity")


@query
def detect_novelty(spark, d):  # D1
    e = _events(spark, d).withColumn("template_id", F.concat_ws("/", "template_id", "service"))
    return _signal(detect.detect_novelty(e, HOURS))


@query
def detect_rate_spike(spark, d):  # D2
    return _signal(detect.detect_rate_spike(_events(spark, d), HOURS))


@query
def rate_conditions(spark, d):  # D2 before the gate
    r = detect.rate_conditions(_events(spark, d), HOURS)
    return r.select("template_id", "sec", "observed", "usual", "above", "below")


@query
def detect_rate_drop(spark, d):  # D3
    return _signal(detect.detect_rate_drop(_events(spark, d), HOURS))


@query
def detect_silence(spark, d):  # D4
    return _signal(detect.detect_silence(_events(spark, d), HOURS))


@query
def detect_latency_shift(spark, d):  # D5
    return _signal(detect.detect_latency_shift(_events(spark, d), HOURS, _samples(spark, d)))


@query
def detect_error_ratio(spark, d):  # D6
    return _signal(detect.detect_error_ratio(_events(spark, d), HOURS))


@query
def error_conditions(spark, d):  # D6 before the gate
    r = detect.error_conditions(_events(spark, d), HOURS)
    return r.select("event_no", "observed", "usual", "above", "below")


@query
def detect_cost_anomaly(spark, d):  # D7
    return _signal(detect.detect_cost_anomaly(_events(spark, d), HOURS, _costs(spark, d)))


@query
def cost_spikes(spark, d):  # D7 before the cooldown
    return detect.cost_spikes(_costs(spark, d), HOURS).select("label", "event_no", "amount", F.col("prior").alias("usual"))


@query
def detect_absence(spark, d):  # D8
    runs = _events(spark, d).groupBy("source_id", "trace_id").agg(F.collect_set("component").alias("components"))
    s = _samples(spark, d).withColumn("component", F.col("operation"))
    out = detect_absence_rows(runs, s)
    return out.select("trace_id", F.explode("missing").alias("m")).select("trace_id", "m.component", "m.median_ms")


def detect_absence_rows(runs, samples):
    return baselines.detect_absence(runs, baselines.baseline_summary(samples))


@query
def apply_suppressions(spark, d):  # D9
    ev = _events(spark, d)
    quiet = ev.groupBy("source_id", "template_id").agg(F.avg("value_ms").alias("v")).where("v < 50").where("template_id in ('view', 'click')")
    return detect.apply_suppressions(ev, quiet).groupBy("template_id").agg(F.count(F.lit(1)).alias("n_events"))


# ------------------------------------------------------------------ runs


@query
def run_verdicts(spark, d):  # C1, C3
    v = flow.complete_runs(_verdicts(spark, d), _events(spark, d), HOURS)
    return v.select("trace_id", "verdict", "n_events", "n_errors", "duration_s")


@query
def missing_steps(spark, d):  # C2
    ev, steps, _ = _steps(spark, d)
    wanted = steps.withColumn("required", F.col("presence") >= 0.48)
    return flow.missing_steps(ev, wanted).select("trace_id", "step_id", "presence")


@query
def order_verdicts(spark, d):  # C3 on the largest tables
    ev = tables.order_events(spark, d)
    runs = ev.groupBy("source_id").agg(F.lit(None).cast("double").alias("p95_s"))
    steps = ev.select("source_id", "template_id").distinct().select(
        "*", F.col("template_id").startswith("line").alias("critical"), F.lit(False).alias("required"),
        F.col("template_id").alias("label"), F.lit(1.0).alias("presence"), F.lit(0.0).alias("median_rank"),
    )
    return reports.verdict_counts(flow.judge_runs(ev, steps, runs)).select("verdict", "n_runs")


@query
def complete_runs(spark, d):  # C4
    cfg = replace(HOURS, quiet_s=5 * 86_400.0, min_judged_events=3)
    return flow.complete_runs(_verdicts(spark, d), _events(spark, d), cfg).select("trace_id", "n_events")


@query
def conformance_signals(spark, d):  # C5
    found = flow.conformance_signals(_verdicts(spark, d))
    return found.select("trace_id", "event_no", "sec", "service", "metric", _list(F.col("evidence")).alias("evidence"))


@query
def verdict_reasons(spark, d):  # C3
    return _verdicts(spark, d).select(
        "trace_id", "reason", "service", "last_event_no", _list(F.col("evidence")).alias("evidence"),
        _list(F.transform("deviations", lambda x: F.concat_ws(";", x["type"], x["severity"], x["expected"], x["observed"]))).alias("deviations"),
    )


@query
def run_view(spark, d):  # C6
    ev, steps, _ = _steps(spark, d)
    return flow.run_view(ev, steps, 3).select(
        "trace_id", "run_events", "service", _list(F.transform("steps", lambda s: s["text"])).alias("steps"),
        _list(F.transform("expected", lambda s: s["ran"].cast("string"))).alias("ran"),
    )


# ------------------------------------------------------------------ incidents


def _members(spark, d):
    ev = _events(spark, d)
    broken = flow.conformance_signals(flow.complete_runs(_verdicts(spark, d), ev, HOURS))
    found = scan.durable(detect.detect_all(ev, HOURS, samples=_samples(spark, d), costs=_costs(spark, d), conformance=broken))
    return scan.durable(incidents.group_incidents(found, HOURS)), ev


@query
def group_incidents(spark, d):  # I1
    return _members(spark, d)[0].select("detector", "event_no", "template_id", "incident_no", "rules")


def _given_members(spark, d):
    """Incident members that need no detector: the errors of a user, one incident per week."""
    e = _events(spark, d).where("level = 'ERROR'")
    return e.select(
        "source_id", F.concat(F.split("trace_id", "-")[0], F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")).cast("long").alias("incident_no"),
        F.col("event_no").alias("signal_no"), "sec", "ts", "service", F.lit("NoveltyDetector").alias("detector"), F.lit("first").alias("metric"),
        F.when(F.col("value_ms") > 50, "P2").otherwise("P3").alias("severity"), "trace_id", "template_id",
        F.array("text_redacted", F.concat(F.lit("took "), F.col("service"))).alias("evidence"),
        F.lit(False).alias("opened"), F.lit(False).alias("recurred"), F.lit("").alias("rules"),
    )


@query
def incident_lifecycle(spark, d):  # I2
    ev = _events(spark, d)
    return incidents.incident_lifecycle(_given_members(spark, d), ev, replace(HOURS, resolve_quiet_s=86_400.0)).select(
        "incident_no", "opened_s", "last_signal_s", "n_signals", "severity", "status", "resolved_s"
    )


@query
def incident_timeline(spark, d):  # I2, I4
    members, ev = _members(spark, d)
    life = incidents.incident_lifecycle(members, ev, HOURS)
    return incidents.incident_timeline(members, life, HOURS, ended=True)


@query
def rank_cause(spark, d):  # I3
    return incidents.rank_cause(_given_members(spark, d)).select("incident_no", "cause_signal_no", "cause_line", "n_members", "n_shared", "cause_why")


@query
def incident_view(spark, d):  # I4
    ev, m = _events(spark, d), _given_members(spark, d)
    view = incidents.incident_view(m, incidents.incident_lifecycle(m, ev, HOURS), replace(HOURS, evidence_limit=5))
    return view.select("incident_no", "severity", _list(F.col("services")).alias("services"), "n_templates", "n_traces", _list(F.col("evidence")).alias("evidence"))


@query
def blast_radius(spark, d):  # I5
    ev = _events(spark, d)
    return topology.blast_radius(topology.component_pairs(ev), topology.component_ranks(ev), HOURS).drop("source_id")


@query
def most_upstream(spark, d):  # I5
    ev = _events(spark, d)
    return topology.most_upstream(ev.select("source_id", "service", "component"), topology.component_ranks(ev), ["service"], HOURS)


# ------------------------------------------------------------------ memory and verification


@query
def incident_signature(spark, d):  # M1
    s = memory.incident_signature(_given_members(spark, d))
    return s.select("incident_no", "severity", *[_list(F.col(c)).alias(c) for c in ("services", "detectors", "templates", "cause_tokens")])


@query
def archive_incidents(spark, d):  # M2
    rows = _archive(spark, d)
    known = rows.where("incident_no % 2 = 0").withColumn("outcome", F.lit("worked"))
    return memory.archive_incidents(rows, known).select("incident_no", F.unix_seconds("opened_at").alias("opened_s"), "outcome", "severity")


@query
def similar_incidents(spark, d):  # M3
    rows = _archive(spark, d)
    found = memory.similar_incidents(rows, rows)
    return found.select(
        F.col("incident_no"), F.col("precedent_no"), F.unix_seconds("precedent_opened_at").alias("precedent_s"), F.round("similarity", 3).alias("similarity")
    )


@query
def record_outcome(spark, d):  # M4
    rows = _archive(spark, d)
    marks = rows.where("severity = 'P2'").select("source_id", "incident_no", "opened_at", F.lit("worked").alias("outcome"), F.lit("kept").alias("outcome_note"))
    return memory.record_outcome(rows, marks).groupBy("outcome", "outcome_note").agg(F.count(F.lit(1)).alias("n_incidents"))


def _halves(spark, d):
    s = _samples(spark, d)
    early = s.where(F.col("ts") < F.lit(datetime(2024, 1, 15)))
    take = lambda x: verify.snapshot_operations(baselines.baseline_summary(x), baselines.known_operations(x))
    return take(early), take(s)


@query
def snapshot_fix(spark, d):  # M5
    return _halves(spark, d)[0].drop("source_id")


@query
def verify_fix(spark, d):  # M6
    return verify.verify_fix(*_halves(spark, d)).select("component", "operation", "verdict", "fresh")


def _recurrence(spark, d):
    """One incident per user and week; a template is what a user did at a service."""
    ev = _events(spark, d).withColumn("template_id", F.concat_ws("/", "template_id", "service", F.split("trace_id", "-")[0]))
    watched = ev.select("source_id", F.split("trace_id", "-")[0].cast("long").alias("incident_no"), F.date_trunc("week", "ts").alias("opened_at"), "template_id")
    before = verify.snapshot_templates(ev.where(F.col("ts") < F.lit(datetime(2024, 1, 15))))
    return verify.verify_recurrence(watched, before, verify.snapshot_templates(ev), ["incident_no", "opened_at"], replace(Config(), recur_min_before=2))


@query
def verify_recurrence(spark, d):  # M7
    return _recurrence(spark, d).withColumn("opened_at", F.unix_seconds("opened_at")).withColumnRenamed("opened_at", "opened_s").drop("source_id")


@query
def fix_headline(spark, d):  # M7
    return verify.headline(_recurrence(spark, d), verify.verify_fix(*_halves(spark, d))).groupBy("headline").agg(F.count(F.lit(1)).alias("n_incidents"))


@query
def downgrade_fixes(spark, d):  # M8
    rows = _archive(spark, d).withColumn("outcome", F.when(F.col("incident_no") % 2 == 0, "worked"))
    # the newest incident of a user was never watched
    watched = _recurrence(spark, d).where(F.col("opened_at") < F.lit(datetime(2024, 1, 22)))
    return verify.downgrade_fixes(rows, watched).select("incident_no", F.unix_seconds("opened_at").alias("opened_s"), "outcome", "outcome_note")


@query
def search_history(spark, d):  # M9
    rows = _archive(spark, d).groupBy("source_id", "incident_no").agg(F.min("cause").alias("cause"))
    return memory.search_history(rows, "purchase user 17 in").select("incident_no", "cause", "score")


@query
def search_events(spark, d):  # M10
    return reports.search_events(_events(spark, d), "ERROR by user 1").select("event_no", "text_redacted")


@query
def keyword_evidence(spark, d):  # M11
    return reports.keyword_evidence(_events(spark, d), "what was the purchase or the signup?")


def _citations(spark, d):
    c = tables.load(spark, d, "conversations")
    user = c.where("role = 'user'")
    said = user.select("conv_id", F.explode(F.split("text", "\n")).alias("line"))
    quotes = user.select("conv_id", F.col("turn").alias("claim_id"), F.substring("text", 6, 70).alias("claim"))
    claims = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("claim_id"), F.substring_index("text", "\n", 1).alias("claim")).unionByName(quotes)
    return claims, said


@query
def ground_citations(spark, d):  # M12
    claims, said = _citations(spark, d)
    return reports.ground_citations(claims, said, ["conv_id"]).select("conv_id", "claim_id", "quoted", "overlapping")


@query
def settle_hollow(spark, d):  # M12
    claims, said = _citations(spark, d)
    runs = tables.conversation_events(spark, d).select(F.col("trace_id").cast("long").alias("conv_id")).distinct().withColumn("verdict", F.lit("hollow"))
    grounded = reports.ground_citations(claims, said, ["conv_id"])
    return reports.settle_hollow(runs, grounded, ["conv_id"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n_runs"))
