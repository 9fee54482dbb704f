"""Run tracking on unkeyed logs: detail folding, run segments, skips, lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, parse
from ..plans import scan

# fixed values: which status of a lane wins
LANE_ORDER = ("completed", "skipped", "retrying", "running", "failed")
DETAIL_HEAD, DETAIL_TAIL = 4, 36


def fold_tracker_detail(lines: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """R2: like folding, but noise rows and blank lines inside a traceback join too, and an
    entry keeps its first 4 and last 36 detail lines.

    Blank lines must still be in the input.
    """
    raw = F.col("payload")
    unwrapped = parse.unwrap_keeping_indent(raw)
    base = lines.withColumns({"line": parse.unwrap_payload(raw), "__text": unwrapped})
    base = base.withColumns({
        "message": parse.parse_message(F.col("line")),
        "level": parse.parse_level(F.col("line")),
        "__blank": parse.strip(F.col("__text")) == "",
        "__cont": parse.is_continuation(F.col("__text")),
    })
    # a blank continues iff the last non-blank line did: blanks take over its answer
    carried = scan.durable(scan.running(
        scan.durable(base), ["source_id"], "line_no",
        {"__open": scan.last(F.when(~F.col("__blank"), F.col("__cont")))}, cfg.segment_rows,
    ))
    noise = parse.is_noise(raw, F.col("message")) & ~F.col("__blank")
    folds = F.when(F.col("__blank"), F.coalesce("__open", F.lit(False))).otherwise(F.col("__cont") | noise)
    # detail lines ahead of the first entry have nothing to join; a noise row may open one
    opened = carried.where(~F.col("__blank") & ~F.col("__cont")).groupBy("source_id").agg(
        F.min("line_no").alias("__opened")
    )
    kept = (
        carried.withColumn("__folds", folds)
        .where(~F.col("__blank") | F.col("__folds"))
        .join(opened, "source_id")
        .where(F.col("line_no") >= F.col("__opened"))
        .withColumn("__folds", F.col("__folds") & (F.col("line_no") > F.col("__opened")))
    )
    grouped = scan.running(
        scan.durable(kept), ["source_id"], "line_no",
        {"__i": scan.since(~F.col("__folds")), "__anchor": scan.last(F.when(~F.col("__folds"), F.col("line_no")))},
        cfg.segment_rows,
    )
    behind = scan.running(
        scan.durable(grouped.select(
            "source_id", "line_no", "__i", "__anchor", "__text", "line", "message", "level", "__folds"
        )),
        ["source_id"], "line_no", {"__next": scan.lag(F.col("__i"))}, cfg.segment_rows, reverse=True,
    )
    # length of an entry is read off its last row, so the middle is dropped before any group is built
    ends = behind.where(F.col("__next").isNull() | (F.col("__next") == 0)).select(
        "source_id", "__anchor", F.col("__i").alias("n_detail")
    )
    slim = behind.join(ends, ["source_id", "__anchor"]).where(
        (F.col("__i") <= DETAIL_HEAD) | (F.col("__i") > F.col("n_detail") - DETAIL_TAIL)
        | (F.col("n_detail") <= DETAIL_HEAD + DETAIL_TAIL)
    )
    detail = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("__folds"), F.struct("line_no", F.col("__text").alias("t"))))),
        lambda x: x["t"],
    )
    return slim.groupBy("source_id", "__anchor").agg(
        F.min("line_no").alias("event_no"),
        F.min_by("message", "line_no").alias("message"),
        F.min_by("level", "line_no").alias("level"),
        F.min_by("line", "line_no").alias("raw_line"),
        F.max("n_detail").alias("n_detail"),
        detail.alias("detail"),
    ).drop("__anchor")


def annotate_events(events: DataFrame, message: str = "message") -> DataFrame:
    """P19-P24 as columns: component, transition, branch, skipped, run start, completion, cause."""
    m = F.col(message)
    step = classify.infer_transition(m)
    out = events if "component" in events.columns else events.withColumn("component", classify.infer_component(m))
    return out.withColumns({
        "transition": step,
        "branch": classify.detect_branch(m),
        "skipped_component": classify.infer_skipped(m),
        "is_start": classify.is_run_start(m),
        "is_end": classify.is_completion(m),
        "cause": classify.infer_cause(m, F.col("level")),
    })


def segment_runs(annotated: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """R9 + A12: runs between an opening line and its completion (or the next opening).

    One row per run: events, failures, retries, skips, components, status, reason.
    """
    narrow = scan.durable(annotated.select(
        "source_id", "event_no", "component", "transition", "skipped_component", "is_start", "is_end", "cause",
    ))
    numbered = scan.running(
        narrow, ["source_id"], "event_no", {"run_no": scan.total(F.col("is_start").cast("long"))},
        cfg.segment_rows,
    ).where("run_no > 0")
    run = ["source_id", "run_no"]
    ends = numbered.where("is_end").groupBy(*run).agg(F.min("event_no").alias("end_no"))
    inside = numbered.join(ends, run, "left").where(
        F.col("end_no").isNull() | (F.col("event_no") <= F.col("end_no"))
    )
    status = F.col("transition.status")
    code = classify.severity_code(status)
    failed = (status == "failed") | F.col("cause").isNotNull()
    runs = inside.groupBy(*run).agg(
        F.min("event_no").alias("start_no"),
        F.max("end_no").alias("end_no"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(status == "failed").alias("failures"),
        F.count_if(status == "retrying").alias("retries"),
        F.count_if(F.col("skipped_component").isNotNull()).alias("skipped"),
        F.array_sort(F.collect_set("component")).alias("components"),
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("__failed"),
        F.max_by(status, F.when(status.isNotNull(), F.struct(code, "event_no"))).alias("__worst"),
        F.max_by("cause.cause", F.when(F.col("cause").isNotNull(), F.col("event_no"))).alias("__cause"),
    )
    done = F.col("end_no").isNotNull()
    return runs.select(
        *run, "start_no", "end_no", "n_events", "failures", "retries", "skipped", "components",
        F.when(F.col("__failed"), "failed").when(done, "success").otherwise(F.coalesce("__worst", F.lit("running"))).alias("status"),
        F.coalesce(
            "__cause",
            F.when(~F.col("__failed") & done, "Execution completed successfully.")
            .when(done, "The run reached its end, but a step failed.")
            .otherwise("Run in progress."),
        ).alias("reason"),
    )


def skip_nodes(annotated: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """On a line that leaves the main path, the component most likely to follow the
    previous one (by the transitions seen so far) counts as skipped.

    The leader of a component's successors is a running maximum of (count, seniority):
    counts only grow, so the greatest pair reached so far is the present leader.
    """
    cols = scan.durable(annotated.select("source_id", "event_no", "component", "branch"))
    stepped = scan.durable(scan.running(
        cols, ["source_id"], "event_no", {"before": scan.lag(F.col("component"))}, cfg.segment_rows
    ).where("before is not null"))
    move = ["source_id", "before", "component"]
    moves = scan.running(
        stepped.where("before <> component").select(*move, "event_no"), move, "event_no",
        {"n": scan.count(), "first_no": scan.lowest(F.col("event_no"))}, cfg.segment_rows,
    )
    known = stepped.join(moves.select("source_id", "event_no", "n", "first_no"), ["source_id", "event_no"], "left")
    standing = F.when(
        F.col("n").isNotNull(), F.struct("n", (-F.col("first_no")).alias("seniority"), F.col("component").alias("to"))
    )
    led = scan.running(
        scan.durable(known), ["source_id", "before"], "event_no", {"leader": scan.highest(standing)}, cfg.segment_rows
    )
    expected = F.col("leader.to")
    return led.where("branch is not null").select(
        "source_id", "event_no", "component", F.col("before").alias("previous"),
        F.col("branch.kind").alias("branch_kind"),
        F.when(expected.isNotNull() & (expected != F.col("component")), expected).otherwise(F.col("before")).alias("skipped"),
    )


def lane_status(annotated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per component the status that weighs most: failed, running, retrying, skipped, completed."""
    status = F.coalesce(
        F.col("transition.status"), F.when(F.col("level") == "ERROR", "failed").otherwise("observed")
    )
    lanes = F.array(*[F.lit(x) for x in LANE_ORDER])
    code = F.greatest(F.array_position(lanes, status), F.lit(1))
    return annotated.groupBy(*(keys or ["source_id"]), "component").agg(
        F.get(lanes, F.max(code).cast("int") - 1).alias("status"), F.count(F.lit(1)).alias("node_count")
    )


def run_metrics(annotated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Events, failures, retries and skips."""
    status = F.col("transition.status")
    return annotated.groupBy(*(keys or ["source_id"])).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(status == "failed").alias("failures"),
        F.count_if(status == "retrying").alias("retries"),
        F.count_if(F.col("skipped_component").isNotNull()).alias("skipped"),
    )


def name_components(lines: DataFrame, profiles: DataFrame, raw: str = "payload", message: str = "message") -> DataFrame:
    """P20 over a table: ``component`` from the learned profile of the source."""
    known = profiles.select("source_id", F.col("components").alias("__known"))
    return (
        lines.join(known, "source_id", "left")
        .withColumn("component", classify.component_for(F.col(raw), F.col(message), F.col("__known")))
        .drop("__known")
    )
