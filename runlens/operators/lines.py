"""From raw lines to events: parsing, folding, clocks, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, mask, parse, redact
from ..plans import scan


def truncate_long_lines(df: DataFrame, text: str = "payload", cfg: Config = DEFAULT) -> DataFrame:
    """Cut a pathological line and say so in the line."""
    n = cfg.max_line_chars
    if n is None:
        return df
    cut = F.concat(F.left(F.col(text), F.lit(n)), F.lit("…[truncated]"))
    return df.withColumn(text, F.when(F.length(text) > n, cut).otherwise(F.col(text)))


def limit_backfill(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """S3: the last ``backfill_bytes`` of each source, without the line the cut falls into."""
    size = F.octet_length("payload") + 1
    tail = scan.running(
        df, ["source_id"], "line_no", {"__tail": scan.total(size)}, cfg.segment_rows, reverse=True
    )
    return tail.where(F.col("__tail") <= cfg.backfill_bytes).drop("__tail")


def parse_lines(df: DataFrame) -> DataFrame:
    """Columns line, ts, ts_date, clock, level, message, is_cont, is_noise for every raw line."""
    raw = F.col("payload")
    out = df.withColumn("line", parse.unwrap_payload(raw))
    line = F.col("line")
    out = out.withColumns({
        "ts": parse.parse_timestamp(line),
        "ts_date": parse.date_text(line),
        "clock": parse.clock_text(line),
        "level": parse.parse_level(line),
        "message": parse.flatten_json_fields(raw, parse.parse_message(line)),
    })
    return out.withColumns({
        "is_cont": parse.is_continuation(raw) | parse.is_dump_row(F.col("message")),
        "is_noise": parse.is_noise(raw, F.col("message")),
    })


def fold_continuations(parsed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """R1 + R3: one event per head line with at most 200 folded lines; timestamps carried forward.

    The folded groups are bounded by the rule itself, and where a group starts is found
    by a prefix scan, so a source of any size is folded in parallel.
    """
    marked = scan.running(
        parsed,
        ["source_id"],
        "line_no",
        {
            "__since": scan.since(~F.col("is_cont")),
            "__anchor": scan.last(F.when(~F.col("is_cont"), F.col("line_no"))),
            "__ts": scan.last(F.col("ts")),
            "__clock": scan.last(F.col("clock")),
        },
        cfg.segment_rows,
    )
    content = parse.strip_short_scaffold(
        F.when(F.col("message") == "", parse.rstrip(F.col("payload"))).otherwise(F.col("message"))
    )
    keyed = marked.withColumn("__sub", F.expr(f"__since div {cfg.max_continuation_lines + 1}"))
    keep = [c for c in ("service", "host", "collected_at", "doc_id") if c in parsed.columns]
    first = F.struct(
        *[F.col(c) for c in keep],
        F.coalesce(F.col("ts"), F.col("__ts")).alias("ts"),
        F.coalesce(F.col("clock"), F.col("__clock")).alias("clock"),
        F.when(F.col("ts").isNotNull(), "line")
        .when(F.col("clock").isNotNull(), "clock")
        .when(F.col("__ts").isNotNull() | F.col("__clock").isNotNull(), "carried")
        .otherwise("none").alias("ts_basis"),
        F.col("level"),
        F.when(F.col("message") == "", F.col("line")).otherwise(F.col("message")).alias("head"),
    )
    events = keyed.groupBy("source_id", "__anchor", "__sub").agg(
        F.min("line_no").alias("event_no"),
        F.min_by(first, "line_no").alias("h"),
        F.array_sort(F.collect_list(F.struct("line_no", content.alias("content")))).alias("ls"),
    )
    body = F.transform(F.slice(F.col("ls"), F.lit(2), F.size("ls")), lambda x: x["content"])
    return events.select(
        "source_id",
        "event_no",
        *[F.col(f"h.{c}").alias(c) for c in (*keep, "ts", "clock", "ts_basis", "level", "head")],
        F.array_join(F.concat(F.array("h.head"), body), "\n").alias("text"),
        (F.size("ls") - 1).alias("folded_lines"),
    )


def carry_timestamp(df: DataFrame, order: str = "line_no", cfg: Config = DEFAULT) -> DataFrame:
    """Last real timestamp of the source for lines that carry none."""
    return scan.running(
        df, ["source_id"], order, {"ts_carried": scan.last(F.col("ts"))}, cfg.segment_rows
    )


def unroll_clock(df: DataFrame, seconds: str, order: str = "event_no", cfg: Config = DEFAULT) -> DataFrame:
    """Bare clocks become a growing second count; a jump back of over a minute is a new day.

    Adds ``day_no`` and ``sec`` (= day_no * 86400 + seconds); rows without a clock keep null.
    """
    # rows without a clock must not hide the one before
    known = scan.running(
        df, ["source_id"], order, {"__known": scan.before(F.col(seconds))}, cfg.segment_rows
    )
    jump = F.coalesce(F.col(seconds) + cfg.clock_jump_s < F.col("__known"), F.lit(False))
    days = scan.running(
        known.withColumn("jump", jump), ["source_id"], order,
        {"day_no": scan.total(F.col("jump").cast("long"))}, cfg.segment_rows,
    )
    return days.withColumn("sec", F.col("day_no") * 86400 + F.col(seconds)).drop("__known")


def order_events(df: DataFrame, keys: tuple[str, ...] = ("source_id", "trace_id")) -> DataFrame:
    """By time inside each run, unstamped events last in arrival order."""
    return df.orderBy(*keys, F.col("ts").asc_nulls_last(), "event_no")


def protect_and_mask(events: DataFrame, text: str = "text") -> DataFrame:
    """P10 + P11: redacted text with counts, and the masked shape of its first line."""
    out = redact.redact(events, text)
    return out.withColumn("mask", mask.mask_key(classify.head_line(F.col("text_redacted"))))


def lines_to_events(lines: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Raw lines to folded, redacted, masked events in one lazy plan."""
    kept = truncate_long_lines(lines.where(F.trim("payload") != ""), cfg=cfg)
    return protect_and_mask(fold_continuations(parse_lines(kept), cfg))
