"""Reading raw lines and landed connector replies, combining and sampling sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.parse import strip
from ..operators.templates import keep_last_n

# ---- fixed values: names vendors use, in order of preference -------------------------
TIME_COLUMNS = ("start_time", "timestamp", "time", "created_at", "start")
NAME_COLUMNS = ("name", "operation", "span_name", "endpoint", "tool")
DURATION_COLUMNS = ("duration_ms", "duration", "latency_ms", "elapsed_ms", "took_ms")
ERROR_COLUMNS = ("error_type", "error", "status_code", "level", "exception")
COST_COLUMNS = ("total_estimated_cost", "cost", "total_cost", "estimated_cost")
ID_COLUMNS = ("id", "trace_id", "span_id", "request_id")
SKIPPED_FIELDS = (
    "project_id", "created_at", "last_updated_at", "created_by", "last_updated_by",
    "visibility_mode", "id", "trace_id", "span_id", "parent_span_id", "start_time", "end_time",
    "input", "output", "metadata", "tags", "feedback_scores", "comments", "usage",
)
MAX_VALUE_CHARS = 60
ENVIRONMENT_KEYS = (
    "deployment.environment", "deployment.environment.name", "env", "environment", "host.name",
)
ENVIRONMENT_HINTS = (
    ("prod", "PROD"), ("uat", "UAT"), ("stag", "STAGING"), ("dev", "DEV"), ("test", "TEST"),
    ("local", "LOCAL"),
)
# ------------------------------------------------------------------------------------------


def read_log_lines(spark: SparkSession, path: str, service: str = "") -> DataFrame:
    """Non-blank lines of text files with their source file and an order key.

    ``line_no`` orders the lines of a file: byte offset of the input split first, the
    position in the split second. It needs no shuffle and no single-task numbering.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.col("_metadata.file_modification_time").alias("collected_at"),
        F.col("value").alias("payload"),
    )
    # positions grow inside a split, which is one task; 33 bits count lines there
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = raw.withColumn("line_no", F.col("__start") + in_task)
    name = F.lit(service) if service else F.regexp_extract("source_id", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return numbered.where(F.trim("payload") != "").select(
        "source_id", "line_no", "payload", name.alias("service"), "collected_at"
    )


def stream_log_lines(spark: SparkSession, folder: str, service: str = "", files_per_batch: int | None = None) -> DataFrame:
    """S1 as a stream over a folder of closed log segments, with the order key the folding needs.

    ``shop-000012.log`` is segment 12 of the source ``shop``; a file without a number is segment 0. A segment is read as one
    row and split into its lines, because a stream can number lines in no other way: close segments at some 64 MB.
    ``line_no`` holds the segment and the place in it (2^32 lines each). Segments of a source must be closed in their order."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    name = r"^(.*?)(?:[._-]([0-9]+))?(?:\.[A-Za-z]+)?$"
    file = F.col("_metadata.file_name")
    files = reader.text(folder, wholetext=True).select(
        F.regexp_extract(file, name, 1).alias("source_id"), F.coalesce(F.regexp_extract(file, name, 2).try_cast("long"), F.lit(0)).alias("segment"),
        F.col("_metadata.file_modification_time").alias("collected_at"), F.posexplode(F.split("value", "\r?\n")).alias("place", "payload"),
    )
    return files.where(F.trim("payload") != "").select(
        "source_id", (F.col("segment") * (1 << 32) + F.col("place")).alias("line_no"), "payload",
        (F.lit(service) if service else F.col("source_id")).alias("service"), "collected_at")


def combine_sources(project: str, *parts: DataFrame) -> DataFrame:
    """Secondary sources next to the primary: each keeps its own lines for folding,
    ``project_id`` is the shared key for linking and detection."""
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined.withColumn("project_id", F.lit(project))


def infer_environment(resources: Column) -> Column:
    """First usable environment attribute, else a guess from the service name with ``?``."""
    given = []
    for key in ENVIRONMENT_KEYS:
        value = strip(F.try_element_at(resources, F.lit(key)))
        given.append(F.when((value != "") & ~F.lower(value).isin("unknown", "none", "null"), value))
    name = F.lower(F.coalesce(F.try_element_at(resources, F.lit("service.name")), F.lit("")))
    guess = None
    for token, label in ENVIRONMENT_HINTS:
        cond = name.contains(token)
        guess = F.when(cond, f"{label}?") if guess is None else guess.when(cond, f"{label}?")
    return F.coalesce(*given, guess, F.lit(""))


def _pairs(record: Column, skip: bool) -> Column:
    """``k=v`` pairs of the scalars in a map<string,string> parsed from JSON."""
    def one(e: Column) -> Column:
        listed = F.array_join(
            F.filter(F.from_json(e["value"], "array<string>"), lambda x: ~x.rlike(r"^[\[{]")), ","
        )
        text = F.when(e["value"].startswith("["), listed).otherwise(F.replace(e["value"], F.lit(" "), F.lit("_")))
        keep = (
            (text != "") & (F.length(F.when(e["value"].startswith("["), listed).otherwise(e["value"])) <= MAX_VALUE_CHARS)
            & ~e["value"].contains("\\n") & ~e["value"].startswith("{")
        )
        if skip:
            keep = keep & ~e["key"].isin(*SKIPPED_FIELDS)
        return F.when(keep, F.concat(e["key"], F.lit("="), text))

    return F.array_compact(F.transform(F.map_entries(record), one))


def flatten_record(record_json: Column) -> Column:
    """Scalars of a JSON record as ``k=v`` (array), one level of nesting followed."""
    top = F.from_json(record_json, "map<string,string>")
    nested = F.flatten(F.transform(
        F.filter(F.map_entries(top), lambda e: e["value"].startswith("{") & ~e["key"].isin(*SKIPPED_FIELDS)),
        lambda e: _pairs(F.from_json(e["value"], "map<string,string>"), True),
    ))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(_pairs(top, True), none), F.coalesce(nested, none))


def normalize_connector_rows(rows: DataFrame, json: str = "row", service: str = "") -> DataFrame:
    """Landed log rows of a telemetry backend as raw lines.

    Severity and trace id come to the front of the body, attributes it does not name yet
    to its end; service and environment come from the resources.
    """
    at = lambda p: F.get_json_object(F.col(json), p)
    bag = lambda p: F.coalesce(F.from_json(at(p), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    base = rows.withColumns({
        "__body": F.coalesce(F.nullif(at("$.data.body"), F.lit("")), at("$.data.log")),
        "__s": bag("$.data.attributes_string"),
        "__n": bag("$.data.attributes_number"),
        "__r": bag("$.data.resources_string"),
        "__sev": strip(F.coalesce(at("$.data.severity_text"), F.lit(""))),
    }).where(F.coalesce("__body", F.lit("")) != "")
    trace = strip(F.coalesce(F.try_element_at("__s", F.lit("trace_id")), F.lit("")))
    text = F.concat_ws(
        " ",
        F.nullif(F.col("__sev"), F.lit("")),
        F.when(trace != "", F.concat(F.lit("trace="), trace)),
        F.col("__body"),
    )
    lined = base.withColumn("__text", text)
    extras = F.filter(
        F.concat(_pairs(F.col("__s"), True), _pairs(F.col("__n"), True)),
        lambda p: ~F.col("__text").contains(F.substring_index(p, "=", 1)),
    )
    keep = [c for c in rows.columns if c != json]
    return lined.select(
        *keep,
        F.concat_ws(" ", "__text", F.nullif(F.array_join(extras, " "), F.lit(""))).alias("payload"),
        F.coalesce(
            F.nullif(F.try_element_at("__r", F.lit("service.name")), F.lit("")),
            F.nullif(at("$.data['service.name']"), F.lit("")), F.lit(service),
        ).alias("service"),
        infer_environment(F.col("__r")).alias("host"),
        at("$.timestamp").alias("collected_at"),
    )


def query_logs(
    lines: DataFrame, service: str = "", since=None, text: str = "", limit: int | None = None,
    order: str = "line_no",
) -> DataFrame:
    """Newest matching records first; service and time reach the scan as pushed filters."""
    hits = lines
    if service:
        hits = hits.where(F.col("service") == service)
    if since is not None:
        hits = hits.where(F.col("ts") >= F.lit(since))
    if text:
        hits = hits.where(F.col("payload").contains(text))
    newest = hits.orderBy(F.col(order).desc())
    return newest if limit is None else newest.limit(limit)


def list_services(lines: DataFrame, since=None, limit: int | None = None) -> DataFrame:
    """Every service with its record count, counted rather than sampled."""
    recent = lines if since is None else lines.where(F.col("ts") >= F.lit(since))
    counted = (
        recent.where(F.col("service") != "")
        .groupBy("service")
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), "service")
    )
    return counted if limit is None else counted.limit(limit)


def fair_share_sample(lines: DataFrame, budget: int = 500, order: str = "line_no") -> DataFrame:
    """The newest ``max(20, budget // services)`` records of every service."""
    newest = Window.partitionBy("service").orderBy(F.col(order).desc())
    n = lines.select("service").distinct().agg(F.count(F.lit(1)).alias("__n"))
    share = F.greatest(F.lit(20), F.floor(F.lit(budget) / F.greatest("__n", F.lit(1))))
    # no service can get more than the whole budget, which bounds the first cut
    ranked = lines.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= max(20, budget))
    return ranked.join(F.broadcast(n), F.col("__r") <= share).drop("__r", "__n")


def dedup_polled(records: DataFrame) -> DataFrame:
    """A poll returns the window of the one before; same time and text is the same record."""
    return records.dropDuplicates(["collected_at", "payload"])


def parse_tabular_reply(replies: DataFrame, text: str = "reply") -> DataFrame:
    """A pipe-delimited table in a reply, re-emitted as log lines (one row per data row).

    The header is found in the first eight lines and names a time or a duration column;
    a reply without one yields no rows.
    """
    keys = [c for c in replies.columns if c != text]
    cells = lambda line: F.transform(F.split(strip(line), r"\s*\|\s*"), strip)
    is_header = lambda line: line.contains("|") & (F.size(cells(line)) >= 2) & F.arrays_overlap(
        F.transform(cells(line), F.lower), F.array(*[F.lit(c) for c in (*TIME_COLUMNS, *DURATION_COLUMNS)])
    )
    split = replies.withColumn("__lines", F.split(text, r"\r?\n"))
    placed = split.withColumn(
        "__at", F.array_position(F.transform(F.slice("__lines", 1, 8), is_header), F.lit(True))
    ).where("__at > 0")
    headed = placed.withColumn("__h", F.transform(cells(F.element_at("__lines", F.col("__at").cast("int"))), F.lower))
    rows = headed.select(*keys, "__at", "__h", F.posexplode("__lines").alias("row_no", "__line")).where(
        (F.col("row_no") >= F.col("__at")) & F.col("__line").contains("|")
    ).withColumn("__c", cells(F.col("__line"))).where(F.size("__c") >= F.size("__h"))

    def column(names: tuple[str, ...]) -> tuple[Column, Column]:
        present = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(F.col("__h"), n))
        name = F.get(present, F.lit(0))
        return name, F.nullif(F.get("__c", (F.array_position("__h", name) - 1).cast("int")), F.lit(""))

    duration_name, duration = column(DURATION_COLUMNS)
    error = column(ERROR_COLUMNS)[1]
    failed = error.isNotNull() & ~F.lower(error).isin("none", "null")
    unit = F.when(duration_name.contains("ms"), "ms").otherwise("s")
    line = F.concat_ws(
        " ",
        column(TIME_COLUMNS)[1],
        F.when(failed, "ERROR").otherwise("INFO"),
        F.coalesce(column(NAME_COLUMNS)[1], F.lit("operation")),
        F.when(failed, "failed").otherwise("completed"),
        F.concat(F.lit("in "), duration, unit),
        F.when(failed, F.concat(F.lit("error="), error)),
        F.concat(F.lit("cost="), column(COST_COLUMNS)[1]),
        F.concat(F.lit("trace_id="), column(ID_COLUMNS)[1]),
    )
    return rows.select(*keys, "row_no", line.alias("payload"))


def select_reply_lines(replies: DataFrame, path: str, key: str = "", text: str = "reply") -> DataFrame:
    """The list at a dotted path of a JSON reply (strings, or objects with ``key``),
    or the lines of a text found there."""
    keys = [c for c in replies.columns if c != text]
    node = F.get_json_object(F.col(text), "$" + "".join(f".{p}" for p in path.split(".") if p))
    items = F.from_json(F.when(node.startswith("["), node), "array<string>")
    picked = F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, f"$.{key}")).otherwise(x) if key else F.when(~x.startswith("{"), x))
    lines = F.coalesce(picked, F.split(node, r"\r?\n"))
    return replies.select(*keys, F.posexplode(lines).alias("row_no", "payload")).where(
        F.trim(F.coalesce("payload", F.lit(""))) != ""
    )


def enrich_with_detail(lines: DataFrame, details: DataFrame) -> DataFrame:
    """Fields of the detail record (``id``, ``record``) appended to the line with that
    ``trace_id=``; fields the line already states are left out, a line without record stays."""
    wrapped = F.coalesce(F.get_json_object("record", "$.trace"), F.col("record"))
    spans = F.from_json(F.get_json_object("record", "$.spans"), "array<string>")
    first = F.get(F.filter(spans, lambda s: F.coalesce(F.get_json_object(s, "$.model"), F.lit("")) != ""), F.lit(0))
    lifted = F.array_compact(F.array(*[
        F.when(F.get_json_object(first, f"$.{k}").isNotNull(), F.concat(F.lit(f"{k}="), F.get_json_object(first, f"$.{k}")))
        for k in ("model", "provider")
    ]))
    found = details.select("id", F.concat(flatten_record(wrapped), lifted).alias("__pairs"))
    keyed = lines.withColumn("__id", F.regexp_extract("payload", r"trace_id=(\S+)", 1))
    known = F.concat(
        F.regexp_extract_all("payload", F.lit(r"(\w+)="), F.lit(1)),
        F.array(F.lit("name"), F.lit("duration"), F.lit("total_estimated_cost")),
    )
    fresh = F.filter("__pairs", lambda p: ~F.array_contains(known, F.substring_index(p, "=", 1)))
    return (
        keyed.join(found, F.col("__id") == F.col("id"), "left")
        .withColumn("payload", F.concat_ws(" ", "payload", F.nullif(F.array_join(fresh, " "), F.lit(""))))
        .drop("__id", "id", "__pairs")
    )


def append_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("source_id",)) -> None:
    """Append facts (events, durations, runs) as Parquet, clustered by source."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Upsert of additive counters (templates, per-minute counts) by re-aggregation."""
    both = old.select(*keys, *counts).unionByName(new.select(*keys, *counts))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def prune_durations(samples: DataFrame, cfg: Config = DEFAULT, keep: int = 500) -> DataFrame:
    """A7 as a retention job: the newest samples per operation."""
    return keep_last_n(samples, ["source_id", "component", "operation"], "event_no", keep)
