"""Columns over raw log lines: unwrapping, timestamps, levels, continuation tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: formats a log line is recognised by --------------------------
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]"
MESSAGE_KEYS = ("line", "message", "msg", "log", "text", "event")
LEVEL_KEYS = ("level", "levelname", "severity")
META_KEYS = (
    "level", "severity", "time", "timestamp", "ts", "@timestamp", "msg", "message",
    "log", "logger", "name", "hostname", "pid", "v",
)
PAYLOAD_LEVEL = r"(?iU)\b(INFO|WARN|WARNING|ERROR|DEBUG|TRACE)\b"
LEVELS = "INFO|WARN|WARNING|ERROR|DEBUG|TRACE|CRITICAL|FATAL|SUCCESS"
LEVEL_WORD = rf"(?U)\b({LEVELS})\b"
STAMP = (
    r"^\s*(?:(\d{4}-\d{2}-\d{2})[ T])?(\d{1,2}:\d{2}:\d{2})([.,]\d{1,6})?"
    r"(Z|[+-]\d{2}:?\d{2})?\s*"
)
SCAFFOLD_PIPED = rf"(?iU)^\s*\|?\s*(?:{LEVELS})\s*\|\s*[\w.]+:[\w.<>]+:\d+\s*[-—]\s*"
SCAFFOLD_SHORT = rf"(?iU)^\s*(?:{LEVELS})\s+[\w.]+:\s*"
LEVEL_HINTS = (
    ("ERROR", r"(?i)error|failed|timeout|exception|refused|denied|unreachable"),
    ("WARN", r"(?i)warn"),
    ("DEBUG", r"(?i)debug|trace"),
)
NEW_ENTRY = (
    r"(?iU)^\s*(?:\d{4}-\d{2}-\d{2}[ T])?\d{1,2}:\d{2}:\d{2}"
    r"|^\s*(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|CRITICAL|FATAL)\b"
)
CONTINUATION = (
    r"(?U)^\s*Traceback \(most recent call last\):"
    r'|^\s*>?\s*File "[^"]+", line \d+'
    r"|^\s*(?:at|Caused by:|\.\.\.)\s+\S"
    r"|^\s*\w+(?:\.\w+)*(?:Error|Exception)\b.*"
    r"|^\s{2,}\S"
)
DUMP_ROW = r"^(?:[─-╿]|[}\]],?$)"
DUMP_START = r"^[┌╭]"
NOISE = r"(?i)[─-╿]|\[(?:hdr|header|headers|body|payload|req|res|dump|raw)\]"
LOGGER_ONLY = r"(?U)^\s*[\w.]+:?\s*$"
# ---------------------------------------------------------------------------------

_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` (null when there is none)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def strip_ansi(text: Column) -> Column:
    """Drop terminal colour codes."""
    return F.regexp_replace(text, ANSI, "")


def _looks_json(text: Column) -> Column:
    return text.startswith("{") & text.endswith("}")


def json_object(text: Column) -> Column:
    """VARIANT of a line that is a JSON object, else null."""
    parsed = F.try_parse_json(text)
    return F.when(_looks_json(text), parsed)


def _string_at(payload: Column, key: str) -> Column:
    part = F.try_variant_get(payload, f"$.{key}", "variant")
    return F.when(
        F.schema_of_variant(part) == "STRING", F.try_variant_get(payload, f"$.{key}", "string")
    )


def unwrap_payload(raw: Column) -> Column:
    """Log text inside a JSON wrapper, with its level put in front when the text has none."""
    line = strip(strip_ansi(raw))
    payload = json_object(line)
    text = F.coalesce(*[_string_at(payload, k) for k in MESSAGE_KEYS])
    level = F.coalesce(
        *[F.nullif(F.try_variant_get(payload, f"$.{k}", "string"), F.lit("")) for k in LEVEL_KEYS]
    )
    is_text = F.coalesce(*[
        F.when(
            F.nullif(F.try_variant_get(payload, f"$.{k}", "string"), F.lit("")).isNotNull(),
            _string_at(payload, k).isNotNull(),
        )
        for k in LEVEL_KEYS
    ])
    body = strip(text)
    return (
        F.when(~_looks_json(line) | text.isNull(), line)
        .when(body == "", F.lit(""))
        .when(
            level.isNotNull() & is_text & ~text.rlike(PAYLOAD_LEVEL),
            F.concat(F.upper(level), F.lit(" "), body),
        )
        .otherwise(body)
    )


def unwrap_keeping_indent(raw: Column) -> Column:
    """P2, second form: the leading blanks survive, they tell a stack frame."""
    text = strip_ansi(raw)
    inner = F.coalesce(*[_string_at(json_object(strip(text)), k) for k in MESSAGE_KEYS])
    return rstrip(F.coalesce(inner, text))


def clock_text(line: Column) -> Column:
    """``HH:MM:SS`` at the start of the line, zero-padded, else null."""
    return F.lpad(found(line, STAMP, 2), 8, "0")


def date_text(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, STAMP, 1), F.lit(""))


def parse_timestamp(line: Column) -> Column:
    """Full instant when the line carries a date, else null."""
    date, clock = date_text(line), clock_text(line)
    frac = F.replace(F.regexp_extract(line, STAMP, 3), F.lit(","), F.lit("."))
    zone = F.regexp_extract(line, STAMP, 4)
    return F.when(
        date.isNotNull(), F.try_to_timestamp(F.concat(date, F.lit(" "), clock, frac, zone))
    )


def seconds_of_day(clock: Column) -> Column:
    part = F.split(clock, ":")
    return (
        part[0].try_cast("double") * 3600 + part[1].try_cast("double") * 60 + part[2].try_cast("double")
    )


def to_seconds(text: Column) -> Column:
    """Clock or ISO instant -> seconds; null when it is neither."""
    iso = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    instant = F.unix_micros(F.try_to_timestamp(iso)) / F.lit(1_000_000.0)
    clean = strip(text)
    return F.when(clean.rlike(r"^.{0,10}-.*T"), instant).when(
        F.size(F.split(clean, ":")) == 3, seconds_of_day(clean)
    )


def strip_scaffold(text: Column) -> Column:
    """``| LEVEL | module:function:line -`` in front of the message."""
    return F.regexp_replace(text, SCAFFOLD_PIPED, "")


def strip_short_scaffold(text: Column) -> Column:
    """``LEVEL logger:`` in front of the message."""
    return F.regexp_replace(text, SCAFFOLD_SHORT, "")


def parse_level(line: Column) -> Column:
    """P5: level word in the line, else inferred from its vocabulary."""
    word = found(line, LEVEL_WORD)
    inferred = F.lit("INFO")
    for level, pattern in reversed(LEVEL_HINTS):
        inferred = F.when(line.rlike(pattern), level).otherwise(inferred)
    return (
        F.when(word.isNull(), inferred)
        .when(word == "WARNING", "WARN")
        .when(word.isin("CRITICAL", "FATAL"), "ERROR")
        .when(word == "SUCCESS", "INFO")
        .otherwise(word)
    )


def parse_message(line: Column) -> Column:
    """What a human wrote: the unwrapped line without timestamp and logger scaffold."""
    body = strip(strip_scaffold(F.regexp_replace(line, STAMP, "")))
    return F.when(body == "", strip(line)).otherwise(body)


def flatten_json_fields(raw: Column, message: Column) -> Column:
    """Scalar fields of a JSON line that are not log metadata, appended as ``k=v``."""
    line = strip(raw)
    texts = F.from_json(F.when(_looks_json(line), line), "map<string,string>")
    typed = json_object(line).cast("map<string,variant>")
    entries = F.filter(
        F.map_entries(texts),
        lambda e: ~F.lower(e["key"]).isin(*META_KEYS)
        & e["value"].isNotNull()
        & ~F.schema_of_variant(typed[e["key"]]).rlike("^(OBJECT|ARRAY|VOID)"),
    )
    pairs = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "
    )
    return F.when(
        F.coalesce(pairs, F.lit("")) == "", message
    ).otherwise(strip(F.concat(message, F.lit(" "), pairs)))


def is_continuation(raw: Column) -> Column:
    """The line belongs to the entry above it."""
    text = rstrip(strip_ansi(raw))
    return (strip(text) != "") & ~text.rlike(NEW_ENTRY) & text.rlike(CONTINUATION)


def is_dump_start(message: Column) -> Column:
    """Top-left corner, the title row of a printed box."""
    return strip(strip_short_scaffold(message)).rlike(DUMP_START)


def is_dump_row(message: Column) -> Column:
    """A row of a printed box, or a lone closing brace."""
    content = strip(strip_short_scaffold(message))
    return content.rlike(DUMP_ROW) & ~content.rlike(DUMP_START)


def is_noise(raw: Column, message: Column) -> Column:
    """Dump scaffolding, or nothing but a logger prefix."""
    body = strip(message)
    return (
        strip_ansi(raw).rlike(NOISE) | message.rlike(NOISE) | (body == "") | body.rlike(LOGGER_ONLY)
    )
