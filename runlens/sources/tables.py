"""Reading the given tables, and deriving log lines and events from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan of fewer files than there are cores, for work that costs or shuffles more than the reading.

    The splits of a file do not tell where its rows are: each of its row groups is read by one task, and there may
    be a single one whatever its size. A scan of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, df.rdd.getNumPartitions())) if len(df.inputFiles()) < cores else df


def _as_instant(name: str) -> Column:
    return F.col(name).cast("timestamp")


def activity_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as engine events: one run per user and day."""
    e = load(spark, folder, "events")
    ts = _as_instant("ts")
    return e.select(
        F.lit("activity").alias("source_id"),
        F.col("event_id").alias("event_no"),
        ts.alias("ts"),
        F.floor(F.unix_micros(ts) / 1_000_000).alias("sec"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("event_type").alias("template_id"),
        F.col("event_type").alias("component"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(ts, "yyyyMMdd")).alias("trace_id"),
        F.col("value").alias("value_ms"),
        F.get_json_object("props", "$.k").cast("double").alias("amount"),
        F.concat_ws(
            " ", F.col("event_type"), F.lit("by user"), F.col("user_id").cast("string")
        ).alias("text_redacted"),
    )


def activity_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` written as log lines: clock, level, logger, tag, run key, duration, tokens."""
    e = spread(load(spark, folder, "events"))
    ts = _as_instant("ts")
    return e.select(
        F.lit("activity").alias("source_id"),
        F.col("event_id").alias("line_no"),
        F.concat(
            F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
            F.when(F.col("event_type") == "error", " ERROR").otherwise(" INFO"),
            F.lit(" shop.web: ["), F.col("event_type"), F.lit("] "),
            F.when(F.col("event_type") == "error", "request failed: connection refused by http://db-")
            .when(F.col("event_type") == "signup", "request received from http://app-")
            .when(F.col("event_type") == "purchase", "payment completed via http://pay-")
            .otherwise("page served to http://cdn-"),
            (F.col("user_id") % 5).cast("string"), F.lit(":8080/x run_id=u"),
            F.col("user_id").cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd"),
            F.lit(" total_tokens="), F.get_json_object("props", "$.k"),
            F.lit(" in "), F.col("value").cast("string"), F.lit("ms"),
        ).alias("payload"),
    )


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as raw lines: one source per document source, whole texts.

    ``line_no`` is unique inside the source: document number and line number share it.
    """
    d = spread(load(spark, folder, "documents"))
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "payload")).select(
        F.col("source").alias("source_id"),
        (F.col("doc_id") * 1_000_000 + F.col("i")).alias("line_no"),
        "doc_id",
        "payload",
    )


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` and ``lineitem`` as runs: placing the order, then its lines."""
    o = spread(load(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")).select(
        F.lit("orders").alias("source_id"),
        F.col("o_orderkey").cast("string").alias("trace_id"),
        (F.col("o_orderkey") * 100).alias("event_no"),
        _as_instant("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "ERROR").otherwise("INFO").alias("level"),
        F.lit("placed").alias("template_id"),
    )
    li = spread(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus")).select(
        F.lit("orders").alias("source_id"),
        F.col("l_orderkey").cast("string").alias("trace_id"),
        (F.col("l_orderkey") * 100 + 1 + F.col("l_linenumber")).alias("event_no"),
        _as_instant("l_shipdate").alias("ts"),
        F.lit("INFO").alias("level"),
        F.concat(F.lit("line:"), F.col("l_linestatus")).alias("template_id"),
    )
    return o.unionByName(li)


def conversation_events(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as runs: one per conversation, one step kind per role."""
    c = load(spark, folder, "conversations")
    return c.select(
        F.lit("chat").alias("source_id"),
        F.col("conv_id").cast("string").alias("trace_id"),
        (F.col("conv_id") * 10_000 + F.col("turn")).alias("event_no"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit("INFO").alias("level"),
        F.col("role").alias("template_id"),
        F.col("role").alias("component"),
        F.col("text").alias("text_redacted"),
    )


def mixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` written as a log with tracebacks, JVM frames, printed boxes, JSON and blanks.

    Every event is one line; its kind follows from its number, so order matters as it
    does in a real log.
    """
    e = spread(load(spark, folder, "events"))
    ts = _as_instant("ts")
    no, user = F.col("event_id"), F.col("user_id").cast("string")
    kind = F.pmod(no * 7 + F.col("user_id"), F.lit(12))
    stamp = F.date_format(ts, "HH:mm:ss")
    plain = F.concat(
        stamp, F.when(F.col("event_type") == "error", " ERROR shop.web: ").otherwise(" INFO shop.web: "),
        F.when(F.col("event_type") == "signup", "request received from user ")
        .when(F.col("event_type") == "purchase", "response sent to user ")
        .when(F.col("event_type") == "error", "lookup failed, retry for user ")
        .when(F.col("event_type") == "view", "retrieve page for user ")
        .otherwise("parsing input of user "),
        user,
    )
    return e.select(
        F.concat(F.lit("web-"), F.pmod("user_id", F.lit(3)).cast("string")).alias("source_id"),
        no.alias("line_no"),
        F.when(kind == 0, F.concat(F.lit('  File "shop/cart'), user, F.lit('.py", line 12, in add')))
        .when(kind == 1, F.concat(F.lit("    at shop.Cart.add(Cart.java:"), user, F.lit(")")))
        .when(kind == 2, F.concat(F.lit("ValueError: bad item "), user))
        .when(kind == 3, F.concat(stamp, F.lit(" INFO shop.web: │ item "), user))
        .when(kind == 4, F.concat(stamp, F.lit(" INFO shop.web: ┌ cart of "), user))
        .when(kind == 5, F.concat(F.lit('{"level":"warn","msg":"slow answer","userNo":'), user, F.lit(',"took":"long"}')))
        .when(kind == 6, F.lit(""))
        .otherwise(plain)
        .alias("payload"),
    )
