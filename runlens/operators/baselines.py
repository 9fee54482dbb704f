"""Operation baselines: samples, medians, drift, spikes, absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import classify, measure
from ..plans import scan
from .templates import keep_last_n

OPERATION = ["source_id", "component", "operation"]


def median_of(ordered: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, (low + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def p95_of(ordered: Column) -> Column:
    """Value at index ``min(n - 1, int(0.95 n))`` of a sorted array."""
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.least(n - 1, F.floor(n * F.lit(0.95))).cast("int")))


def duration_samples(events: DataFrame, text: str = "text_redacted") -> DataFrame:
    """A3: one row per measured line (P12 + P13 on its first line)."""
    headed = events.withColumn("__head", classify.head_line(F.col(text)))
    measured = headed.withColumn("__m", measure.measurement(F.col("__head")))
    return scan.computed_once(measured).where("__m is not null").select(
        "source_id",
        F.col("service").alias("component"),
        measure.operation_name(F.col("__head"), F.col("__m.text")).alias("operation"),
        F.col("__m.value_ms").alias("value_ms"),
        "event_no",
        "ts",
    )


def recent_samples(samples: DataFrame, cfg: Config = DEFAULT, order: str = "event_no") -> DataFrame:
    """The newest ``max_samples`` values per operation as one bounded array, oldest first."""
    kept = keep_last_n(samples, OPERATION, order, cfg.max_samples)
    in_order = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value_ms").alias("v")))),
        lambda x: x["v"],
    )
    return kept.groupBy(*OPERATION).agg(in_order.alias("samples"))


def baseline_summary(samples: DataFrame, cfg: Config = DEFAULT, order: str = "event_no") -> DataFrame:
    """A4: count, ready, median and p95 of the kept samples; seen times of all samples."""
    span = samples.groupBy(*OPERATION).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    ordered = F.array_sort("samples")
    return (
        recent_samples(samples, cfg, order)
        .select(
            *OPERATION,
            F.size("samples").cast("long").alias("n_samples"),
            (F.size("samples") >= cfg.min_samples).alias("ready"),
            median_of(ordered).alias("median_ms"),
            p95_of(ordered).alias("p95_ms"),
        )
        .join(span, OPERATION)
    )


def drift(samples: DataFrame, cfg: Config = DEFAULT, order: str = "event_no") -> DataFrame:
    """A5: operations whose newer half of the kept samples left the older half behind."""
    half = F.floor(F.size("samples") / 2).cast("int")
    halves = recent_samples(samples, cfg, order).where(half >= cfg.min_samples_per_half).select(
        *OPERATION,
        F.size("samples").cast("long").alias("n_samples"),
        median_of(F.array_sort(F.slice("samples", F.lit(1), half))).alias("earlier_median_ms"),
        median_of(F.array_sort(F.slice("samples", half + 1, F.size("samples")))).alias("recent_median_ms"),
    )
    return _drifted(halves, cfg)


def _drifted(halves: DataFrame, cfg: Config) -> DataFrame:
    ratio = F.col("recent_median_ms") / F.col("earlier_median_ms")
    return (
        halves.where(F.col("earlier_median_ms") > 0)
        .withColumn("ratio", ratio)
        .where((F.col("ratio") >= cfg.drift_ratio) | (F.col("ratio") <= 1 / cfg.drift_ratio))
    )


def window_drift(samples: DataFrame, cfg: Config = DEFAULT, order: str = "event_no") -> DataFrame:
    """A5 over all samples of a report window, whatever their number: exact order
    statistics of the two halves of each operation."""
    placed = scan.numbered(samples, OPERATION, order, "pos", cfg.segment_rows)
    sizes = samples.groupBy(*OPERATION).agg(F.count(F.lit(1)).alias("n_samples"))
    sided = scan.durable(
        placed.join(sizes, OPERATION)
        .where(F.expr("n_samples div 2") >= cfg.min_samples_per_half)
        .withColumn("newer", F.col("pos") >= F.expr("n_samples div 2"))
        .select(*OPERATION, "newer", "value_ms")
    )
    medians = scan.quantile_at(sided, [*OPERATION, "newer"], "value_ms", {"m": scan.MEDIAN})
    halves = medians.groupBy(*OPERATION).agg(
        F.sum("n").alias("n_samples"),
        F.max(F.when(~F.col("newer"), F.col("m"))).alias("earlier_median_ms"),
        F.max(F.when(F.col("newer"), F.col("m"))).alias("recent_median_ms"),
    )
    return _drifted(halves, cfg)


def known_operations(samples: DataFrame) -> DataFrame:
    """Number of samples per operation."""
    return samples.groupBy(*OPERATION).agg(F.count(F.lit(1)).alias("n_samples"))


def spike_vs_history(samples: DataFrame, cfg: Config = DEFAULT, order: str = "event_no") -> DataFrame:
    """Samples at least three times the median of the (up to 200) samples before them."""
    cols = [*OPERATION, order, "value_ms", *[c for c in ("sec", "ts") if c in samples.columns]]
    prior = scan.sliding(
        samples.select(*dict.fromkeys(cols)), OPERATION, order, "value_ms", cfg.max_samples,
        scan.MEDIAN, segment_rows=cfg.segment_rows,
    )
    return (
        prior.where(
            (F.col("prior_n") >= cfg.min_samples) & (F.col("prior") > 0)
            & (F.col("value_ms") >= F.col("prior") * cfg.spike_ratio)
        )
        .withColumn("ratio", F.col("value_ms") / F.col("prior"))
        .withColumnRenamed("prior", "median_ms")
        .withColumnRenamed("prior_n", "n_samples")
    )


def detect_absence(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """Per run the ready operations whose component never appeared in it.

    ``runs`` has one row per run with the array ``components``. The operations of a
    source are one array on the joined side, so no run x operation rows are made; only
    the missing ones are listed.
    """
    expected = (
        summary.where("ready")
        .groupBy("source_id")
        .agg(
            F.array_sort(F.collect_list(F.struct(
                "component", "operation", F.col("n_samples").alias("samples"), "median_ms"
            ))).alias("expected")
        )
    )
    missing = F.filter("expected", lambda o: ~F.array_contains(F.col("components"), o["component"]))
    return (
        runs.join(expected, "source_id")
        .withColumn("missing", missing)
        .where(F.size("missing") > 0)
        .drop("expected")
    )
