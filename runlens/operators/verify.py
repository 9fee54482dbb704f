"""Did a fix hold? Measured before and after (M5-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

_WORST_FIRST = ("worse", "held", "unchanged", "too-early", "gone", "unknown")


def snapshot_operations(summary: DataFrame, totals: DataFrame) -> DataFrame:
    """M5: ready baselines at the moment a fix is marked, with the number of runs so far.

    ``totals``: source_id, component, operation, n_samples over all samples.
    """
    key = ["source_id", "component", "operation"]
    return summary.where("ready").select(*key, "median_ms", "p95_ms").join(
        totals.select(*key, F.col("n_samples").alias("samples")), key
    )


def snapshot_templates(events: DataFrame) -> DataFrame:
    """M5: template counts at the moment a fix is marked."""
    return events.groupBy("source_id", "template_id").agg(F.count(F.lit(1)).alias("n_events"))


def verify_fix(before: DataFrame, after: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """M6: per operation gone / too-early / unknown / held / worse / unchanged."""
    key = ["source_id", "component", "operation"]
    b = before.select(*key, *[F.col(c).alias(f"before_{c}") for c in ("median_ms", "p95_ms", "samples")])
    a = after.select(*key, *[F.col(c).alias(f"after_{c}") for c in ("median_ms", "p95_ms", "samples")])
    usable = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    median = (F.col("after_median_ms") - F.col("before_median_ms")) / F.col("before_median_ms")
    tail = F.when(
        usable("before_p95_ms") & usable("after_p95_ms"),
        (F.col("after_p95_ms") - F.col("before_p95_ms")) / F.col("before_p95_ms"),
    ).otherwise(0.0)
    fresh = F.col("after_samples") - F.col("before_samples")
    m = cfg.material_change
    verdict = (
        F.when(F.col("after_samples").isNull(), "gone")
        .when(fresh < cfg.verify_min_samples, "too-early")
        .when(~usable("before_median_ms") | ~usable("after_median_ms"), "unknown")
        .when((F.col("tail_change") <= -m) | (F.col("median_change") <= -m), "held")
        .when((F.col("tail_change") >= m) | (F.col("median_change") >= m), "worse")
        .otherwise("unchanged")
    )
    return (
        b.join(a, key, "left")
        .withColumns({"median_change": median, "tail_change": tail, "fresh": fresh})
        .withColumn("verdict", verdict)
        .withColumn("priority", F.array_position(F.array(*[F.lit(v) for v in _WORST_FIRST]), F.col("verdict")))
    )


def verify_recurrence(
    watched: DataFrame, before: DataFrame, after: DataFrame, keys: list[str], cfg: Config = DEFAULT
) -> DataFrame:
    """M7: per incident recurred / too-early / held / unknown from its templates' counts.

    ``watched``: ``keys`` + source_id + template_id (null when the incident names none);
    ``before`` / ``after``: source_id, template_id, n_events.
    """
    at = ["source_id", "template_id"]
    counts = (
        watched.distinct()
        .join(before.select(*at, F.col("n_events").alias("was")), at, "left")
        .join(after.select(*at, F.col("n_events").alias("now")), at, "left")
        .withColumns({
            "was": F.coalesce("was", F.lit(0)),
            "since": F.greatest(F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0)), F.lit(0)),
        })
    )
    named = F.col("template_id").isNotNull()
    worst = F.max_by(
        F.struct("template_id", "since"), F.when(named & (F.col("since") > 0), F.struct("since", "template_id"))
    )
    return (
        counts.groupBy(*dict.fromkeys(["source_id", *keys]))
        .agg(
            F.count_if(named).alias("n_templates"),
            F.count_if(named & (F.col("was") >= cfg.recur_min_before)).alias("n_watchable"),
            F.count_if(named & (F.col("since") > 0)).alias("n_recurred"),
            worst.alias("worst"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("n_templates") == 0, "unknown")
            .when(F.col("n_recurred") > 0, "recurred")
            .when(F.col("n_watchable") == 0, "too-early")
            .otherwise("held"),
        )
        .select(
            *dict.fromkeys(["source_id", *keys]), "verdict", "n_templates", "n_watchable",
            F.col("worst.template_id").alias("worst_template_id"), F.col("worst.since").alias("worst_since"),
        )
    )


def headline(recurrence: DataFrame, operations: DataFrame) -> DataFrame:
    """M7: the recurrence verdict, or the operations' where recurrence cannot speak."""
    speaking = (
        operations.where(F.col("verdict").isin("held", "worse"))
        .groupBy("source_id")
        .agg(F.min_by("verdict", F.struct("priority", "component", "operation")).alias("__spoken"))
    )
    silent = F.col("verdict").isin("unknown", "too-early")
    return (
        recurrence.join(speaking, "source_id", "left")
        .withColumn("headline", F.when(silent, F.coalesce("__spoken", "verdict")).otherwise(F.col("verdict")))
        .drop("__spoken")
    )


def downgrade_fixes(archive: DataFrame, recurrence: DataFrame) -> DataFrame:
    """M8: a fix marked as working whose problem came back did not work; never the reverse.

    An incident is named by source, number and opening time in both tables; one that no snapshot was taken for has no
    row in ``recurrence`` and stays as it is."""
    key = ["source_id", "incident_no", "opened_at"]
    back = recurrence.where("verdict = 'recurred'").select(
        *key,
        F.concat(
            F.lit("auto-verified: "), F.col("worst_template_id"), F.lit(" has fired "),
            F.col("worst_since").cast("string"), F.lit(" more time(s) since the fix"),
        ).alias("__note"),
    )
    hit = (F.col("outcome") == "worked") & F.col("__note").isNotNull()
    return (
        archive.join(back, key, "left")
        .withColumns({
            "outcome_note": F.when(hit, F.col("__note")).otherwise(F.col("outcome_note")),
            "outcome": F.when(hit, "did_not_work").otherwise(F.col("outcome")),
        })
        .drop("__note")
    )
