"""What runs before what: components of runs, transitions, blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..plans import scan
from .flow import RUN, first_positions


def component_nodes(events: DataFrame) -> DataFrame:
    """Events of runs per component."""
    return (
        events.where(F.col("trace_id").isNotNull())
        .groupBy("source_id", "component")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def component_edges(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Changes from one component to the next inside a run."""
    linked = events.where(F.col("trace_id").isNotNull()).select(*RUN, "event_no", "component")
    stepped = scan.running(
        linked, RUN, "event_no", {"before": scan.lag(F.col("component"))}, cfg.segment_rows
    )
    return (
        stepped.where(F.col("before") != F.col("component"))
        .groupBy("source_id", F.col("before").alias("from_component"), F.col("component").alias("to_component"))
        .agg(F.count(F.lit(1)).alias("n_transitions"))
    )


def component_ranks(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Upper median of the position at which a component first enters its runs."""
    positions = scan.durable(first_positions(events, "component", cfg))
    return scan.quantile_at(
        positions, ["source_id", "component"], "position", {"rank": scan.UPPER_MEDIAN}
    ).withColumnRenamed("n", "n_runs")


def component_pairs(events: DataFrame) -> DataFrame:
    """Components that share a run. Runs are reduced to distinct component sets
    before pairs are formed, so a million equal runs give their pairs once."""
    sets = (
        events.where(F.col("trace_id").isNotNull())
        .groupBy(*RUN)
        .agg(F.array_sort(F.collect_set("component")).alias("members"))
        .groupBy("source_id", "members")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = sets.select(
        "source_id", "n", F.explode("members").alias("component"), F.col("members")
    ).select("source_id", "n", "component", F.explode("members").alias("other"))
    return (
        pairs.where(F.col("component") != F.col("other"))
        .groupBy("source_id", "component", "other")
        .agg(F.sum("n").alias("n_runs"))
    )


def blast_radius(pairs: DataFrame, ranks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """For every component the ones that clearly enter shared runs after or before it."""
    own = ranks.select("source_id", "component", F.col("rank").alias("own_rank"))
    other = ranks.select("source_id", F.col("component").alias("other"), F.col("rank").alias("other_rank"))
    side = F.when(F.col("own_rank") + cfg.rank_margin < F.col("other_rank"), "downstream").when(
        F.col("other_rank") + cfg.rank_margin < F.col("own_rank"), "upstream"
    )
    return (
        pairs.join(own, ["source_id", "component"])
        .join(other, ["source_id", "other"])
        .withColumn("side", side)
        .where(F.col("side").isNotNull())
        .select("source_id", "component", "other", "side")
    )


def most_upstream(members: DataFrame, ranks: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """The member of each group every other member sits downstream of; null inside the margin.

    ``members`` has ``keys``, ``source_id`` and ``component``.
    """
    ranked = members.select(*keys, "source_id", "component").distinct().join(
        ranks.select("source_id", "component", "rank"), ["source_id", "component"]
    )
    order = Window.partitionBy(*keys).orderBy("rank", "component")
    two = (
        ranked.withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") <= 2)
        .groupBy(*keys)
        .agg(
            F.min_by("component", "__r").alias("first"),
            F.min("rank").alias("a"),
            F.max("rank").alias("b"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    clear = (F.col("n") == 1) | (F.col("b") - F.col("a") > cfg.rank_margin)
    return two.select(*keys, F.when(clear, F.col("first")).alias("most_upstream"))


def transition_counts(events: DataFrame, keys: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """A10: how often one component follows another in arrival order, and since when."""
    keys = keys or ["source_id"]
    stepped = scan.running(
        events.select(*keys, "event_no", "component"), keys, "event_no",
        {"before": scan.lag(F.col("component"))}, cfg.segment_rows,
    )
    return (
        stepped.where(F.col("before") != F.col("component"))
        .groupBy(*keys, F.col("before").alias("from_component"), F.col("component").alias("to_component"))
        .agg(F.count(F.lit(1)).alias("n_transitions"), F.min("event_no").alias("first_no"))
    )


def likely_successor(transitions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A10: the most frequent next component; ties go to the one seen first."""
    best = F.max_by(
        F.struct("to_component", "n_transitions"), F.struct("n_transitions", -F.col("first_no"))
    )
    return (
        transitions.groupBy(*(keys or ["source_id"]), "from_component")
        .agg(best.alias("b"))
        .select(*(keys or ["source_id"]), "from_component", "b.to_component", "b.n_transitions")
    )
