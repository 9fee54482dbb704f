"""Queries next to their SQL on the given tables (all of them with ALL_QUERIES=1)."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "parse_mixed_lines", "fold_continuations", "fold_tracker_detail", "mask_documents", "baseline_summary", "mine_flow",
    "topology_ranks", "run_verdicts", "missing_steps", "trailing_rate", "spike_vs_history", "detect_rate_drop",
    "error_conditions", "audit_spikes", "similar_incidents", "verify_recurrence", "ground_citations", "order_verdicts",
)
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert compare(spark, entry.queries()[name], entry.oracle_sql()[name], FOLDER).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"trace_id", "verdict", "n_events", "n_errors", "duration_s"}
