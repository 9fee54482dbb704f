"""Scans of the given tables."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from runlens.sources import tables


def test_spread_evens_out_a_single_row_group_of_many_splits(spark, tmp_path):
    pq.write_table(pa.table({"n": list(range(40_000)), "s": [f"row {i * 7919}" for i in range(40_000)]}), tmp_path / "t.parquet", row_group_size=1 << 30)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = tables.load(spark, str(tmp_path), "t")
        cores = spark.sparkContext.defaultParallelism
        assert df.rdd.getNumPartitions() >= cores  # but one of them holds all rows
        rows = tables.spread(df).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sum(rows) == 40_000 and max(rows) <= 40_000 // cores


def test_order_events_of_single_row_groups_are_dealt_out(spark, tmp_path):
    day = datetime(2024, 1, 2)
    n = 20_000
    tables_ = {
        "orders": {"o_orderkey": list(range(n)), "o_orderdate": [day] * n, "o_orderstatus": ["F", "O"] * (n // 2)},
        "lineitem": {"l_orderkey": list(range(n)), "l_linenumber": [1] * n, "l_shipdate": [day] * n, "l_linestatus": ["F", "O"] * (n // 2)},
    }
    for name, columns in tables_.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet", row_group_size=1 << 30)
    events = tables.order_events(spark, str(tmp_path))
    rows = events.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(rows) == 2 * n and max(rows) <= n // spark.sparkContext.defaultParallelism
    assert events.where("level = 'ERROR'").count() == n // 2
