"""Segmented scans give what one window over the whole key would give."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import audit, gates
from runlens.plans import scan


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 700), ("warm", 90), ("one", 1)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 1, 2, 40])
            rows.append((key, at, rng.choice([None, rng.randint(0, 50)]), rng.random() < 0.2, round(rng.expovariate(0.02), 1)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, o long, v long, f boolean, x double").repartition(3).cache()


@pytest.mark.parametrize("size", [13, 100_000])
def test_running_equals_plain_window(table, size):
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = scan.running(table, ["k"], "o", {
        "n": scan.count(), "s": scan.total(F.col("v")), "hi": scan.highest(F.col("v")), "lo": scan.lowest(F.col("v")),
        "la": scan.last(F.col("v")), "be": scan.before(F.col("v")), "lg": scan.lag(F.col("v")), "si": scan.since(F.col("f")),
    }, size)
    rank = F.row_number().over(w)
    want = table.withColumns({
        "n": F.count(F.lit(1)).over(upto), "s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "hi": F.max("v").over(upto),
        "lo": F.min("v").over(upto), "la": F.last("v", True).over(upto),
        "be": F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "lg": F.lag("v").over(w), "__r": rank,
    }).withColumn("si", F.col("__r") - F.coalesce(F.max(F.when(F.col("f"), F.col("__r"))).over(upto), F.lit(1))).drop("__r")
    assert got.select(want.columns).exceptAll(want).count() == 0
    assert got.count() == table.count()


def test_running_reverse(table):
    w = Window.partitionBy("k").orderBy("o")
    got = scan.running(table, ["k"], "o", {"nx": scan.lag(F.col("x"))}, 13, reverse=True)
    want = table.withColumn("nx", F.lead("x").over(w))
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_exact_quantiles_with_a_hot_key(spark):
    rng = random.Random(1)
    data = {"hot": [round(rng.lognormvariate(3, 2), 2) for _ in range(5000)], "tie": [5.0] * 900 + [7.0], "few": [3.0, 1.0, 2.0, 9.0]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").repartition(4)
    got = {r.k: r for r in scan.quantile_at(df, ["k"], "v", {"m": scan.MEDIAN, "p": scan.P95_FLOOR, "u": scan.UPPER_MEDIAN}, accuracy=500).collect()}
    for k, vs in data.items():
        s, n = sorted(vs), len(vs)
        assert (got[k].n, got[k].m, got[k].p, got[k].u) == (n, statistics.median(s), s[min(n - 1, int(n * 0.95))], s[n // 2])


@pytest.mark.parametrize("how", [scan.MEDIAN, scan.UPPER_MEDIAN])
def test_sliding_equals_brute_force(table, how):
    got = {(r.k, r.o): (r.prior_n, r.prior) for r in scan.sliding(table.select("k", "o", "x"), ["k"], "o", "x", 20, how, chunk_rows=32, segment_rows=50).collect()}
    by_key = {}
    for r in table.orderBy("k", "o").collect():
        seen = by_key.setdefault(r.k, [])
        last = sorted(seen[-20:])
        want = None if not last else (last[len(last) // 2] if how == scan.UPPER_MEDIAN else statistics.median(last))
        assert got[(r.k, r.o)] == (len(last), want)
        seen.append(r.x)


@pytest.mark.parametrize("in_turn", [False, True])
def test_chained_fold_is_the_sequential_result(table, in_turn):
    rows = table.select("k", F.col("o").alias("event_no"), F.col("o").alias("sec"))
    step = gates.cooldown_step(25)
    one = scan.chained_fold(rows, ["k"], "event_no", step, "event_no long, sec long")
    cut = scan.chained_fold(rows, ["k"], "event_no", step, "event_no long, sec long", 17, in_turn=in_turn, dense=True)
    want, last = set(), {}
    for r in rows.orderBy("k", "sec").collect():
        if r.k not in last or r.sec - last[r.k] >= 25:
            last[r.k] = r.sec
            want.add((r.k, r.sec))
    assert {(r.k, r.sec) for r in one.collect()} == want == {(r.k, r.sec) for r in cut.collect()}


def test_window_spikes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(op, i, round(rng.expovariate(1 / 50) * (1 + i / 500), 2)) for op, n in (("a", 900), ("b", 40), ("c", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "operation string, event_no long, value_ms double").withColumns({"source_id": F.lit("s"), "component": F.lit("c")})
    got = {r.operation: (r.value_ms, r.median_ms) for r in audit.window_spikes(df, block_rows=70).collect()}
    for op in "abc":
        vs, worst = [r[2] for r in rows if r[0] == op], None
        for i in range(10, len(vs)):
            m = statistics.median(vs[:i])
            if vs[i] >= 3 * m and (worst is None or vs[i] / m > worst[2]):
                worst = (vs[i], m, vs[i] / m)
        assert got.get(op) == (worst[:2] if worst else None)
