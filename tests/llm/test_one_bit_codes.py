import math

import numpy as np
import pytest

from runlens.llm import one_bit_codes as ob
from runlens.llm import vector_blocks

SCHEMA = "vec_id long, embedding array<float>, is_query boolean"


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(vector_blocks, "LEAST_GROUP_ROWS", 32)


def in_order(a, b):
    total = 0.0  # sum() would compensate
    for x, y in zip(a, b):
        total += x * y
    return total


def brute(rows, k):
    best = {}
    for vec_id, v, query in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        key = (query, tuple(float(np.float32(x)) for x in v))
        if vec_id not in best or key < best[vec_id]:
            best[vec_id] = key
    out = set()
    for q, (asks, a) in best.items():
        if asks:
            scored = sorted((-in_order(a, best[o][1]), o) for o in best if o != q)
            out |= {(q, r, o, -s) for r, (s, o) in enumerate(scored[:k], 1)}
    return out


def run(spark, rows, **options):
    got = [tuple(r) for r in ob.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_recall_and_scores(spark, small_groups):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * (i % 2) + rng.normal(0, 0.5, 24)], i % 10 == 0) for i in range(600)]
    got, want = run(spark, rows), brute(rows, 20)
    assert {r[:2] for r in got} == {r[:2] for r in want}  # twenty for each query
    scores = {(q, o): s for q, _, o, s in brute(rows, 600)}
    assert all(scores[q, o] == s for q, _, o, s in got)  # exactly the measure on the original vectors
    hits = len({(q, o) for q, _, o, _ in got} & {(q, o) for q, _, o, _ in want})
    assert hits >= 0.99 * len(want)


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(6)
    x, q = rng.normal(0, 3, (2000, 64)), rng.normal(0, 1, (20, 64))
    bits = ob.code_bits(64)
    codes, scalar, length = ob.encoded(x, bits)
    unit, size = ob.units(q)
    near = ob.estimates(codes, scalar, ob.turned(unit, bits)) * length[:, None] * size
    true = x @ q.T
    room = (ob.errors(scalar, bits, 3.0) * length)[:, None] * size
    assert codes.shape == (2000, 32)
    assert (np.abs(near - true) <= room).mean() > 0.995
    assert abs((near - true).mean()) < 0.02 * np.abs(true).mean()  # without bias
    assert (near + room >= true).mean() < 1.0 or room.mean() < 3 * np.abs(true).std()


def test_bounds_read_few_vectors_and_all_neighbours():
    rng = np.random.default_rng(7)
    x, q = rng.normal(0, 1, (20_000, 64)), rng.normal(0, 1, (10, 64))
    bits = ob.code_bits(64)
    codes, scalar, length = ob.encoded(x, bits)
    unit, _ = ob.units(q)
    upper = (ob.estimates(codes, scalar, ob.turned(unit, bits)) + ob.errors(scalar, bits, ob.BOUND)[:, None]) * length[:, None]
    true = x @ unit.T
    worst = np.sort(true, axis=0)[-20]
    read = upper >= worst
    assert read[true >= worst].all() and read.mean() < 0.15


def test_edges(spark, small_groups):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], True), (2, [1.0, 2.0], True), (3, [1.0, 2.0], False), (4, [0.0, 0.0], True), (5, [], True), (6, None, True), (7, [nan, 1.0], True),
        (8, [1.0, inf], True), (9, [None, 1.0], True), (None, [5.0, 5.0], True), (10, [3.0], True), (11, [-1.0, -2.0, 0.5], True), (12, [0.5, 0.5], False),
        (12, [0.5, 0.5], False), (12, [9.0, 9.0], False), (13, [1e-30, 1e-30], True), (14, [3e38, 3e38], True),
    ]
    assert run(spark, rows) == brute(rows, 20) != set()
    assert run(spark, rows, k=2) == brute(rows, 2)
    assert run(spark, []) == set() and run(spark, rows[:1]) == set()


def test_copies_over_a_third_of_all_rows_and_clashing_columns(spark, small_groups):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else [float(np.float32(x)) for x in rng.normal(0, 1, 3)], i % 9 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "num", "rank", "score", "bucket", "v", "to", "query_id"):
        df = df.withColumn(name, df["vec_id"])
    assert {tuple(r) for r in ob.nearest(df).collect()} == brute(rows, 20)
