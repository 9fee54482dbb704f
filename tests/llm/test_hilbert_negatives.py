import itertools
import math

import numpy as np
import pytest

from runlens.llm import hilbert_negatives as hn
from runlens.llm import vector_blocks

SCHEMA = "vec_id long, label int, embedding array<double>, is_anchor boolean"


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(vector_blocks, "LEAST_GROUP_ROWS", 16)


def brute(rows, scale=256, positives=5, negatives=3, window=(50, 95)):
    best = {}
    for vec_id, label, v, anchor in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (label, anchor, tuple(v))
        if vec_id not in best or key < best[vec_id]:
            best[vec_id] = key
    cells = {i: [math.floor(scale * x) for x in v] for i, (_, _, v) in best.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(cells[a], cells[b]))
    out = set()
    for a, (label, anchor, _) in best.items():
        if not anchor:
            continue
        scored = sorted((-dot(a, b), b) for b in best if b != a)
        for s, p in [(-s, b) for s, b in scored if best[b][0] == label][:positives]:
            fit = [(-n, b) for n, b in scored if best[b][0] != label and window[0] * s <= -100 * n <= window[1] * s]
            out |= {(a, p, r, b, s, n) for r, (n, b) in enumerate(fit[:negatives], 1)}
    return out


def run(spark, rows, **options):
    got = [tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize(("axes", "bits"), [(1, 4), (2, 3), (3, 2), (5, 1)])
def test_curve_visits_neighbouring_cells(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = hn.curve_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_against_full_search(spark, small_groups):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(4)), [round(float(x), 1) for x in rng.normal(0, 0.5, 6)], i % 5 == 0) for i in range(160)]
    rows += [(500 + i, i % 3, [0.5] * 6, i % 10 == 0) for i in range(90)]  # copies: more than a third of all rows
    want = brute(rows)
    assert run(spark, rows) == want and len(want) > 100
    assert run(spark, rows, positives=2, negatives=1, window=(20, 70)) == brute(rows, positives=2, negatives=1, window=(20, 70))


def test_edges(spark, small_groups):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.5], True), (2, 0, [0.9, 0.4], False), (3, 1, [0.5, 0.4], False), (3, 1, [0.5, 0.4], False), (3, 2, [9.0, 9.0], False),
        (4, 1, [0.5, 0.4], True), (5, None, [1.0, 1.0], True), (6, 0, None, True), (7, 0, [1.0, nan], True), (8, 0, [inf, 1.0], True), (9, 0, [None, 1.0], True),
        (None, 0, [1.0, 1.0], True), (10, 1, [], True), (11, 0, [0.6], False), (12, 1, [0.3, 0.3, 0.3], False), (13, 2, [-1.0, -1.0], True), (14, 2, [1.0, 1.0], False),
    ]
    assert run(spark, rows) == brute(rows) != set()
    assert run(spark, []) == set() and run(spark, rows[:1]) == set()
    large = [(i, i % 2, [x * 1e5 for x in (1.0 + i, 2.0, -i / 3)], i < 3) for i in range(20)]  # scores over 2^53
    assert run(spark, large) == brute(large)
    run(spark, [(i, i % 2, [1e30 * i, 1.0], True) for i in range(9)])  # scores over a long: no crash


def test_clashing_columns(spark, small_groups):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(2)), [float(x) for x in rng.normal(0, 1, 3)], i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("grp", "num", "key", "rank", "score", "at", "windows", "bucket", "v"):
        df = df.withColumn(name, df["label"])
    assert {tuple(r) for r in hn.hard_negatives(df).collect()} == brute(rows)


def test_windows_choose_few_groups_where_the_space_has_structure(spark, monkeypatch):
    """Well separated bundles of directions: bounds leave most pairs of anchor batch and group unread."""
    monkeypatch.setattr(vector_blocks, "LEAST_GROUP_ROWS", 8)
    rng = np.random.default_rng(3)
    corners = np.eye(8) * 4
    rows = [(i, int(rng.integers(2)), [float(x) for x in corners[i % 4] + rng.normal(0, 0.01, 8)], i % 9 == 0) for i in range(400)]
    seen = []
    real = hn.chosen

    def counted(store, batches, *rest):
        out = real(store, batches, *rest)
        seen.append((out.count(), batches.count() * store.where("group_lo is not null").count()))
        return out

    monkeypatch.setattr(hn, "chosen", counted)
    assert run(spark, rows) == brute(rows)
    assert len(seen) == 2 and all(read < 0.6 * every for read, every in seen), seen
