"""Precedents against all pairs compared one by one."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from runlens.operators import memory

SCHEMA = "source_id string, incident_no long, at long, templates array<string>, cause_tokens array<string>, detectors array<string>, services array<string>, severity string, cause string, outcome string"


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def brute(asked, archive, top=3):
    out = []
    for q in asked:
        found = []
        for p in archive:
            if q[0] != p[0] or q[1:3] == p[1:3]:
                continue
            s = 0.0  # sum() would compensate
            for i, w in ((3, 0.35), (4, 0.25), (5, 0.2), (6, 0.1)):
                s += w * jaccard(q[i], p[i])
            s = float(Decimal(repr(s + 0.1 * (q[7] == p[7] != ""))).quantize(Decimal("0.001"), ROUND_HALF_UP))
            if s >= 0.35:
                found.append((-s, -p[2], -p[1]))
        out += [(q[0], q[1], r, -no, -at, -s) for r, (s, at, no) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(seed, n, sources=2, stray=0.5):
    """Families of incidents that share a common word and template with all others; some stray from their family."""
    rng = random.Random(seed)
    some = lambda kind, k, of: sorted({f"{kind}{rng.randrange(of)}" for _ in range(k)})
    families = [(some("t", 4, 60), some("w", 4, 80), some("d", 2, 8), some("s", 1, 6)) for _ in range(12)]
    rows = []
    for i in range(n):
        t, w, d, s = rng.choice(families)
        if rng.random() < stray:
            t, w, d = t[: rng.randint(0, 4)] + some("t", rng.randint(0, 2), 60), w[: rng.randint(0, 4)], some("d", rng.randint(0, 3), 8)
        t, w = sorted({*t, *(["t-all"] if rng.random() < 0.95 else [])}), sorted({*w, *(["w-all"] if rng.random() < 0.95 else [])})
        rows.append((f"p{i % sources}", i, 1000 + rng.randrange(n), t, w, d, s, rng.choice(["P2", "P2", "P3", ""]), "", None))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("opened_at", F.timestamp_seconds("at"))


def asked_of(spark, asked, archive):
    got = memory.similar_incidents(table(spark, asked), table(spark, archive))
    return sorted((r.source_id, r.incident_no, r["rank"], r.precedent_no, int(r.precedent_opened_at.timestamp()), float(Decimal(repr(r.similarity)).quantize(Decimal("0.001"), ROUND_HALF_UP))) for r in got.collect())


@pytest.mark.parametrize("stray", [0.1, 0.5, 1.0])
def test_precedents_equal_all_pairs(spark, stray):
    rows = made(int(stray * 10), 260, stray=stray)
    assert asked_of(spark, rows, rows) == brute(rows, rows)


def test_new_incidents_against_an_archive(spark):
    archive, asked = made(1, 200), [(s, 10_000 + i, *rest) for s, i, *rest in made(2, 60, stray=0.9)]
    want = brute(asked, archive)
    assert asked_of(spark, asked, archive) == want and want
    assert asked_of(spark, asked, archive[:1]) == brute(asked, archive[:1])


def test_terms_that_all_share_form_few_pairs(spark):
    """Where incidents come again, three times the archive means half as many pairs more per look, not three times as many."""

    def met(n):
        rng = random.Random(5)
        rows = []
        for i in range(n):  # eight incidents of a kind, a detector or a word more or less; one template and one word in all of them
            kind = i // 8
            words = [f"w{kind}-{k}" for k in range(4)]
            rows.append(("p", i, i, [*[f"t{kind}-{k}" for k in range(4)], "u-all"], [*words[: rng.choice([3, 4])], "w-all"], sorted({"d1", rng.choice(["d2", "d3"])}),
                         [f"s{kind % 5}"], "P2", "", None))
        coded = table(spark, rows).withColumn("class", F.xxhash64(*memory.SETS, "severity"))
        looks = memory._looks(coded, coded)
        counted = {}
        real = memory.with_similarity

        def watch(pairs, a, b, need=None):
            if need is not None:
                counted["pairs"] = pairs.count()
            return real(pairs, a, b, need)

        memory.with_similarity = watch
        try:
            memory._candidates(looks, memory._bars(looks, coded, 3, memory.DEFAULT), memory.DEFAULT)
        finally:
            memory.with_similarity = real
        return counted["pairs"] / looks.count(), looks.count()

    (few, n), (many, m) = met(400), met(1200)
    assert m > 3 * n and many < 1.6 * few and many < 0.1 * m, (few, n, many, m)
