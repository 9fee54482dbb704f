import hashlib

import pytest

from runlens.llm import quartile_digest as qd


def test_digest_by_the_book(prose):
    data = prose(1, 200).encode()
    counts = [0] * qd.BUCKETS
    for at in range(len(data) - 4):
        for k, (i, j, m) in enumerate(qd.TRIPLETS):
            h = (data[at + i] * 2654435761 + data[at + j] * 2246822519 + data[at + m] * 3266489917 + k) & 0xFFFFFFFF
            h ^= h >> 15
            counts[(h * 668265263 & 0xFFFFFFFF) >> 25] += 1
    assert qd.bucket_counts(data).tolist() == counts
    q = sorted(counts)
    quarters = [sum(c > q[x] for x in (31, 63, 95)) for c in counts]
    assert qd._quarters(qd.digest(data)).tolist() == quarters


def test_blocks_do_not_show(monkeypatch, prose):
    data = prose(2, 3000).encode()
    whole = qd.digest(data)
    monkeypatch.setattr(qd, "BLOCK", 100)
    assert qd.digest(data) == whole


def test_difference(prose):
    a, b = prose(1, 400), prose(2, 400)
    marks = [qd.digest(t.encode()) for t in (a, a.replace("river", "rivers", 1), b[:300], "", "x")]
    for x in marks:
        assert qd.likeness(x, x) == 1.0
        for y in marks:
            assert 0 <= qd.likeness(x, y) == qd.likeness(y, x) <= 1
    assert qd.likeness(marks[0], marks[1]) > 0.8 > qd.likeness(marks[0], marks[2])


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_next_document(docs_of, edges, prose, ranges):
    rows = [(d, t) for d, t in edges if t is None or len(t) < 50_000] + [(100 + 3 * i, prose(i, i)) for i in range(40)]
    got = qd.edit_fingerprints(docs_of(rows).withColumnRenamed("lang", "range"), ranges).collect()
    texts = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        f, g, h = (qd.digest(x.encode()) for x in (t, edited, after))
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, qd.likeness(f, g), qd.likeness(f, h)))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_single_and_none(docs_of):
    (row,) = qd.edit_fingerprints(docs_of([(1, "abcdef")]), 4).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0
    assert qd.edit_fingerprints(docs_of([]), 4).collect() == []
