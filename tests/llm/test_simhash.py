import random
import re

import xxhash

from runlens.llm import components, simhash


def walk(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i:i + words]).encode(), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints(docs_of, edges, prose):
    rows = edges + [(20 + i, prose(i % 7, 30)) for i in range(20)] + [(50, "AB cd ÉF"), (51, "ab CD Éf"), (52, "one two")]
    rows = [(d, t if t is None or len(t) < 50_000 else t[:5000]) for d, t in rows]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = {(d, f"{walk(t):016x}") for d, t in rows}
    assert {(r["doc_id"], r["fingerprint"]) for r in got} == want
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1  # fingerprint zero links like any other


def test_links_and_components(spark):
    rng = random.Random(5)
    fps, seeds = [], [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    for s in seeds:
        for _ in range(25):
            for _ in range(rng.randint(0, 3)):
                s ^= 1 << rng.randrange(64)
            fps.append(s)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = list(enumerate(signed)) + [(1000 + i, f) for i, f in enumerate(signed[:20])]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    close = {(min(a, b), max(a, b)): 8 - sum(bool((a ^ b) >> 8 * i & 255) for i in range(8)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    got = simhash.links(df).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in got} == close and len(got) == len(close)
    for bits in (1, 4):
        pairs = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
        wider = simhash.links(df, bits).collect()
        assert {(r["a"], r["b"]) for r in wider} == pairs and len(wider) == len(pairs)
    names = {f: min(d for d, g in rows if g == f) for f in signed}
    want = grouped(names.values(), [(names[a], names[b]) for a, b in close])
    assert {r["fp"]: r["component_id"] for r in simhash.classes(df).collect()} == {f: want[names[f]] for f in signed}


def test_components_of_chains_and_hubs(spark):
    linked = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 2000: 2000, 2001: 2000}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_first(docs_of, prose):
    rows = [(3, prose(1, 50)), (2, prose(1, 50)), (9, prose(2, 50)), (9, prose(2, 50)), (4, None), (5, ""), (None, "lost"), (None, "lost")]
    kept = simhash.keep_first(docs_of(rows).withColumnRenamed("source", "mark").withColumnRenamed("lang", "place"))
    assert kept.columns == ["doc_id", "text", "place", "mark", "n_chars"]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 2, 4, 9]
    assert simhash.keep_first(docs_of([])).collect() == []


def test_the_index_is_not_sent_to_all_tasks(spark, tmp_path):
    # files are of known size, which an index of 28 lists a row exceeds
    rng = random.Random(9)
    spark.createDataFrame([(i, rng.getrandbits(63)) for i in range(3000)], "doc_id long, fp long").write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
