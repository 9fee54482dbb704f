import itertools
import random
import re
from collections import Counter

from runlens.llm import filter_diagrams as fd

ROW = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels, filters="ABCDE"):
    """Every document walked through every order."""
    flags = {}
    for d, quality, toxic in labels:
        good, bad = flags.get(d, (False, False))
        flags[d] = (good or quality == 1, bad or toxic == 1)
    judged = []
    for d, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = [i for i, x, _ in docs if (x or "") == t and i is not None and d is not None and i < d]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(smaller)}
        judged.append((part or "", fails, *(flags.get(d, (False, False)) if d is not None else (False, False))))
    rows = []
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        removed_at = {}
        for order in itertools.permutations(filters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                removed_at["".join(order), step] = (f, len(left), len(gone), sum(j[2] for j in gone), sum(j[3] for j in gone))
        shapley = Counter()
        for f, _, gone, _, _ in removed_at.values():
            shapley[f] += gone
        for (order, step), (f, kept, gone, good, toxic) in removed_at.items():
            failing = [j for j in own if j[1][f]]
            rows.append((part, order, step, kept, gone, len(failing) - gone, sum(sum(j[1].values()) == 1 for j in failing), good, toxic, shapley[f]))
    return sorted(rows)


def run(spark, docs, labels, extra=""):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name in extra.split():
        d, y = d.withColumn(name, d["text"]), y.withColumn(name, y["quality"])
    out = fd.interactions(fd.failure_masks(d.repartition(4), y))
    assert out.columns == ROW
    return sorted(tuple(r) for r in out.collect())


def made(seed, rows=120):
    rng = random.Random(seed)
    docs = []
    for i in range(rows):
        n = rng.choice([0, 3, 198, 199, 200, 201, 260])
        words = [rng.choice(["Ab", "ab", "x#", "é", "日本", f"w{rng.randrange(400)}", f"W{rng.randrange(400)}"]) if rng.random() < 0.8 else "the" for _ in range(n)]
        if rng.random() < 0.7:
            words = [w.replace("#", "").lower() for w in words]
        if rng.random() < 0.5:
            words = [w if w not in ("the", "ab", "é", "日本", "x") else f"u{k}" for k, w in enumerate(words)]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words), rng.choice(["en", "de", None])))
    docs += [(200 + i, docs[rng.randrange(rows)][1], rng.choice(["en", "de"])) for i in range(60)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 260, 2)]
    return docs, labels


def test_against_every_order_walked(spark):
    docs, labels = made(1)
    got = run(spark, docs, labels)
    assert got == brute(docs, labels)
    assert sum(r[4] for r in got if r[1][r[2] - 1] in "BCDE") and len({r[1] for r in got}) == 120  # all filters take something


def test_edges(spark):
    long = "word " * 60_000 + "A#"
    docs = [(1, None, None), (2, "", "en"), (3, " \n\t", ""), (4, "a", "en"), (4, "a", "en"), (4, "a", "de"), (5, "a", "de"), (None, "a", "en"), (None, "a", "en"),
            (None, None, None), (6, long, "en"), (7, long, "fr"), (8, "É b", "en")]
    labels = [(4, None, 1), (4, 1, None), (5, 0, 0), (None, 1, 1), (6, 1, 1), (6, 1, 1), (99, 1, 1), (7, None, None)]
    assert run(spark, docs, labels, "part mask n key named digest is_good least") == brute(docs, labels)


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    docs, _ = made(2, 30)
    assert run(spark, docs, []) == brute(docs, [])


def test_one_text_over_a_third_of_all_rows_is_reduced_before_its_smallest_id_is_sought(spark):
    docs = [(i, "same" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
    got = run(spark, docs, [])
    first = {r[1]: r for r in got if r[2] == 1}
    assert first["EABCD"][4] == 999 and first["EABCD"][3] == 2001


def test_swaps_keep_the_function(spark):
    rng = random.Random(3)
    counts = {m: (rng.choice([0, 0, 1, 5]), rng.randrange(2), 0) for m in range(32) if rng.random() < 0.6}
    diagram = fd.Diagram("ABCDE", counts)
    seen = {"".join(diagram.order)}
    for at in fd.plain_changes(5):
        diagram.swap(at)
        seen.add("".join(diagram.order))
        for mask in range(32):  # follow the failure mask down the levels
            node = diagram.root
            for name, nodes in zip(diagram.order, diagram.levels, strict=True):
                fails, passes = nodes[node]
                node = fails if mask >> "ABCDE".index(name) & 1 else passes
            assert diagram.weights[node] == counts.get(mask, (0, 0, 0))
        children = [c for nodes in diagram.levels for c in nodes.values()]
        assert all(len(set(nodes.values())) == len(nodes) for nodes in diagram.levels) and children  # equal sub-diagrams are one
    assert len(seen) == 120
    assert [len(list(fd.plain_changes(k))) for k in range(5)] == [0, 0, 1, 5, 23]
