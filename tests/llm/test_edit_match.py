import random

import pytest

from runlens.llm import edit_match as em


def brute(item, text):
    """Least edit distance of ``item`` to any stretch of ``text``."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != ch), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_least_distance(seed):
    rng = random.Random(seed)
    item, text = ("".join(rng.choice("abc") for _ in range(n)) for n in (rng.randint(1, 80), rng.randint(0, 120)))
    assert em.least_distance(em.letters_of(item), len(item), text) == brute(item, text)


def edited(text, k, rng):
    s = list(text)
    for _ in range(k):
        at = rng.randrange(len(s))
        s[at:at + 1] = rng.choice([[], ["z"], [s[at], "y"]])
    return "".join(s)


def test_no_occurrence_is_missed(prose):
    rng = random.Random(3)
    items = [(i, em.normalise(prose(i, 30))) for i in range(20)]
    find = em.Matcher(items)
    for i, item in items:
        k = em.budget(len(item))
        text = prose(100 + i, 50) + " " + edited(item, rng.randint(0, k + 3), rng) + " " + prose(200 + i, 50)
        want = [(j, d) for j, other in items if (d := brute(other, em.normalise(text))) <= em.budget(len(other))]
        assert find(text) == want


def test_tables(spark, docs_of, edges, prose, monkeypatch):
    items = [(i, prose(i, 25)) for i in range(12)] + [(90, "too short"), (91, None), (3, prose(3, 25)), (None, prose(50, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = edges + [(100 + i, f"{prose(70 + i, 30)}\n{prose(i, 25).upper()}  tail") for i in range(12)] + [(200, prose(99, 60)), (201, prose(1, 25) + prose(2, 25))]
    docs = docs_of(rows).withColumnRenamed("source", "hits")
    got = {r["doc_id"]: r for r in em.contamination(docs, bench).collect()}
    assert all(i in got[100 + i]["item_ids"] and got[100 + i]["least_edits"] == 0 for i in range(12))
    assert got[103]["item_ids"] == [3, 3] and {1, 2} <= set(got[201]["item_ids"]) and got[200]["n_items"] == 0 and got[200]["least_edits"] is None
    clean = em.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, *_ in edges + [(200,)])
    monkeypatch.setattr(em, "BLOCK_CHARS", 400)
    assert em.contamination(docs, bench).count() == len(rows) and em.keep_clean(docs, bench).count() == len(edges) + 1
    assert {(r["doc_id"], r["item_id"]) for r in em.find_items(docs, bench).collect()} >= {(100 + i, i) for i in range(12)}
    none = bench.limit(0)
    assert em.find_items(docs, none).collect() == [] and em.keep_clean(docs, none).count() == len(rows) and em.contamination(docs, none).count() == len(rows)
    assert em.contamination(docs_of([]), bench).collect() == []


def test_short_items_are_found_unchanged_and_whole(spark, docs_of):
    bench = spark.createDataFrame([(1, "Capital of  France?"), (2, " \n"), (3, "art")], "item_id long, text string")
    docs = docs_of([(1, "the capital of\nfrance? paris"), (2, "the capitals of france?"), (3, "a party start"), (4, "state of the art."), (5, "capital of francs?")])
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in em.find_items(docs, bench).collect()) == [(1, 1, 0), (4, 3, 0)]
    assert sorted(r["doc_id"] for r in em.keep_clean(docs, bench).collect()) == [2, 3, 5]


def test_budget_grows_with_the_item(prose):
    rng = random.Random(8)
    for words in (60, 200, 500):
        item = em.normalise(prose(words, words))
        text = f"{prose(1, 40)} {edited(item, int(len(item) * 0.08), rng)} {prose(2, 40)}"
        (found,) = em.Matcher([(7, item)])(text)
        assert found == (7, brute(item, em.normalise(text)))
    assert em.budget(3000) == 360


@pytest.mark.parametrize("length", [85, 120, 300])
def test_one_replaced_word_is_found(prose, length):
    for seed in range(20):
        words = em.normalise(prose(seed, 100))[:length].rsplit(" ", 1)[0].split()
        words[seed % len(words)] = "zzzzzzzz"
        item = em.normalise(prose(seed, 100))[:length].rsplit(" ", 1)[0]
        assert em.Matcher([(seed, item)])(f"before that {' '.join(words)} and after")
