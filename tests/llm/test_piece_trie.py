import itertools
import math
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import piece_trie

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def trie():
    return piece_trie.load_model(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abeinrst  \n\t.é▁日😀=<>")), max_size=40))
def test_library(text):
    trie, model = test_library.tools
    ids = next(iter(trie.encode([text])))
    assert ids.tolist() == model.encode(text)
    assert trie.decode(ids) == model.decode(ids.tolist())


test_library.tools = (piece_trie.load_model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH))


def test_forgetting_changes_nothing(trie, model, prose):
    small = piece_trie.load_model(PATH)
    small.known.size = 3
    texts = [prose(i, 40) for i in range(20)]
    assert [x.tolist() for x in small.encode(texts)] == model.encode(texts)


def test_unigram_is_viterbi():
    rng = random.Random(1)
    pieces = [("▁" * k + "".join(w), -rng.uniform(1, 9)) for n in (1, 2, 3) for w in itertools.product("abc", repeat=n) for k in (0, 1) if rng.random() < 0.6]
    trie = piece_trie.PieceTrie([None, *pieces], None, 0, "unigram")
    scores = dict(pieces)

    def best(word):
        if not word:
            return 0.0
        options = [best(word[:-n]) + scores.get(word[-n:], trie.floor if n == 1 else -math.inf) for n in range(1, min(4, len(word)) + 1)]
        return max(options)

    words = ["▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(80)]
    for word, ids in trie.encode_words(set(words)):
        texts = [pieces[i - 1][0] if i else "?" for i in ids]
        assert sum(len(t) for t in texts) == len(word)
        assert sum(scores.get(t, trie.floor) for t in texts) == pytest.approx(best(word))


def test_table(spark, docs_of, edges, model):
    got = {(r["doc_id"], r["n_ids"]): r for r in piece_trie.encode(docs_of(edges).withColumnRenamed("n_chars", "ids"), PATH).collect()}
    assert len(piece_trie.encode(docs_of(edges), PATH).collect()) == len(edges)
    for doc_id, text in edges:
        ids = model.encode(text or "")
        assert got[doc_id, len(ids)]["ids"] == ids and got[doc_id, len(ids)]["same"]
    assert piece_trie.encode(docs_of([]), PATH).collect() == []
