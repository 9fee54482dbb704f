import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runlens.llm import token_files
from runlens.llm.common import new_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), n) == ids).all()


def test_pieces_equal_the_library(library):
    texts = ["", " ", "a", "  two  spaces ", "a\n b\n\n c", "tab\t tab", "don't  we'll", " lead", "x y z", "  nb  em", "12 3.5% 日本 語", "end "]
    encode = token_files.PieceEncoder(PATH, remember=4)
    assert [np.frombuffer(r, "<u4").tolist() for r in encode(texts)] == [library(t) for t in texts]


def test_words_and_what_follows_them(library, monkeypatch):
    rng = random.Random(4)
    marks = [*"abé'.,\n\t $½²́ß日12_-ª\x1c\xa0\x85sDZ ", "  ", "\n\n", "word", " don't", " Straße", " ***", "<|endoftext|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    encode = token_files.PieceEncoder(PATH, remember=50)
    assert [np.frombuffer(r, "<u4").tolist() for i in range(0, 3000, 10) for r in encode(texts[i:i + 10])] == [library(t) for t in texts]
    encode, asked, plain = token_files.PieceEncoder(PATH, remember=2000), [], token_files.PieceEncoder._ids
    monkeypatch.setattr(token_files.PieceEncoder, "_ids", lambda self, text: asked.append(text) or plain(self, text))
    for i in range(20):  # words that come back are not learned again, whatever stands behind them and however many others come
        list(encode([" the and," + "".join(f" n{j}" for j in range(1000 * i, 1000 * i + 900)), " the. and; the\nOf"]))
    assert not any("the" in text.split() or "and" in text for text in asked) and sum(text == "," for text in asked) < 20


def test_joined_crc():
    parts = [b"abc", b"", b"0" * 1000, b"xyz"]
    assert token_files.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("bits", [False, True])
def test_file_gives_the_ids_back(spark, docs_of, edges, prose, library, bits):
    rows = edges + [(10 + i, prose(i, 5 * i)) for i in range(30)]
    path = new_table(spark, "t")
    token_files.write_ids(docs_of(rows).withColumnRenamed("n_chars", "ids"), path, PATH, block_ids=512, bits=bits)
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: r["start"])
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*library(text), 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    pieces = {}
    for r in token_files.read_ids(spark, path).collect():
        pieces.setdefault((r["shard"], r["doc"]), []).append((r["skip"], r["ids"]))
    whole = sorted(sum((ids for _, ids in sorted(p)), []) for p in pieces.values())
    assert whole == sorted([*library(t), 2] for _, t in rows)
    assert token_files.chunk_index(spark, path).where("n > 512").count() == 0


def test_empty_table(spark, docs_of):
    path = new_table(spark, "t")
    token_files.write_ids(docs_of([]), path, PATH)
    assert token_files.digests(spark, path).collect() == []


def test_query_takes_special_strings_as_the_library_does(spark, docs_of, edges, tmp_path):
    rows = [r for r in edges if r[0] is not None] + [(10, "a <|endoftext|> b"), (11, "<|endoftext|><|endoftext|>"), (12, "a <|endoftext| b"), (13, "after  it")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(PATH)
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert 50256 in plain.encode(rows[-4][1], add_special_tokens=False).ids
    assert sorted((tuple(r) for r in token_files.op1_token_files(spark, str(tmp_path)).collect()), key=lambda r: r[1]) == want
