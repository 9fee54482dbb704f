"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is cut into marked words: the run of space marks in front of a word belongs to it, and no piece of the
vocabulary holds a mark behind another character, so no piece crosses the cut. The distinct words of a slice of text
are sorted, which lays out their trie in depth-first order; going from a word to the next one drops the forward states
behind their common prefix and computes only the new ones. Ids of words are remembered per worker (a bounded number).

The forward state of a prefix depends on the model:

* unigram: the best score of the prefix and the length of its last piece (Viterbi, as usual);
* BPE: scores there rank merges and do not add up, so the best sum is not the library's segmentation. What a prefix does
  have is a unique last piece, and a piece may follow another exactly if merging the two alone keeps them apart:
  merges at one boundary do not depend on what lies beyond it. So the state is the last piece, and the test of a pair
  (remembered) takes the place of adding scores. The result is the library's, in time linear in the word.

The given model is BPE with byte fallback: a character outside the vocabulary becomes its UTF-8 bytes.

Edge cases: a null or empty text has no ids and decodes to the empty text. The model's normaliser is the identity with one mark put
in front; a text that itself holds the mark decodes to a space there, as in the library. Very long words cost time linear in their length.
Repeated rows are each encoded; empty tables give no rows. ``encode`` carries ``doc_id`` only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, load, per_worker

MARK = "▁"
REMEMBER = 250_000
REMEMBER_PAIRS = 500_000
SLICE_CHARS = 1 << 21
#: what a character outside the vocabulary costs below the worst piece (unigram)
UNKNOWN_COST = 10.0


class PieceTrie:
    """``pieces``: (text, score) by id; ``None`` where an id is no text piece. ``byte_ids``: ids of the 256 bytes."""

    def __init__(self, pieces: Sequence[tuple[str, float] | None], byte_ids: Sequence[int] | None, unknown: int = 0, kind: str = "bpe", remember: int = REMEMBER) -> None:
        self.ids = {p[0]: i for i, p in enumerate(pieces) if p}
        self.scores = {p[0]: p[1] for p in pieces if p}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark behind another character")
        self.byte_ids, self.unknown, self.kind = byte_ids, unknown, kind
        self.lengths = sorted({len(p) for p in self.ids} | {1}, reverse=True)
        tails: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                tails.setdefault(p[-2:], set()).add(len(p))
        self.tails = {t: sorted(found, reverse=True) for t, found in tails.items()}
        self.pairs: dict[int, bool] = {}  # by the codes of both pieces in one number
        self.known = Remembered(remember)
        self.bytes_of: list[bytes] = [p[0].encode("utf-8") if p else b"" for p in pieces]
        for b, i in enumerate(byte_ids or ()):
            self.bytes_of[i] = bytes([b])
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_COST

    # ------------------------------------------------------------------ forward states

    def _merged(self, text: str) -> list[str]:
        """Merging by rank: of all neighbours that form a piece, the best score first, the leftmost of equals."""
        s, none = list(text), -float("inf")
        get = self.scores.get
        ranks = [get(a + b, none) for a, b in zip(s, s[1:], strict=False)]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            s[i:i + 2] = [s[i] + s[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(s[i - 1] + s[i], none)
            if i < len(ranks):
                ranks[i] = get(s[i] + s[i + 1], none)
        return s

    def _code(self, piece: str) -> int:
        """Below 2^22: the id of a piece, else a character outside the vocabulary; 2^21 - 1 is the start of a word."""
        found = self.ids.get(piece)
        return found if found is not None else 1 << 21 | ord(piece) if piece else (1 << 21) - 1

    def _follows(self, before: str, piece: str, key: int) -> bool:
        ok = self._merged(before + piece) == ([before, piece] if before else [piece])
        if len(self.pairs) >= REMEMBER_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _extend_bpe(self, word: str, last: list[str], codes: list[int], start: int) -> None:
        """Append the last pieces, and their codes, of the prefixes of over ``start`` characters."""
        pairs, ids, tails, none = self.pairs, self.ids, self.tails, ()
        for end in range(start + 1, len(word) + 1):
            for n in tails.get(word[end - 2:end], none) if end > 1 else none:  # longest first
                if n > end:
                    continue
                piece = word[end - n:end]
                code = ids.get(piece)
                if code is None:
                    continue
                key = codes[end - n] << 22 | code
                ok = pairs.get(key)
                if self._follows(last[end - n], piece, key) if ok is None else ok:
                    last.append(piece)
                    codes.append(code)
                    break
            else:  # no longer piece may end here, so the character stands alone
                last.append(word[end - 1])
                codes.append(self._code(word[end - 1]))

    def _extend_unigram(self, word: str, last: list[str], best: list[float], end: int) -> None:
        top, choice = -float("inf"), ""
        for n in self.lengths:
            if n <= end:
                piece = word[end - n:end]
                score = self.scores.get(piece, self.floor if n == 1 else None)
                if score is not None and best[end - n] + score > top:
                    top, choice = best[end - n] + score, piece
        last.append(choice)
        best.append(top)

    def _ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def encode_words(self, words: Sequence[str]) -> Iterator[tuple[str, list[int]]]:
        """``(word, ids)`` of distinct words, in sorted order."""
        previous, last, best, codes = "", [""], [0.0], [self._code("")]
        bpe = self.kind == "bpe"
        for word in sorted(words):
            same, most = 0, min(len(word), len(previous))
            while same < most and word[same] == previous[same]:
                same += 1
            del last[same + 1:], best[same + 1:], codes[same + 1:]
            if bpe:
                self._extend_bpe(word, last, codes, same)
            else:
                for end in range(same + 1, len(word) + 1):
                    self._extend_unigram(word, last, best, end)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield word, [i for piece in reversed(out) for i in self._ids_of(piece)]
            previous = word

    # ------------------------------------------------------------------ texts

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of every text."""
        return (ids for _, ids in self.with_texts(texts))

    def with_texts(self, texts: Iterable[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Every text and its ids; texts are taken in slices of a bounded number of characters."""
        for part in _slices(texts):
            split = [_marked(t) for t in part]
            words = set().union(*split)
            new = self.known.unknown(words)
            known = self.known.young
            for word, ids in self.encode_words([MARK + w for w in new]):
                known[word[1:]] = np.array(ids, "<i4").tobytes()
            get = known.__getitem__
            for text, s in zip(part, split, strict=True):
                yield text, np.frombuffer(b"".join(map(get, s)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _slices(texts: Iterable[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars > SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _marked(text: str) -> list[str]:
    """Words without their first mark."""
    if not text:
        return []
    text = text.replace(MARK, " ")  # the model cannot tell them apart
    words = text.split(" ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        out, marks = [], ""
        for w in words[:-1]:
            if w:
                out.append(marks + w)
                marks = ""
            else:
                marks += MARK
        return [*out, marks + words[-1]]
    return words


def load_model(path: str, kind: str = "bpe") -> PieceTrie:
    """The vocabulary of a model file; only its table of pieces is read."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    pieces = [None if special[i] else (model.id_to_piece(i), model.get_score(i)) for i in range(n)]
    by_byte = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    return PieceTrie(pieces, [by_byte[f"<0x{b:02X}>"] for b in range(256)] if by_byte else None, model.unk_id(), kind)


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """Per row: doc_id, ids, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256 and same (decoding gives the
    text again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = per_worker(f"trie:{kind}:{path}", lambda: load_model(path, kind))
        for batch in batches:
            rows: list[tuple] = []
            ids_held = 0
            encoded = trie.with_texts(t.as_py() or "" for t in batch.column("text"))
            for doc_id, (text, ids) in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                back = trie.decode(ids)
                rows.append((doc_id, ids, len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
                ids_held += len(ids)
                if ids_held > SLICE_CHARS:
                    yield _batch(rows)
                    rows, ids_held = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_ids, ids, sizes, crcs, shas, same = zip(*rows, strict=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.record_batch(
        [pa.array(doc_ids, pa.int64()), lists, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(shas), pa.array(same)],
        names=["doc_id", "ids", "n_ids", "ids_crc32", "decoded_sha256", "same"])


def op2_piece_trie(spark: SparkSession, folder: str) -> DataFrame:
    return encode(load(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")
