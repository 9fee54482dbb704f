"""Token-id files by bit-plane shuffling.

Ids are cut into blocks of a fixed number of ids. A block is transposed into byte planes (the first bytes of all ids,
then the second ones, ...) or bit planes, and every plane is compressed by itself with zstandard; upper planes of a
small vocabulary are all zero and cost a few bytes. A file is one Parquet part, one row per block, so Spark's commit
protocol covers lost executors and any store that Spark can write. The columns beside the planes are the chunk index:
shard, block, ids of the shard before it, number of ids, and for every document with ids in the block its place there. They can be read, and
filtered, without touching the planes.

Documents are dealt out by ranges of ``doc_id`` and sorted inside a range, so shards in order hold the ids in ascending
``doc_id`` order (repeated ids in order of their texts). Only shard totals are summed up in one place.

Texts are encoded by the library word by word: a space in front of a non-space always opens a new pre-token of the
vocabulary's pattern, so the ids of a text are the ids of its space-led pieces in a row. Distinct pieces are encoded
together and remembered per worker (a bounded number, the frequent ones longest), which does a text of known words by look-ups. The pattern also
ends a run of letters before any other ASCII character, so a new piece that begins with a word is that word and what follows
it, each learned once; such words need no pattern and go to the library's merges as they are.

The strings of special tokens in a text are ordinary text, or with ``specials`` (as in the query) what the library makes of them by
default; a text that holds one is then encoded whole by the library.

Edge cases: null and empty texts have the end id only. A document longer than a block goes on in the next ones. Rows
with a null doc_id come first. Repeated rows are each written. An empty table gives a file without rows. Columns
other than ``doc_id`` and ``text`` are not stored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, load, new_table, per_worker

END_ID = 2
BLOCK_IDS = 1 << 16
LEVEL = 3
#: pieces a worker remembers in each of two generations, and the most characters of pieces that are encoded or joined at a time
REMEMBER = 300_000
SLICE_CHARS = 1 << 22
CHUNKS = (
    "shard int, block int, first long, n int, planes array<binary>, "
    "docs array<struct<doc: long, doc_id: long, skip: long, take: int, size: long>>"
)

_SPACE_RUN = re.compile(r" (?:\s|\Z)")
_PIECE = re.compile(r" (?=\S)")
#: letters (of ASCII and Latin-1), then nothing or an ASCII character that is no letter
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([\x00-@\[-`{-\x7f].*)?", re.S)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary, for the bytes that do not stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class PieceEncoder:
    """Ids of texts as little-endian 32-bit integers, equal to those of the library for the whole text."""

    def __init__(self, path: str, remember: int = REMEMBER, specials: bool = False) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials  # if set, their strings in a text are ordinary text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if specials and added else None
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # tokens that begin with a space
        self.known = Remembered(remember)
        self.behind: dict[str, bytes] = {}  # by what stands behind a word
        self.remember = remember
        state = json.loads(self.tokenizer.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.cuts = not state["normalizer"] and byte_level.items() <= (state["pre_tokenizer"] or {}).items()
        self.letters = byte_letters()
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[str], ids: np.ndarray) -> None:
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(pieces):
            raise ValueError("the vocabulary does not keep spaces at the front of tokens")
        at, raw, known = (at * 4).tolist(), ids.tobytes(), self.known.young
        for piece, s, e in zip(pieces, at, [*at[1:], len(raw)], strict=True):
            known[piece] = raw[s:e]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters only, already in the characters that stand for their bytes."""
        shown = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        self._learn(words, np.array(self.merges.encode_batch_fast(["Ġ" + " Ġ".join(shown)], add_special_tokens=False)[0].ids, "<u4"))

    def _learn_all(self, new: list[str]) -> None:
        known, old, behind = self.known.young, self.known.old, self.behind
        if len(behind) + len(new) > self.remember:
            behind.clear()
        words, cut, plain = set(), [], []
        for piece in new:
            m = _WORD.fullmatch(piece) if self.cuts else None
            if " " in piece:  # ends in further spaces, so its tokens do not tell its bounds
                known[piece] = self._ids(" " + piece).tobytes()
            elif m is None:
                plain.append(piece)
            else:
                word, rest = m.groups()
                if rest:
                    cut.append((piece, word, rest))
                    if rest not in behind:
                        behind[rest] = self._ids(rest).tobytes()
                if word not in known:
                    if word in old:
                        known[word] = old[word]
                    else:
                        words.add(word)
        words = list(words)
        for i in range(0, len(words), 50_000):
            self._learn_words(words[i:i + 50_000])
        for i in range(0, len(plain), 50_000):
            self._learn(plain[i:i + 50_000], self._ids(" " + " ".join(plain[i:i + 50_000])))
        for piece, word, rest in cut:
            known[piece] = known[word] + behind[rest]

    def __call__(self, texts: Sequence[str]) -> Iterator[bytes]:
        for part in _slices(texts):
            whole = [i for i, t in enumerate(part) if self.special.search(t)] if self.special else []
            by_library = {i: self._ids(part[i]).tobytes() for i in whole}
            for i in whole:
                part[i] = ""
            split = [_PIECE.split(t) if _SPACE_RUN.search(t) else t.split(" ") for t in part]
            first = [s.pop(0) for s in split]
            self._learn_all(self.known.unknown(set().union(*split)))
            get = self.known.young.__getitem__
            for i, (f, s) in enumerate(zip(first, split, strict=True)):
                yield by_library[i] if i in by_library else (self._ids(f).tobytes() if f else b"") + b"".join(map(get, s))


def _slices(texts: Sequence[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars > SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def pack(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> list[bytes]:
    """Compressed planes of a block of 32-bit ids: four byte planes, or 32 bit planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    if bits:
        planes = [np.packbits((ids >> np.uint32(b)) & np.uint32(1)) for b in range(32)]
    else:
        planes = list(ids.view(np.uint8).reshape(-1, 4).T)
    return [squeeze(np.ascontiguousarray(p).tobytes()) for p in planes]


def unpack(planes: Sequence[bytes], n: int) -> np.ndarray:
    """The ids of a block; the number of planes tells their kind."""
    open_up = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(open_up(p), np.uint8) for p in planes]
    if len(raw) == 4:
        return np.ascontiguousarray(np.stack(raw, axis=1)).view("<u4").reshape(-1)[:n]
    ids = np.zeros(n, np.uint32)
    for b, p in enumerate(raw):
        ids |= np.unpackbits(p, count=n).astype(np.uint32) << np.uint32(b)
    return ids.astype("<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, bits: bool = False, specials: bool = False) -> None:
    """Encode ``doc_id, text`` and write the file at ``path`` (a folder of one part per shard)."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("planes", pa.list_(pa.binary())),
        ("docs", pa.list_(pa.struct([("doc", pa.int64()), ("doc_id", pa.int64()), ("skip", pa.int64()), ("take", pa.int32()), ("size", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encode = per_worker(f"pieces:{tokenizer}:{specials}", lambda: PieceEncoder(tokenizer, specials=specials))
        waiting, held, places, block, doc = [], 0, [], 0, 0  # bytes of the open block, their ids, its documents

        def closed() -> pa.RecordBatch:
            nonlocal waiting, held, places, block
            ids = np.frombuffer(b"".join(waiting), "<u4")
            row = {"shard": shard, "block": block, "first": block * block_ids, "n": held, "planes": pack(ids, bits), "docs": places}
            waiting, held, places, block = [], 0, [], block + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            ids_of = encode([x.as_py() or "" for x in batch.column("text")])
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                raw += end
                size, skip = len(raw) // 4, 0
                while skip < size:
                    take = min(size - skip, block_ids - held)
                    waiting.append(raw[4 * skip:4 * (skip + take)])
                    places.append({"doc": doc, "doc_id": doc_id, "skip": skip, "take": take, "size": size})
                    held, skip = held + take, skip + take
                    if held == block_ids:
                        yield closed()
                doc += 1
        if held:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(path)


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per block without its planes."""
    return spark.read.schema(CHUNKS).parquet(path).drop("planes")


def _times(m: Sequence[int], v: int) -> int:
    """A GF(2) matrix, by columns, times a vector."""
    r, i = 0, 0
    while v:
        if v & 1:
            r ^= m[i]
        v, i = v >> 1, i + 1
    return r


@cache
def _shift(k: int) -> tuple[int, ...]:
    """Columns of the GF(2) matrix that takes a CRC-32 over ``2 ** k`` further zero bits."""
    if not k:
        return (0xEDB88320, *[1 << i for i in range(31)])
    half = _shift(k - 1)
    return tuple(_times(half, c) for c in half)


def joined_crc(parts: Sequence[tuple[int, int]]) -> int:
    """CRC-32 of byte strings in a row, from each one's (length, CRC-32)."""
    crc = 0
    for n, c in parts:
        for k in range((8 * n).bit_length()):
            if 8 * n >> k & 1:
                crc = _times(_shift(k), crc)
        crc ^= c
    return crc


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``shard, doc, doc_id, skip, ids`` (array of long): the pieces of documents, a row for each block they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = unpack(row["planes"], row["n"]), 0
                for d in row["docs"]:
                    part = pa.array([ids[at:at + d["take"]].astype(np.int64)], pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array([row["shard"]], pa.int32()), *[pa.array([d[k]], pa.int64()) for k in ("doc", "doc_id", "skip")], part], names=["shard", "doc", "doc_id", "skip", "ids"])
                    at += d["take"]

    return _chunks(spark, path).mapInArrow(run, "shard int, doc long, doc_id long, skip long, ids array<long>")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file: doc_id, start (ids before it), n_tokens, ids_crc32 of its little-endian 32-bit ids."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("shard", "doc", "doc_id", "at", "skip", "take", "crc")
        for batch in batches:
            for shard, first, n, planes, docs in zip(*[batch.column(c) for c in ("shard", "first", "n", "planes", "docs")], strict=True):
                raw, docs = memoryview(unpack(planes.as_py(), n.as_py()).tobytes()), docs.values
                take = docs.field("take").to_numpy().astype(np.int64)
                ends = take.cumsum()
                crcs = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip((ends - take).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(np.full(len(take), shard.as_py(), np.int64)), *[docs.field(c) for c in ("doc", "doc_id")], pa.array(first.as_py() + ends - take), docs.field("skip"), pa.array(take), pa.array(crcs, pa.int64())],
                    names=names)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            takes, found = (batch.column("parts").flatten().field(k).to_numpy() for k in ("take", "crc"))
            bounds = batch.column("parts").value_lengths().to_numpy().cumsum()
            crcs = found[bounds - 1]  # of the last piece, which is the only one of most documents
            for i in np.flatnonzero(np.diff(bounds, prepend=0) > 1):
                own = slice(bounds[i - 1] if i else 0, bounds[i])
                crcs[i] = joined_crc(list(zip((4 * takes[own]).tolist(), found[own].tolist(), strict=True)))
            yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    index = chunk_index(spark, path)
    totals = index.groupBy("shard").agg(F.sum(F.col("n").cast("long")).alias("n"))  # a row per shard
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    pieces = _chunks(spark, path).mapInArrow(check, "shard long, doc long, doc_id long, at long, skip long, take long, crc long")
    whole = pieces.groupBy("shard", "doc").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("take").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("skip", "take", "crc"))).alias("parts"))
    placed = whole.join(before, "shard").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "parts")
    return placed.mapInArrow(join_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table(spark, "token-ids")
    write_ids(load(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), specials=True)
    return digests(spark, path)
