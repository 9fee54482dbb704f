"""Near-duplicates by SimHash: fingerprints that differ in at most two bits are linked.

A fingerprint is eight bytes. Two fingerprints that differ in at most ``max_bits`` bits differ in at most that many
bytes, so they agree on at least ``8 - max_bits`` byte positions: the guaranteed number of matches. The inverted index
holds positional bytes; since a single (position, byte) list would hold a 256th of all rows, lists are kept for every
choice of ``8 - max_bits`` positions at once (28 choices for two bits, 48 bits of key). Pairs below the guaranteed
number never meet in a list. Of a pair that meets, the shared positional bytes are tallied, which also tells the one list
that may give it, and the number of differing bits is verified.

The index holds distinct fingerprints only, so copies cost nothing, and one list holds at most 2^(8*max_bits)
fingerprints (those that differ in the free positions). Pairs leave the join only if they are true links: at most
2,080 per fingerprint for two bits. Classes of documents are classes of fingerprints.

Edge cases: a null or empty text, or one of white space, has fingerprint zero, which is linked like any other. Fewer
words than a shingle has form one shingle. A tie (a bit set in exactly half of the hashes) gives 0. Repeated rows and
ids are kept; a null doc_id is kept and never names a component unless all its members lack an id. An empty table
gives no rows. Columns other than ``doc_id`` and ``text`` are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, spare, written
from .components import components

WORDS = 3
MAX_BITS = 2
SEED = 42
#: hashes unpacked to bits at a time
BLOCK = 1 << 16


def ascii_words(text: str) -> bytes:
    """The words one space apart: only A-Z are made small, only the six ASCII spaces part words."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def shingle_hashes(text: str | None, words: int = WORDS, split: Callable[[str], bytes] = ascii_words) -> np.ndarray:
    """XXH64 of every shingle of the text's words, repeats included."""
    joined = split(text or "")
    if not joined:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(spaces) + 2 - words
    if n < 1:
        return np.array([digest(joined, SEED)], np.uint64)
    starts, ends = [0, *(spaces[:n - 1] + 1).tolist()], [*spaces[words - 1:].tolist(), len(joined)]
    return np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64, n)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is 1 in over half of the shingle hashes."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        block = h[at:at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``fp`` (long), ``mark`` (hash of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), words) for x in batch.column("text")], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), fps, batch.column("mark")], names=["doc_id", "fp", "mark"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _mark().alias("mark")).mapInArrow(run, "doc_id long, fp long, mark long")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _mask(free: tuple[int, ...]) -> int:
    """All bits but those of the free byte positions, as a signed long."""
    bits = (1 << 64) - 1
    for i in free:
        bits &= ~(0xFF << (8 * i))
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a`` < ``b``, ``shared`` (positional bytes) of all pairs of distinct fingerprints that differ in at most
    ``max_bits`` bits (1 to 7). A pair that meets in several lists is taken from the one of its first shared positions."""
    need = 8 - max_bits
    kept = list(combinations(range(8), need))
    free = [tuple(i for i in range(8) if i not in k) for k in kept]
    lists = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("positions"), F.col("fp").bitwiseAND(F.lit(_mask(f))).alias("bytes")) for i, f in enumerate(free)])
    index = fps.select("fp").distinct().select("fp", F.inline(lists))
    a, b = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    agree = sum((F.when(F.shiftright(differ, 8 * i).bitwiseAND(F.lit(0xFF)) == 0, 1 << i).otherwise(0) for i in range(8)), F.lit(0))
    first = [tuple(i for i in range(8) if m >> i & 1)[:need] for m in range(256)]
    own_list = F.array(*[F.lit(kept.index(f) if len(f) == need else -1).cast("tinyint") for f in first])
    # the size Spark expects of the index leaves its lists out, and may send all of it to every task
    met = a.join(b.hint("merge"), ["positions", "bytes"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & (F.get(own_list, agree) == F.col("positions")))
    return met.select("a", "b", F.bit_count(agree).alias("shared"))


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp``, ``component_id`` (smallest doc_id reachable) of every distinct fingerprint."""
    named = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    root = components(links(named, max_bits)).withColumnRenamed("node", "fp")
    placed = named.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.select("fp", "root").join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs, words), "simhash")
    return fps.join(classes(fps, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every class with its own columns: that of the smallest doc_id. Rows without an id cannot be named
    and stay. Of repeated rows one stays. The texts are shuffled once, by id."""
    fps = written(fingerprints(docs, words), "simhash")
    first = fps.join(classes(fps, max_bits), "fp").where("doc_id = component_id").select(F.col("doc_id").alias("a_id"), F.col("mark").alias("a_mark")).distinct()
    mark, place = spare(docs, "mark", "place")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.where("doc_id is not null").withColumn(mark, _mark())
    kept = rows.join(first, (F.col("doc_id") == F.col("a_id")) & (F.col(mark) == F.col("a_mark")), "left_semi")
    same = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64(*own))
    one = kept.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).select(*own)
    return one.unionAll(docs.where("doc_id is null"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(load(spark, folder, "documents"))
