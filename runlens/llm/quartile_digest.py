"""Document fingerprints that stay close when a text is edited: a digest of bucket quartiles.

Every window of five bytes gives six byte triplets; a hash deals them into 128 buckets that are counted. The digest
holds, in hex: a byte over the whole text, the length on a logarithmic scale, the ratios of the quartiles of the
bucket counts, and for each bucket the quarter its count falls in (two bits). The difference of two digests is a
bounded sum: buckets differ by 0 to 3 quarters (three count as six), lengths and ratios by their circular distance.
``likeness`` is one minus the difference over its bound, 0 at the bound and beyond, 1 for equal digests.

``with_next`` pairs every row with the one after it in ``doc_id`` order, across the whole table, with one shuffle of
the texts: ids alone give range bounds, rows go to the range of their id, and the first row of a range also goes to the
range before it (the very first to the last).

Edge cases: a null text counts as empty; an empty text has no triplet, a text below five bytes is padded with zero
bytes. Ties of counts are all on the same side of a quartile. Repeated ids follow each other in the order of their
texts, rows without an id come first. A single row is its own next one. Empty tables give no rows. Columns other than
``doc_id`` and ``text`` are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

BUCKETS = 128
WINDOW = 5
#: positions in a window that make up the triplets
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: differences from here on count as entirely different
BOUND = 300
LENGTH_WEIGHT, RATIO_WEIGHT = 12, 12
#: bytes hashed at a time
BLOCK = 1 << 16
_MIX = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917))
_FINISH = np.uint32(668265263)
_SHIFT = np.uint32(32 - 7)
_STEPS = np.array([0, 1, 2, 6])


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of each bucket ``data`` has."""
    counts = np.zeros(BUCKETS, np.int64)
    if 0 < len(data) < WINDOW:
        data = data.ljust(WINDOW, b"\0")
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole) - WINDOW + 1, BLOCK):
        b = whole[at:at + BLOCK + WINDOW - 1].astype(np.uint32)
        n = len(b) - WINDOW + 1
        first = b[:n] * _MIX[0]
        for k, (_, i, j) in enumerate(TRIPLETS):
            h = first + b[i:i + n] * _MIX[1] + b[j:j + n] * _MIX[2] + np.uint32(k)
            h ^= h >> np.uint32(15)
            h *= _FINISH
            counts += np.bincount(h >> _SHIFT, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """70 hex digits: check byte, length, two ratios, 128 quarters."""
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = quarter.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    length = int(np.log(len(data) + 1) * 8) & 0xFF
    ratios = (100 * q1 // q3 % 16, 100 * q2 // q3 % 16) if q3 else (0, 0)
    return bytes([zlib.crc32(data) & 0xFF, length, ratios[0] << 4 | ratios[1]]).hex() + body.astype(np.uint8).tobytes().hex()


def _quarters(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint[6:]), np.uint8)
    return np.stack([raw >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(-1).astype(np.int8)


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most ``BOUND``."""
    x, y = bytes.fromhex(a[:6]), bytes.fromhex(b[:6])
    circle = lambda p, q, n: min((p - q) % n, (q - p) % n)
    total = int(x[0] != y[0])
    far = circle(x[1], y[1], 256)
    total += far if far <= 1 else far * LENGTH_WEIGHT
    for s in (4, 0):
        far = circle(x[2] >> s & 15, y[2] >> s & 15, 16)
        total += far if far <= 1 else (far - 1) * RATIO_WEIGHT
    total += int(_STEPS[np.abs(_quarters(a) - _quarters(b))].sum())
    return min(total, BOUND)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest((t.as_py() or "").encode("utf-8")) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def range_bounds(keys: DataFrame, ranges: int) -> list[int]:
    """Ascending keys of the table, the smallest first, that open at most ``ranges`` ranges of about as many rows."""
    wanted = F.array(*[F.lit(i / ranges) for i in range(ranges)])
    row = keys.agg(F.min("key").alias("least"), F.percentile_approx("key", wanted, max(10_000, 4 * ranges)).alias("at")).first()
    return [] if row["least"] is None else sorted({row["least"], *row["at"]})


def place_of(key: str, bounds: list[int]) -> Column:
    """Twice the number of the range a key lies in, plus one where the row opens it: a binary search as an expression, so
    that dealing the texts out takes no Python worker."""

    def search(low: int, high: int) -> str:
        if high - low == 1:
            return f"{2 * low} + int({key} = {bounds[low]}L)"
        middle = (low + high) // 2
        return f"CASE WHEN {key} < {bounds[middle]}L THEN {search(low, middle)} ELSE {search(middle, high)} END"

    return F.expr(search(0, len(bounds))) if bounds else F.lit(0)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """``doc_id, text, range, ahead`` dealt by range and sorted; ``ahead`` marks the copy of a later range's first row."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    bounds = range_bounds(keyed.select("key"), ranges)

    at = F.floor(F.col("place") / 2).cast("int")
    opens = F.col("place") % 2 == 1
    own: Column = F.struct(at.alias("range"), F.lit(False).alias("ahead"))
    copy: Column = F.struct(F.when(at == 0, len(bounds) - 1).otherwise(at - 1).alias("range"), F.lit(True).alias("ahead"))
    dealt = keyed.withColumn("place", place_of("key", bounds)).select("doc_id", "key", "text", F.inline(F.when(opens, F.array(own, copy)).otherwise(F.array(own))))
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "key", "text")


def edit_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the first floor(n_chars / 2) code points of the next document, in place of as many of its
    own."""
    if ranges is None:
        ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (doc_id, text, range, fingerprint) that waits for the row after it
        for batch in batches:
            out = []
            cols = [batch.column(c) for c in ("doc_id", "text", "range", "ahead")]
            for doc_id, text, rng, ahead in zip(*cols, strict=True):
                text, rng, ahead = text.as_py(), rng.as_py(), ahead.as_py()
                if ahead and (last is None or last[2] != rng):
                    continue  # a further copy: the range is closed
                mark = digest(text.encode("utf-8"))
                if last is not None:
                    n = len(last[1])
                    edited = (last[1][:n - n // 2] + text[:n // 2]).encode("utf-8")
                    changed = digest(edited)
                    out.append((last[0], n, hashlib.sha256(edited).hexdigest(), last[3], changed, likeness(last[3], changed), likeness(last[3], mark)))
                last = None if ahead else (doc_id.as_py(), text, rng, mark)
            if out:
                yield pa.record_batch([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=names)

    return with_next(docs, ranges).select("doc_id", "text", "range", "ahead").mapInArrow(run, schema)


def op10_quartile_digest(spark: SparkSession, folder: str) -> DataFrame:
    return edit_fingerprints(load(spark, folder, "documents"))
