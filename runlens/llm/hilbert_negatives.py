"""Hard negatives of anchors by score windows over Hilbert-ordered blocks with zone maps.

Components become integers floor(scale * x). Vectors are ordered along a Hilbert curve and written as Parquet blocks; every block has
a zone map, the least and largest value of each dimension, and so has every group of blocks. Interval arithmetic over a zone map gives
the least and largest score an anchor can have inside it. A window (least score, largest score, same or other label, how many) reads a group
only if the window and the bounds over the group meet, then a block only if window and bounds over the block still meet, with the
window's lower end raised to the worst entry found so far. Blocks with high bounds come first.

An anchor's positives are one open window, whose lower end is first found in the anchor's own group; each positive then
sets a window for the negatives. All bounds and scores are exact, so results are those of a full search. In many dimensions
without structure the bounds of a block are wide and most blocks are read; the work is then anchors times rows, in tiles.

Edge cases: a row with a null id, label, vector or component, or with a non-finite component takes no part. Of rows that share
an id the one with the smallest label and vector stays. Shorter vectors end in zeros, an empty one is all zeros. Equal scores: the smaller id comes
first. A negative score of a positive gives an empty window, a score of zero one of zero. Scores beyond the range
of a long are held at its end. Equal vectors fall into different blocks where needed (the id is the last part of the order). An
anchor without positives or negatives gives no rows; an empty table gives none. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, written
from .vector_blocks import GROUP_ROWS, best, clean, group_count, matrix, measure, meet

POSITIVES, NEGATIVES, WINDOW, SCALE = 5, 3, (50, 95), 256.0
BLOCK = 512
#: anchors of a batch
BATCH = 512
#: bits of a curve key in all dimensions together, about
KEY_BITS = 256
EXACT = 2.0**53
LONG = (1 << 63) - 1


def curve_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places along the Hilbert curve of rows of ``bits``-bit coordinates, as byte strings that sort in curve order."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    turn = top
    while turn > 1:  # each finer cell is turned as the cells around it demand
        low = turn - 1
        for axis in x:
            flip = (axis & turn) != 0
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(flip, low, swap)
            axis ^= swap
        turn >>= 1
    x = np.bitwise_xor.accumulate(x, axis=0)  # Gray code over the axes
    last, turn = np.zeros(x.shape[1], np.int64), top
    while turn > 1:
        last ^= np.where(x[-1] & turn, turn - 1, 0)
        turn >>= 1
    x ^= last
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes, axis=0).T]


def ordered(rows: DataFrame, width: int, top: float, scale: float) -> DataFrame:
    """``vec_id, label, is_anchor, embedding, key``; the curve runs through cells of equal size that cover all components."""
    bits = max(1, min(8, KEY_BITS // width))
    high = max(float(np.floor(scale * top)) + 1, 1.0)
    kind, arrow = ("short", pa.int16()) if high < 1 << 15 else ("double", pa.float64())
    schema = f"vec_id long, label long, is_anchor boolean, embedding array<{kind}>, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(scale * matrix(batch.column("embedding"), width))
            cells = np.clip((values / high + 1) / 3 * (1 << bits), 0, (1 << bits) - 1)  # zero lies a third up, on no cell's edge
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()).cast(arrow), width).cast(pa.list_(arrow))
            yield pa.record_batch(
                [*[batch.column(c) for c in ("vec_id", "label", "is_anchor")], vectors, pa.array(curve_keys(cells, bits), pa.binary())],
                names=["vec_id", "label", "is_anchor", "embedding", "key"])

    return rows.select("vec_id", F.col("label").cast("long").alias("label"), "is_anchor", "embedding").mapInArrow(run, schema)


STORED = "is_batch boolean, grp long, num long, lo array<double>, hi array<double>, group_lo array<double>, group_hi array<double>, ids binary, labels binary, wide boolean, cells binary"


def packed(values: np.ndarray) -> tuple[bool, bytes]:
    narrow = not len(values) or np.abs(values).max() < 1 << 15
    return not narrow, values.astype(np.int16 if narrow else np.float64).tobytes()


def unpacked(row: dict, width: int) -> np.ndarray:
    return np.frombuffer(row["cells"], np.float64 if row["wide"] else np.int16).reshape(-1, width).astype(np.float64)


def stored(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """The blocks in curve order, and the anchors of every group in batches, written as one Parquet table. A block row
    holds its zone map (``lo``, ``hi``), the first block of a group also that of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, done = TaskContext.get().partitionId(), [], 0, 0

        def group() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, done
            ids, labels, anchors, values = (np.concatenate(x) for x in zip(*held, strict=True))
            grp, at = part + done * parts, np.flatnonzero(anchors)
            cuts = [(False, i, np.arange(i, min(i + BLOCK, n))) for i in range(0, n, BLOCK)] + [(True, i, at[i:i + BATCH]) for i in range(0, len(at), BATCH)]
            for is_batch, i, cut in cuts:
                wide, cells = packed(values[cut])
                first = not is_batch and i == 0
                yield pa.RecordBatch.from_pylist([{
                    "is_batch": is_batch, "grp": grp, "num": grp * GROUP_ROWS + i, "lo": values[cut].min(axis=0), "hi": values[cut].max(axis=0),
                    "group_lo": values.min(axis=0) if first else None, "group_hi": values.max(axis=0) if first else None,
                    "ids": ids[cut].tobytes(), "labels": labels[cut].tobytes(), "wide": wide, "cells": cells}], schema=arrow)
            held, n, done = [], 0, done + 1

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                cut = batch.slice(start, BLOCK)
                held.append((cut.column("vec_id").to_numpy(), cut.column("label").to_numpy(), cut.column("is_anchor").to_numpy(zero_copy_only=False), matrix(cut.column("embedding"), width)))
                n += cut.num_rows
                if n > GROUP_ROWS - BLOCK:
                    yield from group()
        if n:
            yield from group()

    numbers = pa.list_(pa.float64())
    arrow = pa.schema([("is_batch", pa.bool_()), ("grp", pa.int64()), ("num", pa.int64()), *[(c, numbers) for c in ("lo", "hi", "group_lo", "group_hi")],
                       ("ids", pa.binary()), ("labels", pa.binary()), ("wide", pa.bool_()), ("cells", pa.binary())])
    # the id is part of the order, so that many equal vectors do not share one range
    along = rows.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id").drop("key")
    return written(along.mapInArrow(run, STORED), "blocks")


def box_bounds(a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> tuple[Column, Column]:
    """Least and largest inner product of a vector of box a and one of box b, with room for rounding."""
    corners = F.zip_with(
        F.arrays_zip(F.col(a_lo).alias("l"), F.col(a_hi).alias("h")), F.arrays_zip(F.col(b_lo).alias("l"), F.col(b_hi).alias("h")),
        lambda a, b: F.array(a["l"] * b["l"], a["l"] * b["h"], a["h"] * b["l"], a["h"] * b["h"]))
    total = lambda each: F.aggregate(corners, F.lit(0.0), lambda s, c: s + each(c))
    room = total(lambda c: F.greatest(F.abs(F.array_max(c)), F.abs(F.array_min(c)))) * 1e-9
    return total(F.array_min) - room, total(F.array_max) + room


FOUND = "num long, at int, anchor_id long, mark long, mark_score long, vec_id long, score long"
WINDOWS = "array<struct<at: int, lo: double, hi: double, mark: long, mark_score: long>>"


def search(store: DataFrame, queries: DataFrame, parts: int, width: int, same_label: bool, k: int) -> DataFrame:
    """The ``k`` best rows of every window in every group its batch is sent to: batch, row of the anchor, mark of the window,
    ``vec_id``, ``score``. ``queries``: batches with ``grp`` and ``windows`` (none: an open window per anchor)."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def step(blocks: list[dict], batch: dict) -> Iterator[pa.RecordBatch]:
        a = unpacked(batch, width)
        own, label = np.frombuffer(batch["ids"], np.int64), np.frombuffer(batch["labels"], np.int64)
        if batch["windows"] is None:
            at = np.arange(len(a))
            floor, ceil, mark, mark_score = np.full(len(a), -np.inf), np.full(len(a), np.inf), [None] * len(a), [None] * len(a)
        else:
            at, floor, ceil, mark, mark_score = (list(x) for x in zip(*[(w["at"], w["lo"], w["hi"], w["mark"], w["mark_score"]) for w in batch["windows"]], strict=True))
            at, floor, ceil = np.array(at, np.int64), np.array(floor, np.float64), np.array(ceil, np.float64)
        lo, hi = (np.array([b[c] for b in blocks], np.float64) for c in ("lo", "hi"))
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        room = np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T
        exact = room.max() < EXACT
        room = 0.0 if exact else room * 1e-9
        most, least = up @ hi.T + down @ lo.T + room, up @ lo.T + down @ hi.T - room
        w, scores, ids = np.empty(0, np.int64), np.empty(0, np.float64 if exact else object), np.empty(0, np.int64)
        for b in np.argsort(-most.max(axis=0), kind="stable"):
            need = np.flatnonzero((most[at, b] >= floor) & (least[at, b] <= ceil))
            if not len(need):
                continue
            rows, where = np.unique(at[need], return_inverse=True)
            values, b_ids = unpacked(blocks[b], width), np.frombuffer(blocks[b]["ids"], np.int64)
            s = a[rows] @ values.T if exact else integers(a[rows]).dot(integers(values).T)
            fit = ((np.frombuffer(blocks[b]["labels"], np.int64) == label[rows][:, None]) == same_label) & (b_ids != own[rows][:, None])
            s = s[where]
            hit, c = np.nonzero(fit[where] & (s >= floor[need][:, None]).astype(bool) & (s <= ceil[need][:, None]).astype(bool))
            if not len(hit):
                continue
            w, scores, ids = np.r_[w, need[hit]], np.r_[scores, s[hit, c]], np.r_[ids, b_ids[c]]
            keep = best(w, scores, ids, k)
            w, scores, ids = w[keep], scores[keep], ids[keep]
            full = np.flatnonzero(w[k - 1:] == w[:max(0, len(w) - k + 1)])  # k entries from here on
            worst = scores[full + k - 1]
            floor[w[full]] = np.maximum(floor[w[full]], worst.astype(np.float64) - (0.0 if exact else np.abs(worst.astype(np.float64)) * 1e-9))
        if len(w):
            held = [min(max(int(x), -LONG - 1), LONG) for x in scores]
            yield pa.record_batch([
                pa.array(np.full(len(w), batch["num"])), pa.array(at[w].astype(np.int32)), pa.array(own[at[w]]), pa.array([mark[i] for i in w], pa.int64()),
                pa.array([mark_score[i] for i in w], pa.int64()), pa.array(ids), pa.array(held, pa.int64())], names=names)

    blocks = store.where("not is_batch").select("grp", "num", "lo", "hi", "ids", "labels", "wide", "cells")
    return meet(blocks, queries, parts, step, FOUND)


def integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def chosen(store: DataFrame, batches: DataFrame, windows: DataFrame, buckets: int, skip_home: bool) -> DataFrame:
    """Batches with ``windows`` and every group (``grp``) whose bounds meet a window. The stated anchors are tried against all groups, box against box;
    zone maps are dealt to ``buckets`` lists and every batch to all of them."""
    zones = store.where("group_lo is not null").select(F.col("grp").alias("zone"), "group_lo", "group_hi", F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket"))
    wanted = batches.join(windows, "num").withColumns({
        "from": F.array_min(F.transform("windows", lambda w: w["lo"])), "to": F.array_max(F.transform("windows", lambda w: w["hi"]))})
    lists = wanted.select(*[c for c in wanted.columns if c not in ("ids", "labels", "cells", "wide")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    least, most = box_bounds("lo", "hi", "group_lo", "group_hi")
    pairs = lists.join(zones, "bucket").where((most >= F.col("from")) & (least <= F.col("to")))
    if skip_home:
        pairs = pairs.where("zone <> grp")
    payload = wanted.select("num", "ids", "labels", "cells", "wide", "windows")
    return pairs.select("num", F.col("zone").alias("grp")).join(payload, "num")


def hard_negatives(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: float = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: ``vec_id, label, embedding, is_anchor``. For each anchor and each of its ``positives`` best rows of the same label,
    the ``negatives`` best rows of other labels whose score is ``window`` per cent of the positive's."""
    rows = written(clean(rows.where(F.col("label").isNotNull()), ("label", "is_anchor")), "vectors")
    n, width, top = measure(rows)
    parts = group_count(rows, n)
    store = stored(ordered(rows, width, top, scale), parts, width)
    batches = store.where("is_batch").select("grp", "num", "lo", "hi", "ids", "labels", "wide", "cells")

    none = F.lit(None).cast("long")
    window_of = lambda lo, hi, mark, score: F.struct("at", lo.alias("lo"), hi.alias("hi"), mark.alias("mark"), score.alias("mark_score"))
    by_batch = lambda df, w: df.groupBy("num").agg(F.collect_list(w).cast(WINDOWS).alias("windows"))  # noqa: E731  (a batch's windows)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))

    home = written(search(store, batches.drop("lo", "hi").withColumn("windows", F.lit(None).cast(WINDOWS)), parts, width, True, positives), "home")
    # the anchors of a batch, with the worst score that may still be among the best
    anchors = batches.select("num", F.posexplode(F.sequence(F.lit(1).cast("long"), (F.octet_length("ids") / 8).cast("long"))).alias("at", "_")).drop("_")
    floor = home.groupBy("num", "at").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    open_window = window_of(F.when(F.col("n") >= positives, F.col("worst")).otherwise(float("-inf")).cast("double"), F.lit(float("inf")), none, none)
    first = by_batch(anchors.join(floor, ["num", "at"], "left"), open_window)
    away = search(store, chosen(store, batches, first, parts, True), parts, width, True, positives)
    near = home.unionByName(away).withColumn("rank", rank("num", "at")).where(F.col("rank") <= positives)
    near = written(near.select("num", "at", "vec_id", "score"), "positives")

    low, high = window
    score = F.col("score").cast("decimal(38,0)")
    bounds = window_of(F.ceil(score * low / 100).cast("double"), F.floor(score * high / 100).cast("double"), F.col("vec_id"), F.col("score"))
    windows = by_batch(near, bounds).withColumn("windows", F.filter("windows", lambda w: w["lo"] <= w["hi"])).where(F.size("windows") > 0)
    found = search(store, chosen(store, batches, windows, parts, False), parts, width, False, negatives)
    ranked = found.withColumn("rank", rank("num", "at", "mark")).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", F.col("mark").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("mark_score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hilbert_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("is_anchor")))


ORACLE = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS cells
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.cells, b.cells)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE label <> positives.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
