"""Vectors cut into bounded groups of blocks, and the meeting of query batches with the groups they need.

A group holds at most ``GROUP_ROWS`` vectors and is one row of work: its blocks are read once, then the query batches sent to it pass by.
Only batches are copied (once per group they need), so what moves is the vectors once and the queries times the groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

GROUP_ROWS = 1 << 17
LEAST_GROUP_ROWS = 1 << 11


def clean(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, embedding, *more``: one row per id, without null ids, null vectors, and null or non-finite components.

    Of rows that share an id the one with the smallest other columns stays. Ids are reduced before the shuffle."""
    if not isinstance(rows.schema["embedding"].dataType.elementType, (FloatType, DoubleType)):
        rows = rows.withColumn("embedding", F.col("embedding").cast(ArrayType(DoubleType())))
    finite: Callable[[Column], Column] = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    sound = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", finite))
    one = sound.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(*more, "embedding")).alias("v"))
    return one.select("vec_id", "v.embedding", *[f"v.{c}" for c in more])


def measure(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, longest vector (1 at least) and largest absolute component."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("top")).first()
    return r["n"], max(1, r["d"] or 0), float(r["top"] or 0.0)


def group_count(rows: DataFrame, n: int) -> int:
    """Groups of at most ``GROUP_ROWS`` rows, and enough of them for all cores unless they would get very small."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // GROUP_ROWS), min(2 * cores, -(-n // LEAST_GROUP_ROWS)))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A row of doubles per vector; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` entries of every row with the highest scores, ties by smaller id; ordered by row and rank."""
    falling = -np.unique(scores, return_inverse=True)[1] if scores.dtype == object else -scores
    order = np.lexsort((ids, falling, rows))
    at = rows[order]
    opens = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    rank = np.arange(len(at)) - np.repeat(opens, np.diff(np.r_[opens, len(at)]))
    return order[rank < k]


def meet(groups: DataFrame, queries: DataFrame, parts: int, step: Callable[[list[dict], dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``step(blocks of the group, query batch)`` for every row of ``queries``, which has the group (``grp``) it goes to.

    ``groups``: ``grp``, ``num`` and the columns of a block. Groups that no batch needs are not read on. Groups are dealt
    out by number, one to a task where there are as many tasks."""
    wanted = groups.join(queries.select("grp").distinct(), "grp", "left_semi")
    rows = wanted.withColumn("is_query", F.lit(False)).unionByName(queries.withColumn("is_query", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] != current:
                    current, blocks = row["grp"], []
                if row["is_query"]:
                    yield from step(blocks, row)
                else:
                    blocks.append(row)

    return rows.repartitionById(parts, F.pmod("grp", F.lit(parts)).cast("int")).sortWithinPartitions("grp", "is_query", "num").mapInArrow(run, schema)
