"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector o is divided by its length, extended by zeros to ``L`` dimensions and turned by a random rotation; its code is the sign of every
turned component, ``L`` bits. With the code goes one correction scalar f, the inner product of the turned unit vector with the unit
vector its signs point along. For a query q, turned alike, ``|o| * <signs, q> / (f * sqrt(L))`` estimates <o, q> without bias, and the error
exceeds ``bound * |o| |q| * sqrt((1 - f^2) / (f^2 (L - 1)))`` in a share of cases that falls as a normal tail of ``bound`` deviations.

Vectors lie in bounded groups of blocks (codes, scalars and vectors side by side); query batches are copied to every group. In a group
a query keeps its best exact scores so far; a vector is read only if its estimate plus error bound reaches the worst of
them, and is then scored exactly. So every score returned is exact, and what a bound of 4 deviations misses is about one
true neighbour in 30,000 (a parameter; tests measure the recall against a full search). Codes of ``L = 256`` or more bits hold 32 bytes where 64 floats hold 256.

Edge cases: a row with a null id, a null or zero vector, a null or non-finite component takes no part. Of rows that share an id
the one with the smallest vector stays. Shorter vectors end in zeros. Equal vectors have equal scores (components are added in order), and
equal scores are ordered by id. A query with fewer candidates than asked for gets all of them. A table of one row, or an empty one, gives no
rows. Scores beyond the range of a double are infinite. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, per_worker, written
from .vector_blocks import GROUP_ROWS, best, clean, group_count, matrix, measure, meet

NEIGHBOURS = 20
BOUND = 4.0
LEAST_BITS = 256
BLOCK = 2048
#: queries of a batch
BATCH = 256
#: vectors scored at a time
SLICE = 1 << 14
SEED = 20


def code_bits(width: int) -> int:
    return max(LEAST_BITS, -(-width // 64) * 64)


def rotation(bits: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every worker."""

    def make() -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, bits)))
        return q * np.sign(np.diag(r))

    return per_worker(f"rotation-{bits}", make)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their lengths, and these. Scaled first, so that no square overflows."""
    top = np.abs(x).max(axis=1, keepdims=True)
    small = x / top
    length = np.sqrt((small * small).sum(axis=1, keepdims=True))
    return small / length, (length * top)[:, 0]


def turned(unit: np.ndarray, bits: int) -> np.ndarray:
    return unit @ rotation(bits)[:unit.shape[1]]


def encoded(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, correction scalars, lengths."""
    unit, length = units(x)
    y = turned(unit, bits)
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(bits), length


def estimates(codes: np.ndarray, scalar: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of the inner products of unit vectors with turned unit queries: a row per vector, a column per query."""
    bits = query.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    return signs @ query.T.astype(np.float32) / (scalar * np.sqrt(bits)).astype(np.float32)[:, None]


def errors(scalar: np.ndarray, bits: int, bound: float) -> np.ndarray:
    """The error bounds of ``estimates``, and what single precision adds."""
    return bound * np.sqrt(np.maximum(1 - scalar**2, 0) / (scalar**2 * (bits - 1))) + 1e-4


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, components added from the first to the last."""
    return (x * q).cumsum(axis=1)[:, -1]


STORED = "is_batch boolean, grp long, num long, ids binary, codes binary, scalars binary, lengths binary, vectors binary"


def stored(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """Blocks of codes, scalars and vectors, and the queries of every group in batches, written as one Parquet table."""
    bits = code_bits(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, done = TaskContext.get().partitionId(), [], 0, 0

        def group() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, done
            ids, asks, x = (np.concatenate(v) for v in zip(*held, strict=True))
            grp, at = part + done * parts, np.flatnonzero(asks)
            for i in range(0, n, BLOCK):
                cut = slice(i, i + BLOCK)
                codes, scalar, length = encoded(x[cut], bits)
                yield pa.RecordBatch.from_pylist([{
                    "is_batch": False, "grp": grp, "num": grp * GROUP_ROWS + i, "ids": ids[cut].tobytes(), "codes": codes.tobytes(), "scalars": scalar.tobytes(),
                    "lengths": length.tobytes(), "vectors": x[cut].tobytes()}], schema=arrow)
            for i in range(0, len(at), BATCH):
                cut = at[i:i + BATCH]
                yield pa.RecordBatch.from_pylist([{"is_batch": True, "grp": grp, "num": grp * GROUP_ROWS + i, "ids": ids[cut].tobytes(), "vectors": x[cut].tobytes()}], schema=arrow)
            held, n, done = [], 0, done + 1

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                cut = batch.slice(start, BLOCK)
                held.append((cut.column("vec_id").to_numpy(), cut.column("is_query").to_numpy(zero_copy_only=False), matrix(cut.column("embedding"), width)))
                n += cut.num_rows
                if n > GROUP_ROWS - BLOCK:
                    yield from group()
        if n:
            yield from group()

    arrow = pa.schema([("is_batch", pa.bool_()), ("grp", pa.int64()), ("num", pa.int64()), *[(c, pa.binary()) for c in ("ids", "codes", "scalars", "lengths", "vectors")]])
    place = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")  # ids are distinct, so groups are even
    return written(rows.repartitionById(parts, place).select("vec_id", "is_query", "embedding").mapInArrow(run, STORED), "codes")


def nearest(rows: DataFrame, k: int = NEIGHBOURS, bound: float = BOUND) -> DataFrame:
    """``query_id, rank, vec_id, score``: of every row with ``is_query`` the ``k`` other rows with the largest inner product.

    ``rows``: ``vec_id, embedding, is_query``."""
    rows = clean(rows, ("is_query",)).where(F.exists("embedding", lambda x: x != 0))
    rows = written(rows, "vectors")
    n, width, _ = measure(rows)
    parts, bits = group_count(rows, n), code_bits(width)
    store = stored(rows, parts, width)
    schema = "query_id long, vec_id long, score double"

    def step(blocks: list[dict], batch: dict) -> Iterator[pa.RecordBatch]:
        q = np.frombuffer(batch["vectors"]).reshape(-1, width)
        own = np.frombuffer(batch["ids"], np.int64)
        unit, length = units(q)
        turn = turned(unit, bits)
        who, score, ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        worst = np.full(len(q), -np.inf)  # of k exact scores, divided by the query's length

        def add(rows_at: np.ndarray, queries_at: np.ndarray) -> None:
            nonlocal who, score, ids
            other = b_ids[rows_at] != own[queries_at]
            rows_at, queries_at = rows_at[other], queries_at[other]
            for i in range(0, len(rows_at), SLICE):
                r, c = rows_at[i:i + SLICE], queries_at[i:i + SLICE]
                # the same sum in the fastest order of addition tells which cannot matter
                may = np.einsum("ij,ij->i", x[r], q[c]) >= length[c] * (worst[c] - 1e-9 * lengths[r])
                r, c = r[may], c[may]
                who, score, ids = np.r_[who, c], np.r_[score, exact(x[r], q[c])], np.r_[ids, b_ids[r]]
                keep = best(who, score, ids, k)
                who, score, ids = who[keep], score[keep], ids[keep]
            full = np.flatnonzero(who[k - 1:] == who[:max(0, len(who) - k + 1)])
            worst[who[full]] = score[full + k - 1] / length[who[full]]

        for block in blocks:
            b_ids, x = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["vectors"]).reshape(-1, width)
            scalar, lengths = np.frombuffer(block["scalars"]), np.frombuffer(block["lengths"])
            near = estimates(np.frombuffer(block["codes"], np.uint8).reshape(len(x), -1), scalar, turn) * lengths[:, None]
            upper = near + (errors(scalar, bits, bound) * lengths)[:, None]
            seen = np.zeros(near.shape, bool)
            new = np.flatnonzero(~np.isfinite(worst))
            if len(new):  # a first reading of the best estimates gives these queries a score to reach
                m = min(2 * k, len(x))
                first = np.argpartition(near[:, new], len(x) - m, axis=0)[len(x) - m:]
                seen[first, new] = True
                r, c = np.nonzero(seen)
                add(r, c)
            c, r = np.nonzero(((upper >= worst) & ~seen).T)
            add(r, c)
        if len(who):
            yield pa.record_batch([pa.array(own[who]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    blocks = store.where("not is_batch").drop("is_batch")
    home = store.where("is_batch").select("grp", "num", "ids", "vectors")
    every = store.where("not is_batch").select(F.col("grp").alias("to")).distinct()
    buckets = 4 * rows.sparkSession.sparkContext.defaultParallelism
    # the stated queries against all groups: groups are dealt to a fixed number of lists, and every batch goes to all lists
    lists = home.select("num", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    pairs = lists.join(every.withColumn("bucket", F.pmod(F.xxhash64("to"), F.lit(buckets))), "bucket").select("num", F.col("to").alias("grp"))
    found = meet(blocks, pairs.join(home.drop("grp"), "num"), parts, step, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_one_bit_codes(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(load(spark, folder, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 20 == 0).alias("is_query")))


#: the full search
ORACLE = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM sound a JOIN sound b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 20
"""
