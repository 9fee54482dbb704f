"""Order-dependent building blocks that never put one key into one task.

Logs are ordered, and one source (or one trace, or one template) may hold a large
part of all rows, so ``Window.partitionBy(source)`` is not usable as it stands.
Every helper here cuts a key into *segments* of bounded size first:

``running``        prefix scan: per-segment summaries, a prefix over the summaries,
                   then the ordinary window inside each segment.
``with_context``   sliding frames: each segment also receives the rows of the
                   previous segment that its frames can reach.
``quantile_at``    exact order statistics: a mergeable sketch brackets the wanted
                   rank, only the bracket is sorted.
``chained_fold``   sequential automata (gates, sessions, clustering): segments run
                   in parallel on an assumed start state, and a segment is run again
                   only if the state handed to it turns out to be a different one.
"""

from __future__ import annotations

import json
import tempfile
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SEG = "__seg"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local sessions that name none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="runlens-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def computed_once(df: DataFrame) -> DataFrame:
    """Keep later filters above columns that are expensive to compute.

    Catalyst copies the expressions of a filtered column into a filter below the
    projection and evaluates them twice, chained ones many times over. The row id is not
    deterministic, so nothing is moved below it. Filters on plain columns belong in front.
    """
    row = F.rand(0) if df.isStreaming else F.monotonically_increasing_id()  # streams have no row ids
    return df.withColumn("__row", row).where("__row >= 0").drop("__row")


# --------------------------------------------------------------------------- running


@dataclass(frozen=True)
class Running:
    """One running column: ``how`` in count / sum / max / min / last / before / lag / since."""

    how: str
    col: Column | None = None


def count() -> Running:
    return Running("count", F.lit(1))


def total(col: Column) -> Running:
    return Running("sum", col)


def highest(col: Column) -> Running:
    return Running("max", col)


def lowest(col: Column) -> Running:
    return Running("min", col)


def last(col: Column) -> Running:
    """Last non-null value up to and including the current row."""
    return Running("last", col)


def before(col: Column) -> Running:
    """Last non-null value of the rows before the current one."""
    return Running("before", col)


def lag(col: Column) -> Running:
    """Value of the row before the current one (null on the first row)."""
    return Running("lag", col)


def since(flag: Column) -> Running:
    """Rows since the last flagged row: 0 on it, 1 on the next; the first row of a key counts as flagged."""
    return Running("since", flag)


def segment_of(order: str, size: int) -> Column:
    return F.expr(f"`{order}` div {int(size)}")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, Running],
    segment_rows: int = 100_000,
    reverse: bool = False,
) -> DataFrame:
    """Add running columns per key in the order of the unique integer column ``order``.

    Because ``order`` is unique inside a key, the segment ``order div segment_rows``
    holds at most ``segment_rows`` rows whatever the size of the key. Only summaries
    (one row per key and segment) are ordered over the whole key, and only keys that
    span more than one segment take part in the join back. ``reverse`` scans from the
    end, so ``lag`` reads the following row and ``last`` the next non-null value.
    ``df`` is read twice (summaries, rows): make it ``durable`` before chaining scans.
    """
    base = df.withColumn(SEG, segment_of(order, segment_rows))
    inputs = {f"__in_{n}": r.col for n, r in columns.items() if r.col is not None}
    base = base.withColumns(inputs)
    direction = -F.col(order) if reverse else F.col(order)

    parts, prefix, extra = [], [], {}
    local = Window.partitionBy(*keys, SEG).orderBy(
        F.col(order).desc() if reverse else F.col(order).asc()
    )
    numbers_needed = any(r.how == "since" for r in columns.values())
    if numbers_needed:
        base = base.withColumn("__ln", F.row_number().over(local))
        parts.append(F.count(F.lit(1)).alias("__rows"))
    over_summaries = (
        Window.partitionBy(*keys)
        .orderBy(F.col(SEG).desc() if reverse else F.col(SEG).asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for name, r in columns.items():
        value, part = F.col(f"__in_{name}"), f"__s_{name}"
        if r.how in ("count", "sum"):
            parts.append(F.sum(value).alias(part))
            prefix.append(F.sum(part).over(over_summaries))
        elif r.how in ("max", "min"):
            agg = F.max if r.how == "max" else F.min
            parts.append(agg(value).alias(part))
            prefix.append(agg(part).over(over_summaries))
        elif r.how in ("last", "before"):
            parts.append(F.max_by(value, F.when(value.isNotNull(), direction)).alias(part))
            prefix.append(F.last(part, ignorenulls=True).over(over_summaries))
        elif r.how == "lag":
            parts.append(F.max_by(F.struct(value.alias("v")), direction).alias(part))
            prefix.append(F.last(part).over(over_summaries)["v"])
        elif r.how == "since":
            parts.append(F.max(F.when(value, F.col("__ln"))).alias(part))
            extra[f"__a_{name}"] = F.col("__before") + F.col(part)
            prefix.append(F.last(f"__a_{name}", ignorenulls=True).over(over_summaries))
        else:
            raise ValueError(r.how)
    rank = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col(SEG).desc() if reverse else F.col(SEG).asc())
    )
    summaries = base.groupBy(*keys, SEG).agg(*parts)
    if numbers_needed:
        ahead = F.coalesce(F.sum("__rows").over(over_summaries), F.lit(0))
        summaries = summaries.withColumn("__before", ahead).withColumns(extra)
    carried = ["__before"] if numbers_needed else []
    before = (
        summaries.select(
            *keys,
            SEG,
            rank.alias("__rank"),
            *carried,
            *[p.alias(f"__p_{n}") for n, p in zip(columns, prefix)],
        )
        .where("__rank > 1")
        .drop("__rank")
    )

    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    joined = base.join(before, [*keys, SEG], "left")
    out = {}
    for name, r in columns.items():
        value, start = F.col(f"__in_{name}"), F.col(f"__p_{name}")
        if r.how in ("count", "sum"):
            out[name] = F.coalesce(start, F.lit(0)) + F.coalesce(F.sum(value).over(upto), F.lit(0))
        elif r.how == "max":
            out[name] = F.greatest(start, F.max(value).over(upto))
        elif r.how == "min":
            out[name] = F.least(start, F.min(value).over(upto))
        elif r.how == "last":
            out[name] = F.coalesce(F.last(value, ignorenulls=True).over(upto), start)
        elif r.how == "before":
            earlier = local.rowsBetween(Window.unboundedPreceding, -1)
            out[name] = F.coalesce(F.last(value, ignorenulls=True).over(earlier), start)
        elif r.how == "since":
            at = F.coalesce(F.col("__before"), F.lit(0)) + F.col("__ln")
            flagged = F.coalesce(F.last(F.when(value, at), ignorenulls=True).over(upto), start, F.lit(1))
            out[name] = at - flagged
        else:
            out[name] = F.when(F.row_number().over(local) == 1, start).otherwise(
                F.lag(value).over(local)
            )
    result = joined.withColumns(out)
    return result.drop(SEG, "__ln", "__before", *inputs, *[f"__p_{n}" for n in columns])


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "pos", segment_rows: int = 100_000
) -> DataFrame:
    """Dense 0-based position of each row inside its key."""
    out = running(df, keys, order, {name: count()}, segment_rows)
    return out.withColumn(name, F.col(name).cast("long") - 1)


# ---------------------------------------------------------------------- sliding frames


def with_context(df: DataFrame, order: str, size: int, reach: int) -> DataFrame:
    """Cut ``order`` into chunks of ``size`` and copy to every chunk the rows up to
    ``reach`` before it. Adds ``chunk`` and ``is_context``; frames that look back at
    most ``reach`` are then exact inside (key, chunk). Needs ``reach <= size``."""
    if reach > size:
        raise ValueError("reach must not exceed size")
    chunk = segment_of(order, size)
    own = F.struct(chunk.alias("chunk"), F.lit(False).alias("is_context"))
    nxt = F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("is_context"))
    offset = F.col(order) - chunk * F.lit(size)
    copies = F.when(offset >= size - reach, F.array(own, nxt)).otherwise(F.array(own))
    return df.withColumn("__c", F.explode(copies)).select(
        *[F.col(c) for c in df.columns], "__c.chunk", "__c.is_context"
    )


# ------------------------------------------------------------------- exact quantiles

MEDIAN = "median"  # mean of the two middle values
P95_FLOOR = "p95"  # sorted[min(n - 1, int(n * 0.95))]
UPPER_MEDIAN = "upper_median"  # sorted[n // 2]


def _ranks(how: str, n: Column) -> list[Column]:
    """Wanted 1-based ranks in a sorted list of ``n`` values."""
    if how == MEDIAN:
        return [F.floor((n + 1) / 2), F.floor(n / 2) + 1]
    if how == P95_FLOOR:
        return [F.least(n - 1, F.floor(n * F.lit(0.95))) + 1]
    if how == UPPER_MEDIAN:
        return [F.floor(n / 2) + 1]
    raise ValueError(how)


_CENTRE = {MEDIAN: 0.5, P95_FLOOR: 0.95, UPPER_MEDIAN: 0.5}


def quantile_at(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    statistics: dict[str, str],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact order statistics per key without sorting or collecting a whole key.

    1. One mergeable sketch per key gives two values that bracket the wanted rank.
    2. Rows below the bracket are only counted, rows inside it are collapsed to
       (value, count), so ties cost nothing and the sorted part is a 1/1000 share.
    3. The running count inside the bracket yields the value at the exact rank.

    Returns one row per key: keys, ``n`` and one column per entry of ``statistics``
    (name -> MEDIAN | P95_FLOOR | UPPER_MEDIAN). A sketch error beyond its guarantee
    cannot give a wrong value: the result would be null.
    """
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    margin = 5.0 / accuracy
    probes = []
    for how in statistics.values():
        probes += [max(0.0, _CENTRE[how] - margin), min(1.0, _CENTRE[how] + margin)]
    # groups smaller than the sketch resolution are kept whole by it
    sketch = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("__v", probes, accuracy).alias("__b"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
    )
    small = F.col("n") <= 64
    bounds = []
    for i, name in enumerate(statistics):
        bounds += [
            F.when(small, F.col("__min")).otherwise(F.col("__b")[2 * i]).alias(f"__lo_{name}"),
            F.when(small, F.col("__max")).otherwise(F.col("__b")[2 * i + 1]).alias(f"__hi_{name}"),
        ]
    sketch = sketch.select(*keys, "n", *bounds)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    marked = src.alias("l").join(sketch.alias("r"), cond).select(
        *[F.col(f"l.{k}").alias(k) for k in keys], "__v", "n",
        *[f"__{s}_{n}" for n in statistics for s in ("lo", "hi")],
    )
    # rows outside every bracket are counted under one representative value per side
    slot = F.lit(None).cast(src.schema["__v"].dataType)
    inside = F.lit(False)
    for name in statistics:
        inside = inside | ((F.col("__v") >= F.col(f"__lo_{name}")) & (F.col("__v") <= F.col(f"__hi_{name}")))
    edges = F.array(*[F.col(f"__lo_{n}") for n in statistics])
    # number of brackets that start above the value tells in which outer gap it lies
    gap = F.size(F.filter(edges, lambda e: e > F.col("__v")))
    counted = (
        marked.withColumn("__in", inside)
        .withColumn("__gap", F.when(F.col("__in"), F.lit(-1)).otherwise(gap))
        .withColumn("__val", F.when(F.col("__in"), F.col("__v")).otherwise(slot))
        .groupBy(*keys, "n", "__gap", "__val")
        .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__at"))
    )
    order = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = counted.withColumn("__upto", F.sum("__c").over(order))
    picks = []
    for name, how in statistics.items():
        at = [
            F.max(
                F.when(
                    (F.col("__upto") >= r) & (F.col("__upto") - F.col("__c") < r), F.col("__val")
                )
            )
            for r in _ranks(how, F.col("n"))
        ]
        pick = at[0] if len(at) == 1 else (at[0] + at[1]) / 2
        picks.append(pick.alias(name))
    return cumulative.groupBy(*keys, "n").agg(*picks)


# ---------------------------------------------------------------------- group folds

Rows = dict[str, list]
Step = Callable[[dict, Rows], tuple[dict, Rows]]


def _fold_groups(
    step: Step, group: list[str], data: list[str], key_count: int, states_only: bool, schema: pa.Schema
):
    """Arrow-batch function: run ``step`` on every group of a partition sorted by group.

    A group opens with its state row (``__kind`` 0, if there is one). Only the rows of
    the current group are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {name: [] for name in schema.names}
        current, start = None, "{}"
        held: Rows = {c: [] for c in data}

        def close() -> None:
            nonlocal held
            if current is None or not held[data[0]]:
                return
            state, result = step(json.loads(start), held)
            if states_only:
                values = (*current, start, json.dumps(state, sort_keys=True))
                for name, value in zip(schema.names, values):
                    out[name].append(value)
            else:
                size = len(next(iter(result.values()))) if result else 0
                for i in range(key_count):
                    out[schema.names[i]].extend([current[i]] * size)
                for name, values in result.items():
                    out[name].extend(values)
            held = {c: [] for c in data}

        def drain() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_pydict(out, schema=schema)
            out = {name: [] for name in schema.names}
            return batch

        for batch in batches:
            columns = batch.to_pydict()
            keys = list(zip(*[columns[g] for g in group]))
            kinds, starts = columns["__kind"], columns["__start"]
            begin, n = 0, len(keys)
            while begin < n:
                end = begin + 1
                while end < n and keys[end] == keys[begin]:
                    end += 1
                if keys[begin] != current:
                    close()
                    current, start = keys[begin], "{}"
                first = begin
                if kinds[begin] == 0:
                    start, first = starts[begin], begin + 1
                for c in data:
                    held[c].extend(columns[c][first:end])
                begin = end
            if len(out[schema.names[0]]) >= 10_000:
                yield drain()
        close()
        yield drain()

    return run


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    reach: int = 200,
    how: str = MEDIAN,
    chunk_rows: int = 20_000,
    segment_rows: int = 100_000,
) -> DataFrame:
    """Statistic over the ``reach`` rows before each row: columns ``prior_n`` and ``prior``.

    Rows are numbered, cut into chunks that carry ``reach`` rows of context, and every
    chunk keeps one sorted window of the last values (an insertion and a removal per
    row); a Spark frame would rebuild the whole window for every row.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns if c not in keys)
    placed = numbered(df, keys, order, "__pos", segment_rows)
    chunked = with_context(placed, "__pos", chunk_rows, reach)
    names = [c for c in df.columns if c not in keys]

    def step(state: dict, rows: Rows) -> tuple[dict, Rows]:
        out: Rows = {c: [] for c in (*names, "prior_n", "prior")}
        window: list[float] = []
        arrived: deque[float] = deque()
        for i, v in enumerate(rows[value]):
            n = len(window)
            if not rows["is_context"][i]:
                for c in names:
                    out[c].append(rows[c][i])
                out["prior_n"].append(n)
                if n == 0:
                    out["prior"].append(None)
                elif how == UPPER_MEDIAN or n % 2:
                    out["prior"].append(float(window[n // 2]))
                else:
                    out["prior"].append((window[n // 2 - 1] + window[n // 2]) / 2)
            insort(window, v)
            arrived.append(v)
            if len(arrived) > reach:
                del window[bisect_left(window, arrived.popleft())]
        return state, out

    return grouped_step(
        chunked, [*keys, "chunk"], "__pos", step, f"{fields}, prior_n long, prior double", list(keys)
    )


def grouped_step(
    df: DataFrame, group: list[str], order: str, step: Step, out_schema: str, keep: list[str] | None = None
) -> DataFrame:
    """``step`` once per (bounded) group, in order; output follows the columns ``keep`` of
    the group (a leading part of it, all by default)."""
    keep = group if keep is None else keep
    schema = T.StructType([*[df.schema[k] for k in keep], *T.StructType.fromDDL(out_schema).fields])
    data = [c for c in df.columns if c not in group]
    marked = df.withColumns({"__kind": F.lit(1), "__start": F.lit(None).cast("string")})
    return (
        marked.repartition(*group)
        .sortWithinPartitions(*group, order)
        .mapInArrow(
            _fold_groups(step, group, data, len(keep), False, to_arrow_schema(schema)), schema
        )
    )


def chained_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    step: Step,
    out_schema: str,
    segment_rows: int = 200_000,
    in_turn: bool = False,
    dense: bool = False,
    max_rounds: int = 100_000,
) -> DataFrame:
    """Run a sequential automaton per key over segments of at most ``segment_rows`` rows.

    ``step(state, rows) -> (state, output)`` sees the ordered rows of one segment as
    column lists and a JSON-serialisable state; ``output`` has the columns of
    ``out_schema``, which follow the keys. All segments start in parallel from the empty
    state. A segment whose predecessor ended in another state than assumed is run again,
    until every handed-over state is the assumed one; that is the sequential result.
    Automata that forget (cooldowns, gates, idle sessions) settle after two or three
    rounds; ``in_turn`` is for those that never forget and runs one stale segment per key
    at a time, so that later ones are not run in vain. Keys with one segment take no
    extra round. ``dense`` numbers sparse rows first, so that segments are full.
    """
    df = durable(df)
    placed, by = df, order
    if dense:
        placed, by = numbered(df, keys, order, "__pos"), "__pos"
    rows = placed.withColumn(SEG, segment_of(by, segment_rows)).drop("__pos")
    group, data = [*keys, SEG], [c for c in df.columns if c not in keys]
    key_fields = [rows.schema[k] for k in keys]
    seg_field = T.StructField(SEG, T.LongType())
    state_schema = T.StructType([
        *key_fields, seg_field,
        T.StructField("start", T.StringType()), T.StructField("finish", T.StringType()),
    ])
    result_schema = T.StructType([*key_fields, *T.StructType.fromDDL(out_schema).fields])

    def apply(part: DataFrame, states: DataFrame | None, states_only: bool) -> DataFrame:
        marked = part.withColumns({"__kind": F.lit(1), "__start": F.lit(None).cast("string")})
        if states is not None:
            heads = states.select(*group, F.col("start").alias("__start"), F.lit(0).alias("__kind"))
            marked = marked.unionByName(heads, allowMissingColumns=True)
        schema = state_schema if states_only else result_schema
        return (
            marked.repartition(*group)
            .sortWithinPartitions(*group, "__kind", order)
            .mapInArrow(
                _fold_groups(step, group, data, len(keys), states_only, to_arrow_schema(schema)), schema
            )
        )

    several = rows.groupBy(*keys).agg(F.min(SEG).alias("a"), F.max(SEG).alias("b")).where("a < b")
    if several.isEmpty():
        return apply(rows, None, False)
    rows = durable(rows) if dense else rows

    states = durable(apply(rows, None, True))
    along = Window.partitionBy(*keys).orderBy(SEG)
    for _ in range(max_rounds):
        handed = states.withColumn("handed", F.coalesce(F.lag("finish").over(along), F.lit("{}")))
        stale = handed.where("handed <> start")
        if in_turn:
            stale = stale.withColumn("__turn", F.row_number().over(along)).where("__turn = 1")
        stale = durable(stale.select(*group, F.col("handed").alias("start")))
        if stale.isEmpty():
            return apply(rows, states, False)
        again = apply(rows.join(stale.select(*group), group, "left_semi"), stale, True)
        states = durable(states.join(stale.select(*group), group, "left_anti").unionByName(again))
    raise RuntimeError("chained_fold did not settle")
