"""Filter interaction audit: what every order of the filters removes, keeps and loses, per part.

Each document gets a mask of the filters it fails; masks are counted per part (partial aggregation, so a part that holds a
third of all rows sends at most ``4 * 2^k`` rows per task). Of the at most ``2^k`` counts of a part a decision diagram is built:
a level per filter, an edge for failing it and one for passing it, equal sub-diagrams shared, every node weighted by the
documents below it. One order is turned into the next by swapping two adjacent levels, which rewrites these two levels only
and leaves the nodes above and below as they are; plain changes visit all ``k!`` orders by one swap each. In an order, the path that
always passes gives the steps: the weight of the passing edge is kept, that of the failing edge removed.

The five filters of ``op13``: under 200 words; under half of the words distinct; over 3 % of the code points in A-Z; one of
``#$%&*|`` present; text equal to that of a smaller doc_id anywhere in the table.

Edge cases: a null text is empty, a null part the empty string. Every row counts, repeated ones too; rows of one doc_id never
make each other duplicates, and a row without doc_id is no duplicate. The smallest doc_id of equal texts passes, whatever its
part. Several label rows of a document: it has a flag if one of them has it; a null doc_id has no labels. Very long texts are read whole, in C loops over
their bytes. An empty table gives no rows. Columns beyond the named ones are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

FILTERS = "ABCDE"
LEAST_WORDS = 200
SPECIAL = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: bytes of UTF-8 that open no code point
INNER = bytes(range(0x80, 0xC0))

Weight = tuple[int, ...]
#: kept, removed: one weight each, per step
Steps = list[tuple[Weight, Weight]]


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # of bytes: space and 9-13 only
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * upper > 3 * len(text.translate(None, INNER))) << 2
        | (len(text.translate(None, SPECIAL)) < len(text)) << 3
    )


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every row; ``mask`` holds the filters that need the text alone."""
    schema = "doc_id long, part string, digest binary, mask int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, masks = [], []
            for value in batch.column("text"):
                text = value.as_py()
                marks.append(hashlib.sha256(text).digest())
                masks.append(text_mask(text))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("part"), pa.array(marks, pa.binary()), pa.array(masks, pa.int32())],
                names=["doc_id", "part", "digest", "mask"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, schema)


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows per failure mask (bit i: filter i fails), and those with either label.

    Rows of equal text differ in filter E alone: all fail it but those of the smallest id. Texts are therefore reduced to
    their digests before anything is shuffled, and a text copied over a third of the table to its groups of equal part and labels
    before its smallest id is sought."""
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    # rows without an id are dealt by their text instead of all to one task
    keyed = judged(docs).withColumns({"named": F.col("doc_id").isNotNull(), "key": F.coalesce("doc_id", F.xxhash64("digest"))})
    flags = flags.select(F.col("labelled").alias("key"), F.lit(True).alias("named"), "is_good", "is_toxic")
    joined = keyed.join(flags, ["key", "named"], "left").na.fill(False, ["is_good", "is_toxic"])
    kind = ["digest", "part", "mask", "is_good", "is_toxic"]
    by_id = joined.groupBy("key", "named", *kind).agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("named"), F.struct(F.col("key").alias("id"), F.col("n").alias("n")))
    groups = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(~F.col("named"), F.col("n")).otherwise(0)).alias("unnamed"), F.min(own).alias("first"))
    # one row per digest and kind: a few per text, however many copies it has
    least = F.min("first.id").over(Window.partitionBy("digest"))
    passing = F.col("unnamed") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    settled = groups.select("part", "is_good", "is_toxic", "mask", "n", passing.alias("passing"))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    flat = settled.select("part", "is_good", "is_toxic", F.inline(both)).where("n > 0")
    return flat.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


class Diagram:
    """A decision diagram over failure masks whose nodes carry the weight of the documents below them.

    Every path tests every filter: a filter left out of a path would lose its share of the weight."""

    def __init__(self, filters: Sequence[str], counts: dict[int, Weight]) -> None:
        self.order = list(filters)
        self.weights: list[Weight] = []
        self.levels: list[dict[int, tuple[int, int]]] = []  # by level: node -> (failing child, passing child)
        none = (0,) * max(map(len, counts.values()), default=1)
        leaves: dict[Weight, int] = {}
        row = []
        for mask in range(1 << len(self.order)):
            weight = counts.get(mask, none)
            if weight not in leaves:
                leaves[weight] = self._add(weight)
            row.append(leaves[weight])
        for _ in self.order:  # the highest bit is the last filter, so levels grow from the bottom
            half, nodes, known = len(row) // 2, {}, {}
            row = [self._node(nodes, known, (row[half + i], row[i])) for i in range(half)]
            self.levels.insert(0, nodes)
        self.root = row[0]

    def _add(self, weight: Weight) -> int:
        self.weights.append(weight)
        return len(self.weights) - 1

    def _node(self, nodes: dict, known: dict, children: tuple[int, int]) -> int:
        if children not in known:
            fails, passes = (self.weights[c] for c in children)
            known[children] = self._add(tuple(a + b for a, b in zip(fails, passes, strict=True)))
            nodes[known[children]] = children
        return known[children]

    def swap(self, at: int) -> None:
        """Exchanges the filters of the levels ``at`` and ``at + 1``; nodes above keep their children, nodes below stay."""
        upper, lower = self.levels[at], self.levels[at + 1]
        nodes: dict[int, tuple[int, int]] = {}
        known: dict[tuple[int, int], int] = {}
        for node, (fails, passes) in upper.items():
            (ff, fp), (pf, pp) = lower[fails], lower[passes]
            upper[node] = (self._node(nodes, known, (ff, pf)), self._node(nodes, known, (fp, pp)))
        self.levels[at + 1] = nodes
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]

    def steps(self) -> Steps:
        """Weights kept and removed at each step: those beside the path that always passes."""
        node, out = self.root, []
        for nodes in self.levels:
            fails, node = nodes[node]
            out.append((self.weights[node], self.weights[fails]))
        return out


def plain_changes(k: int) -> Iterator[int]:
    """Places of the ``k! - 1`` adjacent swaps that lead through all orders: the last item wanders through each order of the rest."""
    if k < 2:
        return
    inner, down = plain_changes(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + down  # the wanderer stands in front of the rest after it went down
        down = not down


def audit(filters: Sequence[str], counts: dict[int, Weight]) -> list[tuple]:
    """``filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of every order."""
    diagram = Diagram(filters, counts)
    orders = {"".join(diagram.order): diagram.steps()}
    for at in plain_changes(len(filters)):
        diagram.swap(at)
        orders["".join(diagram.order)] = diagram.steps()
    total, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for order, steps in orders.items():
        total[order[0]] = steps[0][1][0]  # applied first it removes all that fail it,
        alone[order[-1]] = steps[-1][1][0]  # applied last those that nothing else removes
        for name, (_, removed) in zip(order, steps, strict=True):
            shapley[name] += removed[0]
    return [
        (order, step, kept[0], removed[0], total[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
        for order, steps in sorted(orders.items())
        for step, (name, (kept, removed)) in enumerate(zip(order, steps, strict=True), 1)
    ]


COLUMNS = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(masks: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Rows of ``audit`` per part of a table ``part, mask, n, good, toxic`` with one row per part and mask."""
    schema = f"part string, filter_order string, step int, {COLUMNS}"
    letters = tuple(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column("part"), batch.column("cells"), strict=True):
                rows = audit(letters, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in cells.as_py()})
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array([part.as_py()] * len(rows)), pa.array(cols[0]), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]]
                yield pa.record_batch(arrays, names=[x.split()[0] for x in schema.split(", ")])

    # at most 2^k cells each
    return masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).mapInArrow(run, schema)


def op13_filter_diagrams(spark: SparkSession, folder: str) -> DataFrame:
    return interactions(failure_masks(load(spark, folder, "documents"), load(spark, folder, "labels")))


#: every document's mask, then a count per part, order and step
ORACLE = r"""
WITH flags AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)} AS fails
  FROM texts LEFT JOIN flags USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), reached AS (
  SELECT part, filter_order, step, f, n, good, toxic,
    list_bool_or(list_transform([1, 2, 3, 4, 5], lambda i: i < step AND fails[filter_order[i]])) AS before,
    fails[f] AS here,
    list_bool_or(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: x <> f AND fails[x])) AS others
  FROM (SELECT part, map_from_entries([('A', fails.A), ('B', fails.B), ('C', fails.C), ('D', fails.D), ('E', fails.E)]) AS fails, n, good, toxic FROM cells), steps
), counted AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT before AND NOT here) AS kept, sum(n) FILTER (NOT before AND here) AS removed,
    sum(n) FILTER (before AND here) AS redundant, sum(n) FILTER (here AND NOT others) AS unique_fails,
    sum(good) FILTER (NOT before AND here) AS good_lost, sum(toxic) FILTER (NOT before AND here) AS toxic_lost
  FROM reached GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""
