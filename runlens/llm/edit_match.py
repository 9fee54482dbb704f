"""Benchmark decontamination: test items that occur in a text within an edit budget.

Texts and items are compared in lower case with runs of white space as one space. An item of ``n`` characters may differ in
``floor(n * EDITS)`` insertions, deletions or substitutions. It is split into one piece more than its budget, so
that an occurrence within the budget holds at least one piece unchanged (pigeonhole). Pieces of the items are found in
one pass over a text with an Aho-Corasick automaton. Pieces are halved in a tree, where a node of ``j`` pieces may differ by ``j - 1``: an
occurrence within the budget has an unchanged piece with all nodes above it within theirs, so a hit whose next nodes are not is
dropped without a loss. Each other hit names a stretch of the text in which the item would have to lie; stretches that overlap are
merged, and Myers' bit-parallel algorithm settles the least edit distance at which the item ends in the stretch.
An item shorter than ``LEAST_CHARS`` would match by chance with edits: it is looked for unchanged and as whole words.

Items are the stated query set: they are taken in blocks of a bounded number of characters, and each block goes over all
texts, so the automaton and what is sent to a task stay bounded however many items there are. Text is never shuffled.

Edge cases: null and empty texts match nothing; items that are null or empty once normalised are passed over. Items that are equal are looked for once each and all reported. Repeated
documents are judged each. Without items nothing matches; empty tables give no rows. ``keep_clean`` carries extra columns
whatever their names; ``find_items`` carries ``doc_id`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, spare

EDITS = 0.12
LEAST_CHARS = 40
#: characters of normalised items in a block
BLOCK_CHARS = 4 << 20
#: nodes whose masks are kept
KEPT_NODES = 1 << 15


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, edits: float = EDITS) -> int:
    return int(n * edits) if n >= LEAST_CHARS else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of about the same length that cover ``item``, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def nodes_above(item: str, k: int) -> list[list[tuple[int, int, int]]]:
    """For each of the pieces the nodes above it but for the item itself, from below: their bounds and budgets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    out, open_nodes = [[] for _ in range(k + 1)], [(0, k + 1)]
    while open_nodes:
        lo, hi = open_nodes.pop()
        if hi - lo > 1:
            if hi - lo <= k:
                for i in range(lo, hi):
                    out[i].insert(0, (cuts[lo], cuts[hi], hi - lo - 1))
            open_nodes += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
    return out


def parts_beside(item: str, at: int, n: int, above: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """What lies beside a piece in the node next above, in one part more than that node's budget, with the bounds within which
    one of them occurs unchanged if the node is within its budget. Without a node, none."""
    if not above:
        return []
    a, b, most = above[0]
    lo, hi = (a, at) if a < at else (at + n, b)
    return [(part, lo + x - most, lo + x + len(part) + most) for x, part in pieces(item[lo:hi], most)]


def letters_of(item: str) -> dict[str, int]:
    """For each character the bits of its places."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def least_distance(masks: dict[str, int], m: int, text: str, stop: int = 0) -> int:
    """Least edit distance of the item of ``m`` characters to any stretch of ``text`` (Myers 1999, over one wide
    integer); ends early at a distance of ``stop`` or less."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = masks.get
    for ch in text:
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if best <= stop:
                    return best
        ph, mh = ph << 1, mh << 1
        pv = (mh | (full & ~(xv | ph))) & full
        mv = ph & xv & full
    return best


def whole_words(text: str, lo: int, hi: int) -> bool:
    """Whether no word goes on over the bounds of ``text[lo:hi]``."""
    return not (lo and text[lo - 1].isalnum() and text[lo].isalnum() or hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum())


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS) -> None:
        self.letters = lru_cache(KEPT_NODES)(letters_of)
        self.items = []  # (item id, normalised text, budget, masks)
        places: dict[str, list[tuple[int, int, list[tuple[int, int, int]], list[tuple[str, int, int]]]]] = {}
        for item_id, text in items:
            k = budget(len(text), edits)
            for (at, piece), above in zip(pieces(text, k), nodes_above(text, k), strict=True):
                places.setdefault(piece, []).append((len(self.items), at, above, parts_beside(text, at, len(piece), above)))
            self.items.append((item_id, text, k, letters_of(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int]]:
        """``(item_id, distance)`` of the items that occur in ``text`` within their budgets."""
        text = normalise(text)
        if not text or not self.items:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (n, found) in self.automaton.iter(text):
            for which, at, above, beside in found:
                _, item, k, _ = self.items[which]
                start = end + 1 - n - at  # where the item would begin without edits in front of the piece
                if len(item) < LEAST_CHARS:
                    if whole_words(text, start, end + 1):
                        spans[which] = []
                    continue
                if beside:
                    for part, lo, hi in beside:
                        if text.find(part, max(0, start + lo), max(0, start + hi)) >= 0:
                            break
                    else:
                        continue
                if not all(least_distance(self.letters(item[a:b]), b - a, text[max(0, start + a - most):start + b + most], most) <= most for a, b, most in above):
                    continue
                lo, hi = max(0, start - k), min(len(text), start + len(item) + k)
                seen = spans.setdefault(which, [])
                if seen and lo <= seen[-1][1] and lo >= seen[-1][0]:
                    seen[-1][1] = max(seen[-1][1], hi)
                    seen[-1][2] += 1
                else:
                    seen.append([lo, hi, 1])
        out = []
        for which, found in spans.items():
            item_id, item, k, masks = self.items[which]
            if not found or item in text:
                out.append((item_id, 0))
                continue
            best = min(least_distance(masks, len(item), text[lo:hi]) for lo, hi, _ in found)
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items that are not empty, in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        text = normalise(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


_HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())]))


def with_hits(docs: DataFrame, text: str, block: list[tuple[int, str]], name: str, edits: float = EDITS) -> DataFrame:
    """``docs`` with the items of ``block`` that occur in each text, as an array of (item_id, edits)."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(shared.value, edits)
        for batch in batches:
            found = [[{"item_id": i, "edits": d} for i, d in match(t.as_py())] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, _HITS)]))


def find_items(docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits`` (least distance) of every occurrence within the budget."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in item_blocks(items):
        part = with_hits(rows, "text", block, "hits", edits).select("doc_id", F.inline("hits"))
        found = part if found is None else found.union(part)
    return rows.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("edits")).where(F.lit(False)) if found is None else found


def keep_clean(docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with their own columns."""
    (name,) = spare(docs, "hits")
    for block in item_blocks(items):
        docs = with_hits(docs, "text", block, name, edits).where(F.size(name) == 0).drop(name)
    return docs


def contamination(docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """Per row: doc_id, n_items, item_ids (ascending), least_edits (null without an item)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = []
    for i, block in enumerate(item_blocks(items)):
        rows = with_hits(rows, "text", block, f"hits_{i}", edits)
        hits.append(F.col(f"hits_{i}"))
    every = F.concat(*hits) if hits else F.array().cast(_HITS)
    return rows.select("doc_id", every.alias("hits")).select(
        "doc_id", F.size("hits").alias("n_items"), F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("item_ids"),
        F.array_min(F.transform("hits", lambda h: h["edits"])).alias("least_edits"))


def op8_edit_match(spark: SparkSession, folder: str) -> DataFrame:
    return find_items(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
