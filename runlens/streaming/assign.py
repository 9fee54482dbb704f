"""R5 on a stream: every event with the template of its mask, as the batch mining would give it.

Keyed by (source, number of tokens), the root of a prefix tree. State is kept in maps, so a batch reads only what it needs: a mask
already seen costs one lookup, whatever the number of its events; a new one reads the children of its two nodes and the
templates of its leaf. Masks are taken in order of first appearance, so ids are those of ``templates.mine_templates``; the pattern
is that of the moment (a batch over the whole shows the last widening).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config
from ..operators import templates

KEYS = ("source_id", "n_tokens")


def branch_key(tokens: list[str], depth: int) -> str:
    """What a mask's token at a depth stands for in the tree."""
    if depth >= len(tokens):
        return ""
    token = tokens[depth]
    return templates.WILDCARD if token.startswith("<") and token.endswith(">") else token


class Assigner(StatefulProcessor):
    def __init__(self, names: list[str], cfg: Config) -> None:
        self.names, self.cfg = names, cfg
        self.cluster = templates._cluster(cfg.similarity)

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = lambda name: T.StructType([T.StructField(name, T.StringType())])
        placed = T.StructType([T.StructField("template_id", T.StringType()), T.StructField("leaf", T.StringType())])
        self.masks = handle.getMapState("masks", text("mask"), placed)
        self.nodes = handle.getMapState("nodes", text("node"), text("children"))
        self.leaves = handle.getMapState("leaves", text("leaf"), text("templates"))

    def _child(self, node: str, key: str) -> str:
        """Branch of a node a key falls into: its own, while there are few, or the shared one."""
        known = self.nodes.getValue((node,)) if self.nodes.containsKey((node,)) else None
        children = json.loads(known[0]) if known else []
        if key in children:
            return key
        if len(children) >= self.cfg.max_children:
            return templates.WILDCARD
        self.nodes.updateValue((node,), (json.dumps([*children, key]),))
        return key

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("event_no", kind="stable")
        of_mask, leaves, changed = {}, {}, set()

        def leaf(name: str) -> dict:
            if name not in leaves:
                held = self.leaves.getValue((name,)) if self.leaves.containsKey((name,)) else None
                leaves[name] = json.loads(held[0]) if held else {}
            return leaves[name]

        founders = set()
        for mask, no in pdf.drop_duplicates("mask")[["mask", "event_no"]].itertuples(index=False):
            if self.masks.containsKey((mask,)):
                of_mask[mask] = tuple(self.masks.getValue((mask,)))
                leaf(of_mask[mask][1])
                continue
            tokens = mask.split(" ")
            first = self._child("", branch_key(tokens, 0))
            second = self._child(json.dumps([first]), branch_key(tokens, 1))
            name = json.dumps([first, second])
            leaves[name], joined = self.cluster(leaf(name), {"mask": [mask], "first_no": [no]})
            changed.add(name)
            of_mask[mask] = (joined["template_id"][0], name)
            if joined["is_founder"][0]:
                founders.add(no)
            self.masks.updateValue((mask,), of_mask[mask])
        for name in changed:
            self.leaves.updateValue((name,), (json.dumps(leaves[name]),))
        patterns = {name: {i: " ".join(t) for i, t in held.get("templates", [])} for name, held in leaves.items()}
        out = pdf[self.names].assign(
            template_id=[of_mask[m][0] for m in pdf["mask"]],
            template_pattern=[patterns[of_mask[m][1]][of_mask[m][0]] for m in pdf["mask"]],
            is_novel=[no in founders for no in pdf["event_no"]])
        for i, name in enumerate(KEYS):
            out.insert(i, name, key[i])
        yield out

    def close(self) -> None:
        pass


def stream_templates(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Events (``source_id, event_no, mask, ...``) with ``template_id``, ``template_pattern`` and ``is_novel``."""
    names = [c for c in events.columns if c not in (*KEYS, "template_id", "template_pattern", "is_novel")]
    schema = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("n_tokens", T.IntegerType()), *[events.schema[c] for c in names]])
    schema = schema.add("template_id", "string").add("template_pattern", "string").add("is_novel", "boolean")
    keyed = events.select("source_id", F.size(F.split("mask", " ")).alias("n_tokens"), *names)
    return keyed.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=Assigner(names, cfg), outputStructType=schema, outputMode="Append", timeMode="None").drop("n_tokens")
