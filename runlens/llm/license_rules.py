"""Licence scan by sentence rules.

A text is cut into sentences: at a full stop, question or exclamation mark in front of white space, at blank lines, and at line
ends, except that a sentence wrapped over lines is tried as a whole too (up to ``WRAPPED`` lines; the longest known one is taken). Comment
marks at the beginning of lines and stars, bars and slashes do not count. Sentences are normalised (lower case, words of letters and digits with inner dots and dashes, marks around them dropped), and a normalised sentence that is
known gets the identifiers listed for it. Rules are sequences of identifiers that must occur in this order; between two
of them at most ``GAP`` other sentences may stand. Rules are ordered: where rules share a sentence, the one that comes first wins and the
sentence is used up.

The tables of sentences and rules are parameters and small; they travel with the task. Texts are not shuffled.

Edge cases: null and empty texts have no licence. Very long texts are read sentence by sentence. Repeated sentences
give one licence once per place in ``spans`` and once in ``licenses``. Ties are settled by the order of rules. Repeated rows
are each scanned; empty tables give no rows. Columns other than ``doc_id`` and ``text`` are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

#: normalised sentence -> identifiers of known licence sentences
SENTENCES: dict[str, tuple[str, ...]] = {
    "licensed under the apache license version 2.0": ("apache-notice", "apache-2.0-version"),
    "licensed under the apache license version 2.0 the license": ("apache-notice", "apache-2.0-version"),
    "you may not use this file except in compliance with the license": ("apache-compliance",),
    "you may obtain a copy of the license at": ("apache-copy",),
    "released under the mit license": ("mit-notice",),
    "this project is licensed under the mit license": ("mit-notice",),
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("mit-grant",),
    "the software is provided as is without warranty of any kind": ("as-is",),
    "this work is licensed under the gnu general public license version 3": ("gpl-notice", "gpl-3-version"),
    "this program is free software": ("free-software",),
    "you can redistribute it and/or modify it under the terms of the gnu general public license": ("gpl-terms",),
    "licensed under cc by-nc 4.0": ("cc-by-nc-notice", "cc-4.0-version"),
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": ("cc-by-nc-notice", "cc-4.0-version"),
    "licensed under cc by 4.0": ("cc-by-notice", "cc-4.0-version"),
    "this work is licensed under a creative commons attribution 4.0 international license": ("cc-by-notice", "cc-4.0-version"),
    "all rights reserved": ("all-rights-reserved",),
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": ("mit-grant",),
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": ("mit-condition",),
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": ("as-is",),
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": ("isc-grant",),
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": ("bsd-grant",),
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": ("bsd-source",),
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": ("bsd-binary",),
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": ("bsd-endorse",),
    "this source code form is subject to the terms of the mozilla public license v. 2.0": ("mpl-2.0",),
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": ("gpl-3-later",),
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": ("gpl-2-later",),
    "this is free and unencumbered software released into the public domain": ("unlicense",),
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": ("apache-notice", "apache-2.0-version", "apache-compliance"),
    "spdx-license-identifier mit": ("spdx-mit",),
    "spdx-license-identifier apache-2.0": ("spdx-apache-2.0",),
    "spdx-license-identifier isc": ("spdx-isc",),
    "spdx-license-identifier bsd-2-clause": ("spdx-bsd-2",),
    "spdx-license-identifier bsd-3-clause": ("spdx-bsd-3",),
    "spdx-license-identifier mpl-2.0": ("spdx-mpl-2.0",),
    "spdx-license-identifier gpl-2.0-only": ("spdx-gpl-2",),
    "spdx-license-identifier gpl-2.0-or-later": ("spdx-gpl-2-later",),
    "spdx-license-identifier gpl-3.0-only": ("spdx-gpl-3",),
    "spdx-license-identifier gpl-3.0-or-later": ("spdx-gpl-3-later",),
}
#: (licence, identifiers in order), the stronger rules first
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-notice", "apache-2.0-version", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-notice", "apache-2.0-version")),
    ("GPL-3.0", ("gpl-notice", "gpl-3-version")),
    ("GPL", ("free-software", "gpl-terms")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice", "cc-4.0-version")),
    ("CC-BY-4.0", ("cc-by-notice", "cc-4.0-version")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl-2.0",)),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("spdx-apache-2.0",)),
    ("ISC", ("spdx-isc",)),
    ("BSD-2-Clause", ("spdx-bsd-2",)),
    ("BSD-3-Clause", ("spdx-bsd-3",)),
    ("MPL-2.0", ("spdx-mpl-2.0",)),
    ("GPL-2.0", ("spdx-gpl-2",)),
    ("GPL-2.0-or-later", ("spdx-gpl-2-later",)),
    ("GPL-3.0", ("spdx-gpl-3",)),
    ("GPL-3.0-or-later", ("spdx-gpl-3-later",)),
    ("MIT", ("mit-notice",)),
    ("proprietary", ("all-rights-reserved",)),
)
#: other sentences that may stand between two of a rule
GAP = 3
#: lines a wrapped sentence may have
WRAPPED = 12

_END = re.compile(r"[.!?]+(?=\s|\Z)|\n")
_WORD = re.compile(r"[^\W_]+(?:[-./'][^\W_]+)*")


def normalise(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the sentences of ``text`` that hold anything."""
    at = 0
    for end in _END.finditer(text):
        if at < end.start():
            yield at, end.start()
        at = end.end()
    if at < len(text):
        yield at, len(text)


class RuleScan:
    """Licences of a text, and the spans they were recognised by."""

    def __init__(self, known: Mapping[str, Sequence[str]] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, gap: int = GAP) -> None:
        self.known, self.rules, self.gap = {normalise(k): tuple(v) for k, v in known.items()}, rules, gap
        self.longest = max(map(len, self.known), default=0)
        #: a sentence can only be known if its first word begins a known one
        self.openers = {k.split(" ", 1)[0] for k in self.known}

    def identifiers(self, text: str) -> list[tuple[int, int, int, str]]:
        """``(sentence number, start, end, identifier)`` in order."""
        out, pieces, number, place = [], list(sentences(text)), 0, 0
        while number < len(pieces):
            a, b = pieces[number]
            first = _WORD.search(text, a, b)
            place += first is not None  # comment marks alone are no sentence
            if not first or first[0].lower() not in self.openers:
                number += 1
                continue
            fits, words, end = None, "", number
            while end < len(pieces) and end - number < WRAPPED:
                x, y = pieces[end]
                if end > number and not self._wraps(text, pieces[end - 1][1], x):
                    break
                words = f"{words} {normalise(text[x:y])}".strip()
                if len(words) > self.longest:
                    break
                if words in self.known:
                    fits = (end, y, words)
                end += 1
            if fits:
                number, b, words = fits
                out += [(place, a, b, identifier) for identifier in self.known[words]]
            number += 1
        return out

    @staticmethod
    def _wraps(text: str, end: int, start: int) -> bool:
        """Whether only one line end stands between two pieces, or the stop of "v." for version."""
        return text[end:start] == "\n" or text[end:start] == "." and text[max(0, end - 2):end].lower() == " v"

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        """``(licence, start, end)`` by place."""
        found = self.identifiers(text or "")
        used, out = [False] * len(found), []
        for licence, wanted in self.rules:
            for start in range(len(found)):
                picked, at = [], start
                for identifier in wanted:
                    while at < len(found) and (used[at] or found[at][3] != identifier) and picked and found[at][0] - found[picked[-1]][0] <= self.gap + 1:
                        at += 1
                    if at >= len(found) or used[at] or found[at][3] != identifier or picked and found[at][0] - found[picked[-1]][0] > self.gap + 1:
                        break
                    picked.append(at)
                    at += 1
                if picked and len(picked) == len(wanted):
                    for i in picked:
                        used[i] = True
                    out.append((licence, found[picked[0]][1], found[picked[-1]][2]))
        return sorted(out, key=lambda x: x[1:])


def scan(docs: DataFrame, known: Mapping[str, Sequence[str]] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES, gap: int = GAP) -> DataFrame:
    """Per row: doc_id, licenses (distinct, ascending), spans (license, start, end in code points)."""
    spans = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    known, rules = dict(known), tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = RuleScan(known, rules, gap)
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([
                batch.column("doc_id"), pa.array([sorted({x[0] for x in f}) for f in found], pa.list_(pa.string())),
                pa.array([[{"license": n, "start": a, "end": b} for n, a, b in f] for f in found], spans),
            ], names=["doc_id", "licenses", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, licenses array<string>, spans array<struct<license: string, start: long, end: long>>")


def op4_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(load(spark, folder, "documents"))
    return found.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), F.size("spans").alias("n_spans"), "spans")
