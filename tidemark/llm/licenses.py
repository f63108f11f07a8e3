"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of ASCII letters and digits and of any characters beyond ASCII, with A-Z lower-cased.  A template has blocks of
its own: windows of ``L`` words, ``L`` being its number of words and ``SLACK`` more, at every ``SLACK + 1``-th word, so that
any run of its length lies in one block whole.  A block meets a template if it holds at least ``threshold`` of its different words,
and all words that tell its license from others, which stand in capitals in the template.  So words scattered over a text
are not a license, nor is the sentence of one license another.  Where overlapping blocks meet templates of two labels and
one's telling words are some of the other's, as those of cc-by are of cc-by-nc, it gives way.

The join is exact.  Template words are ordered by how many documents hold them, rarest first, over the whole table.
A block that meets a template of n words must hold one of its first ``n - ceil(threshold * n) + 1`` (prefix filter),
must hold enough words of the vocabulary (length filter), and the words left after the matched place in either order
must suffice (positional filter).  What passes is counted.

Two maps over the rows: the frequencies, of which a task returns one row a vocabulary word, and the scan.  Templates
are fixed, so what is broadcast doesn't grow with the data.

Defined results: null and empty texts have no words, no labels and score 0; a text shorter than a block is one block;
repeated rows are kept; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: Phrase: label, of the contract (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, text) of the templates that blocks are held against (fixed values); in capitals what a block can't do without.
TEMPLATES = [
    ("apache", "licensed under the APACHE license version 2 0"),
    ("apache", "released under the APACHE license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www APACHE org licenses license 2 0"),
    ("bsd", "REDISTRIBUTION and use in SOURCE and BINARY forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the BSD license"),
    ("cc-by", "licensed under CC BY 4 0"),
    ("cc-by", "this work is licensed under a CREATIVE COMMONS ATTRIBUTION 4 0 international license"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by-nc", "this work is licensed under a CREATIVE COMMONS ATTRIBUTION NONCOMMERCIAL 4 0 international license"),
    ("cc-by-sa", "licensed under CC BY SA 4 0"),
    ("cc-by-sa", "this work is licensed under a CREATIVE COMMONS ATTRIBUTION SHAREALIKE 4 0 international license"),
    ("gpl", "this work is licensed under the gnu GENERAL PUBLIC license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu GENERAL PUBLIC license as published by the free software foundation"),
    ("isc", "PERMISSION to use copy modify and or DISTRIBUTE this SOFTWARE for any PURPOSE with or without fee is hereby GRANTED"),
    ("mit", "released under the MIT license"),
    ("mit", "PERMISSION is hereby GRANTED free of CHARGE to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the MOZILLA PUBLIC license"),
    ("public-domain", "this is free and unencumbered software released into the PUBLIC DOMAIN"),
]
THRESHOLD = 0.8
#: Words by which a block is longer than its template.
SLACK = 3

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def vocabulary(templates=None) -> list[str]:
    return sorted({w for _, t in (TEMPLATES if templates is None else templates) for w in t.lower().split()})


def frequencies(docs: DataFrame, text_col: str = "text", templates=None) -> dict[str, int]:
    """In how many documents each word of the templates stands; at most one row a word reaches the driver."""
    known = frozenset(w.encode() for w in vocabulary(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, texts in text_slices(batches, text_col):
            for t in texts:
                total.update(known.intersection(words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


class Scanner:
    def __init__(self, frequency: dict[str, int], threshold: float = THRESHOLD, templates=None):
        templates = TEMPLATES if templates is None else templates
        order = sorted(vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
        self.place = {w.encode(): k for k, w in enumerate(order)}
        self.sets = [sorted({self.place[w.lower().encode()] for w in t.split()}) for _, t in templates]
        self.must = [frozenset(self.place[w.lower().encode()] for w in t.split() if w.isupper()) for _, t in templates]
        self.labels = [label for label, _ in templates]
        self.need = [ceil(threshold * len(s) - 1e-9) for s in self.sets]
        #: By block length: the least words of any template of that length, and its prefix words with their templates.
        self.by_length: dict[int, tuple[int, dict[int, list[tuple[int, int]]]]] = {}
        for k, (_, t) in enumerate(templates):
            least, prefix = self.by_length.get(len(t.split()) + SLACK, (1 << 30, {}))
            for i, w in enumerate(self.sets[k][: len(self.sets[k]) - self.need[k] + 1]):
                prefix.setdefault(w, []).append((k, i))
            self.by_length[len(t.split()) + SLACK] = (min(least, self.need[k]), prefix)
        self.prefix_words = frozenset(order[w].encode() for _, prefix in self.by_length.values() for w in prefix)
        self.phrases = [(f" {p} ".encode(), label) for p, label in BASE.items()]

    def base(self, found: list[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        line = b" %b " % b" ".join(found)
        out = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                out.append((line.count(b" ", 0, at), label))
                at = line.find(phrase, at + 1)
        return sorted(out)

    def block(self, own: list[int], least: int, prefix: dict[int, list[tuple[int, int]]]) -> list[tuple[int, float]]:
        """(template, containment) of all that a block with the sorted vocabulary words ``own`` meets."""
        if len(own) < least:
            return []
        ruled: set[int] = set()
        out = []
        for j, w in enumerate(own):
            for k, i in prefix.get(w, ()):
                if k in ruled:
                    continue
                ruled.add(k)  # the first shared word decides: none of a smaller place is shared
                if 1 + min(len(self.sets[k]) - i - 1, len(own) - j - 1) < self.need[k]:
                    continue
                held = set(own)
                shared = len(held.intersection(self.sets[k]))
                if shared >= self.need[k] and self.must[k] <= held:
                    out.append((k, shared / len(self.sets[k])))
        return out

    def blocks(self, found: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(begin, end, label, containment) of every block that meets a template."""
        if self.prefix_words.isdisjoint(found):
            return []
        place, met, step = self.place, [], SLACK + 1
        known = [(i, place[w]) for i, w in enumerate(found) if w in place]
        at = [i for i, _ in known]
        for length, (least, prefix) in self.by_length.items():
            last = -(-max(0, len(found) - length) // step)
            starts = {s * step for i, w in known if w in prefix for s in range(max(0, -(-(i - length + 1) // step)), min(i // step, last) + 1)}
            for s in sorted(starts):
                own = {w for _, w in known[bisect_left(at, s) : bisect_left(at, s + length)]}
                met += [(s, min(len(found), s + length), k, c) for k, c in self.block(sorted(own), least, prefix)]
        return sorted({(s, e, self.labels[k], c) for s, e, k, c in met if not any(self._better(k, s, e, *m) for m in met)})

    def _better(self, k: int, s: int, e: int, s2: int, e2: int, k2: int, c2: float) -> bool:
        """Whether the match of ``k2`` at an overlapping place takes the place of ``k``: another label's, with all distinguishing
        words of ``k`` and more."""
        return self.labels[k] != self.labels[k2] and s < e2 and s2 < e and self.must[k] < self.must[k2]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=None) -> DataFrame:
    """``(id_col, n_words, base, blocks)``: ``base`` are places of base phrases, ``blocks`` the blocks with the template
    labels that they meet."""
    frequency = frequencies(docs, text_col, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(frequency, threshold, templates)
        base = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        blocks = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
        for part, texts in text_slices(batches, text_col):
            n, b, m = [], [], []
            for t in texts:
                found = words(t)
                n.append(len(found))
                b.append([{"word": w, "label": x} for w, x in scanner.base(found)])
                m.append([{"begin": s, "end": e, "label": x, "score": c} for s, e, x, c in scanner.blocks(found)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(b, base), pa.array(m, blocks)], names=[id_col, "n_words", "base", "blocks"])

    schema = T.StructType(
        [docs.schema[id_col], *T._parse_datatype_string("n_words long, base array<struct<word:long,label:string>>, blocks array<struct<begin:long,end:long,label:string,score:double>>").fields]
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def report(scanned: DataFrame) -> DataFrame:
    base, blocks = F.col("base"), F.col("blocks")
    found = F.array_sort(F.array_distinct(F.transform(base, lambda b: b["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform(base, lambda b: b["label"]), F.transform(blocks, lambda b: b["label"]))))
    starts = F.transform(base, lambda b: b["word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(found, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(blocks, lambda b: b["score"])), F.lit(0.0))).alias("score"),
    )
