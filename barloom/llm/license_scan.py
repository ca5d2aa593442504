"""License scan: a positional index of rare licence words, intersected by relative position, verified by key phrases.

Every template indexes its rarest words, rarity being the inverse document frequency over all documents scanned. A file
looks up the rarest licence words it holds; each occurrence p of a word that a template has at offset o votes for the
start p - o. A start with enough votes is verified: the template's mandatory phrase must stand word by word at its
place. The score is the share of the template's idf weight that stands at its place, the best over all templates.

The base part counts places where the base phrases stand consecutively. Null and empty texts have no words, no label and
score 0. Rows that repeat an id are scanned one by one. Texts are scanned whole; memory is one text and its words. With
no documents the frequencies are empty and so is the result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import per_text, to_batch, words_of

# fixed values: base phrases and their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# fixed values: label, notice wording, mandatory phrase inside it
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the License", "except in compliance with the license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Released under the BSD 3-Clause License", "bsd 3 clause license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0 international license"),
    ("cc0", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal", "cc0 1 0 universal"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", "general public license version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "general public license version 3"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2 0"),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without written permission", "no part of this work may be reproduced"),
)

SCHEMA = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("score", pa.float64())])))]
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase_at: int
    phrase: tuple[bytes, ...]


def templates() -> list[Template]:
    out = []
    for label, text, phrase in TEMPLATES:
        w, p = tuple(words_of(text)), tuple(words_of(phrase))
        at = next(i for i in range(len(w)) if w[i : i + len(p)] == p)
        out.append(Template(label, w, at, p))
    return out


def vocabulary() -> frozenset[bytes]:
    return frozenset(w for t in templates() for w in t.words)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): in how many texts each licence word stands; the empty word counts the texts. Bounded by the templates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = vocabulary(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocab.intersection(words_of(text)))
                seen[b""] += 1
        yield to_batch([(w.decode(), n) for w, n in seen.items()], pa.schema([("word", pa.string()), ("n", pa.int64())]))

    return docs.select(docs[text_col]).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """The positional index: for each rare word its (template, offset) postings."""

    def __init__(self, frequencies: dict[bytes, int], rarest: int):
        total = frequencies.get(b"", 0)
        self.all = templates()
        self.idf = {w: math.log((total + 1) / (frequencies.get(w, 0) + 1)) + 1e-3 for w in vocabulary()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.all):
            # a template without its phrase never counts, so its rare words come from the phrase first
            phrase = set(t.phrase)
            ranked = sorted(set(t.words), key=lambda w: (w not in phrase, -self.idf[w], w))[:rarest]
            for o, w in enumerate(t.words):
                if w in ranked:
                    self.postings[w].append((k, o))
        self.base = [(tuple(words_of(p)), label) for p, label in BASE]
        self.first = defaultdict(list)
        for p, label in self.base:
            self.first[p[0]].append((p, label))
        self.wanted = frozenset(self.postings) | frozenset(self.first)

    def scan(self, text: str | None, most: int | None, votes_needed: int) -> tuple:
        w = words_of(text)
        wanted = self.wanted
        hits = [(i, x) for i, x in enumerate(w) if x in wanted]
        places, labels = [], set()
        for i, x in hits:
            for p, label in self.first.get(x, ()):
                if tuple(w[i : i + len(p)]) == p:
                    places.append(i)
                    labels.add(label)
        found = self._candidates(w, hits, most, votes_needed)
        best: dict[tuple[str, int], float] = {}
        for k, start in found:
            t = self.all[k]
            if tuple(w[start + t.phrase_at : start + t.phrase_at + len(t.phrase)]) != t.phrase or start + t.phrase_at < 0:
                continue
            weight = sum(self.idf[x] for x in t.words)
            here = sum(self.idf[x] for o, x in enumerate(t.words) if 0 <= start + o < len(w) and w[start + o] == x)
            key = (t.label, start + t.phrase_at)
            best[key] = max(best.get(key, 0.0), min(1.0, here / weight))
        every = labels | {label for label, _ in best}
        spots = [{"label": label, "start": s, "score": v} for (label, s), v in sorted(best.items(), key=lambda x: (x[0][1], x[0][0]))]
        return (
            len(w),
            len(places),
            min(places) if places else None,
            max(places) if places else None,
            ",".join(sorted(labels)),
            ",".join(sorted(every)),
            max((v for v in best.values()), default=0.0),
            spots,
        )

    def _candidates(self, w: list[bytes], hits: list[tuple[int, bytes]], most: int | None, votes_needed: int) -> list[tuple[int, int]]:
        """(template, start) with enough votes from the file's `most` rarest licence words (None: all), all their occurrences."""
        rare = [(i, x) for i, x in hits if x in self.postings]
        chosen = set(sorted({x for _, x in rare}, key=lambda x: (-self.idf[x], x))[:most])
        votes: Counter = Counter((k, i - o) for i, x in rare if x in chosen for k, o in self.postings[x])
        return [key for key, n in votes.items() if n >= min(votes_needed, sum(1 for x in set(self.all[key[0]].words) if x in self.postings))]


def licenses(docs: DataFrame, text_col: str = "text", rarest: int = 8, most: int | None = None, votes: int = 2) -> DataFrame:
    """(row, scan): scan holds the contract's columns and the verified places.

    rarest: words that a template indexes; most: distinct indexed words that a file looks up, None for all (the templates
    bound how many there are); votes: words that must agree on a start.
    """
    frequencies = {r["word"].encode(): r["n"] for r in document_frequencies(docs, text_col).toArrow().to_pylist()}

    def make():
        index = Index(frequencies, rarest)
        return lambda texts: [index.scan(t, most, votes) for t in texts]

    return per_text(docs, text_col, SCHEMA, make)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return licenses(docs.select("doc_id", "text")).select("row.doc_id", *[F.col(f"scan.{n}").alias(n) for n in names])

