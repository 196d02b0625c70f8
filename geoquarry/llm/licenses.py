"""License scans by a positional index of rare words.

Templates of licence notices are stored as postings: word -> (template, position).
Words weigh by their IDF over all documents.  Of each template only its rarest
words are looked up, as many as outweigh what an accepted match may lack, so no
match can do without all of them.  Postings of a file's words are intersected by
relative position: each is a vote for the place where the template would begin.
Places with enough votes are compared with the whole template, words being found
a few positions off as well, and are accepted if the template's mandatory key
phrases stand there word by word.  Base phrases are templates that must match whole.

At scale: two scans, no shuffle but that of the document counts, a row for each
licence word and task.  Index and weights are as large as the templates.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

#: A-Z to a-z, and what separates words (ASCII outside 0-9 and a-z) to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Share of a template's weight that must match, and positions that a word may be off.
SHARE, SLACK = 0.75, 2


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, A-Z in lower case."""
    return (text or b"").translate(FOLD).split()


class Template(NamedTuple):
    label: str
    text: str
    #: Phrases that must stand in a match; none: the whole text.
    keys: tuple[str, ...] = ()
    base: bool = False


#: The phrases whose places are the base of a scan.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

#: Notices in the words of the licences themselves.
NOTICES = (
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    Template("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the license", "apache org licenses")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("bsd", "released under the BSD License", ("bsd license",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("free software", "gnu general public license")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted", "without restriction")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


class Match(NamedTuple):
    label: str
    base: bool
    word_from: int
    word_to: int
    share: float


class Index:
    """Postings of the templates' rarest words, with the weights of all of their words."""

    def __init__(self, templates: tuple[Template, ...], documents: int, counts: dict[bytes, int], share: float = SHARE, slack: int = SLACK):
        self.templates, self.share, self.slack = templates, share, slack
        self.words = [words_of(t.text.encode()) for t in templates]
        self.keys = [[words_of(k.encode()) for k in t.keys] for t in templates]
        weigh = {w: 1 + math.log((documents + 1) / (counts.get(w, 0) + 1)) for ws in self.words for w in ws}
        self.weights = [[weigh[w] for w in ws] for ws in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rest: list[float] = []
        for no, (t, ws, weights) in enumerate(zip(templates, self.words, self.weights, strict=True)):
            lack = 0 if t.base else (1 - share) * sum(weights)
            rarest, held = sorted(range(len(ws)), key=lambda o: (-weights[o], o)), 0.0
            for o in rarest:
                if held > lack:
                    break
                held += weights[o]
                self.postings[ws[o]].append((no, o))
            self.rest.append(sum(weights) - held)

    def find(self, words: list[bytes]) -> list[Match]:
        """All matches in a text's words: base places exactly, and every place where a notice's share and key phrases are found."""
        rare = self.postings.keys() & set(words)
        if not rare:
            return []
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for i, w in enumerate(words):
            if w in rare:
                for no, o in self.postings[w]:
                    votes[no, i - o] += self.weights[no][o]
        found, last = [], (-1, 0)
        for no, at in sorted(votes):
            t, size = self.templates[no], len(self.words[no])
            if t.base:
                if at >= 0 and words[at : at + size] == self.words[no]:
                    found.append(Match(t.label, True, at, at + size, 1.0))
                continue
            near = sum(votes.get((no, at + d), 0.0) for d in range(-self.slack, self.slack + 1))
            if near + self.rest[no] >= self.share * sum(self.weights[no]) - 1e-9 and (share := self._share(no, at, words)) >= self.share - 1e-9 and self._keys(no, at, words):
                match = Match(t.label, False, max(at, 0), min(at + size, len(words)), min(share, 1.0))
                if last[0] == no and at - last[1] <= self.slack:  # the same notice, a few positions off: the better place
                    found[-1] = max(found[-1], match, key=lambda m: m.share)
                else:
                    found.append(match)
                last = no, at
        return found

    def _share(self, no: int, at: int, words: list[bytes]) -> float:
        """The share of the template's weight whose words stand at ``at`` plus their position, or a few off."""
        weights, s = self.weights[no], self.slack
        there = sum(w for o, (word, w) in enumerate(zip(self.words[no], weights, strict=True)) if word in words[max(at + o - s, 0) : max(at + o + s + 1, 0)])
        return there / sum(weights)

    def _keys(self, no: int, at: int, words: list[bytes]) -> bool:
        span = words[max(at - self.slack, 0) : max(at + len(self.words[no]) + self.slack, 0)]
        return all(any(span[i : i + len(k)] == k for i in range(len(span) - len(k) + 1)) for k in self.keys[no])


def document_counts(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[bytes, int]]:
    """How many documents there are, and how many hold each word of the templates."""
    vocabulary = {w for t in templates for w in words_of(t.text.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts[b""] += 1
                counts.update(vocabulary & set(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the templates' words
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, matches [label, base, word_from, word_to, share] of each row.

    Words are counted from 0; matches are whole for base phrases, else a place from
    which at least ``SHARE`` of the notice's weight is found with all its key
    phrases.  A null text is empty and has no words and no matches; rows, repeated
    ones and those with null ids too, each have one row; an empty table has none.
    Columns beyond ``keep`` and text are not read, whatever their names.
    """
    index = Index(templates, *document_counts(docs, templates))
    kinds = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(kinds[c] for c in keep), *T.StructType.fromDDL("n_words long, matches array<struct<label: string, base: boolean, word_from: long, word_to: long, share: double>>")])
    one = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word_from", pa.int64()), ("word_to", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found = [], []
            for text in b.column(len(keep)).to_pylist():
                words = words_of(text)
                sizes.append(len(words))
                found.append([m._asdict() for m in index.find(words)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(one))], names=schema.names)

    return docs.select(*keep, F.col("text").cast("binary")).mapInArrow(run, schema)


def _labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def scan_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: ``scan`` with the standard templates, a row for each row.

    Base columns are of the base phrases alone; ``labels`` has those of notices too;
    ``score`` is the largest share of a match (1 for a base phrase), 0 without one.
    """
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["word_from"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
