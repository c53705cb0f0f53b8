"""License scans: notices found by their rarest words, lined up by position and verified by key phrases.

How often each word of the templates occurs (in how many documents) is counted over the corpus. The words of
each template that are rarest there (highest IDF) are its entries in a positional index: word -> (template, position).
Each file's words are looked up there; a hit says at which place of the file the template would begin. Hits of one
template that agree on that place within SLACK words, for half of its rare words at least, make a candidate. It
counts if all of the template's key phrases stand in that region, and at least LEAST of its words.

Base phrases are found wherever their words stand in a row, by the same word ids and then by their bytes.

A null text is empty: no words, no labels, score 0. Repeated rows get equal results each. A very long text is a slice
of its own; nothing of a text or of its hits is left out. Labels have no order of finding, so ties don't arise: they are
distinct and sorted. Further columns do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, slices, spans_hash
from .shared import texts

RARE = 8
SLACK = 8
LEAST = 0.75
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

# Base phrases, then notices of public licenses and the phrases that each must have.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    ("mit", "Released under the MIT License.", ("released under the mit license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("licensed under the apache license version 2 0",)),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("unless required by applicable law", "governing permissions and limitations under the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("terms of the gnu general public license", "version 3 of the license", "any later version")),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("terms of the gnu general public license", "version 2 of the license", "any later version")),
    ("lgpl-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("gnu lesser general public license", "version 2 1 of the license")),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistribution and use in source and binary forms", "must retain the above copyright notice", "must reproduce the above copyright notice")),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software", "specific prior written permission")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("for any purpose with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("licensed under cc by nc 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0 international",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial 4 0 international",)),
]
Template = tuple[str, str, tuple[str, ...]]


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class Lexicon:
    """Words of phrases and templates by id, and what is looked for as sequences of ids."""

    words: list[str]
    hashes: np.ndarray
    ids: np.ndarray
    phrases: list[list[int]]
    base: list[tuple[int, str]]
    templates: list[list[int]]
    labels: list[str]
    required: list[list[int]]


def lexicon(templates: list[Template], base: dict[str, str]) -> Lexicon:
    phrase_texts = [*base, *(p for _, _, keys in templates for p in keys)]
    words = sorted({w for text in [*phrase_texts, *(t for _, t, _ in templates)] for w in words_of(text)})
    number = {w: i for i, w in enumerate(words)}
    blob, sizes = "".join(words).encode(), [len(w.encode()) for w in words]
    ends = np.cumsum(sizes)
    hashes = spans_hash(np.frombuffer(blob, np.uint8), ends - sizes, ends)
    order = np.argsort(hashes)
    unique = sorted(set(phrase_texts))
    at = {p: i for i, p in enumerate(unique)}
    ids = lambda text: [number[w] for w in words_of(text)]
    return Lexicon(words, hashes[order], order, [ids(p) for p in unique], [(at[p], label) for p, label in base.items()], [ids(t) for _, t, _ in templates], [label for label, _, _ in templates], [[at[p] for p in keys] for _, _, keys in templates])


def words_in(data: np.ndarray, offsets: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lexicon's id of each word (-1: none), the text of each word, and the number of words before each text (one more than texts).

    Hashes find a word's id, its bytes decide: words of up to 8 bytes are compared as numbers, longer ones, of which few
    are in the lexicon, one by one."""
    data = LOWER[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD_BYTE[data]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    hashes = spans_hash(data, starts, ends)
    place = np.minimum(np.searchsorted(lex.hashes, hashes), len(lex.hashes) - 1)
    ids = np.where(lex.hashes[place] == hashes, lex.ids[place], -1)
    hits = np.flatnonzero(ids >= 0)
    real = np.array([w.encode() for w in lex.words], bytes)
    width = real.dtype.itemsize
    sizes = (ends - starts)[hits]
    short = np.minimum(sizes, width)
    row = np.repeat(np.arange(len(hits)), short)
    column = np.arange(len(row)) - np.repeat(np.cumsum(short) - short, short)
    seen = np.zeros((len(hits), width), np.uint8)
    seen[row, column] = data[np.repeat(starts[hits], short) + column]
    same = (seen == real[ids[hits]].view(np.uint8).reshape(len(hits), width)).all(axis=1) & (sizes <= width)
    ids[hits[~same]] = -1
    return ids, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def places_of(ids: np.ndarray, of: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of a phrase stand in a row in one text."""
    at = np.flatnonzero(ids == phrase[0])
    at = at[at + len(phrase) <= len(ids)]
    for k, word in enumerate(phrase[1:], 1):
        at = at[ids[at + k] == word]
    return at[of[at] == of[at + len(phrase) - 1]]


@dataclass
class Index:
    """Postings (template, position) of each rare word, in one array with the first entry of each word; and how many rare words a candidate needs."""

    first: np.ndarray
    template: np.ndarray
    position: np.ndarray
    need: np.ndarray


def index_of(lex: Lexicon, idf: np.ndarray, rare: int = RARE) -> Index:
    """idf: for each word of the lexicon. Equal ones are taken in order of the word."""
    entries, need = [], []
    for t, ids in enumerate(lex.templates):
        top = sorted(set(ids), key=lambda i: (-idf[i], lex.words[i]))[:rare]
        need.append((len(top) + 1) // 2)
        entries += [(w, t, p) for p, w in enumerate(ids) if w in set(top)]
    table = np.array(sorted(entries), np.int64).reshape(-1, 3)
    return Index(np.searchsorted(table[:, 0], np.arange(len(lex.words) + 1)), table[:, 1], table[:, 2], np.array(need, np.int64))


def aligned(ids: np.ndarray, of: np.ndarray, first: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(text, template, lowest and highest beginning) of the places where enough rare words agree."""
    words = np.flatnonzero(ids >= 0)
    low, size = index.first[ids[words]], index.first[ids[words] + 1] - index.first[ids[words]]
    words, entry = np.repeat(words, size), np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text, template, word = of[words], index.template[entry], ids[words]
    begin = words - first[text] - index.position[entry]
    order = np.lexsort((begin, template, text))
    text, template, begin, word = (x[order] for x in (text, template, begin, word))
    edges = np.flatnonzero((np.diff(text) != 0) | (np.diff(template) != 0) | (np.diff(begin) > SLACK)) + 1
    for a, b in zip(np.append(0, edges).tolist(), np.append(edges, len(text)).tolist(), strict=True):
        if b > a and b - a >= index.need[template[a]] and len(np.unique(word[a:b])) >= index.need[template[a]]:
            yield int(text[a]), int(template[a]), int(begin[a]), int(begin[b - 1])


def share_of(template: list[int], region: np.ndarray) -> float:
    """Which part of a template's words, each as often as it stands there, a region has."""
    there = Counter(region[region >= 0].tolist())
    return sum(min(n, there[w]) for w, n in Counter(template).items()) / len(template)


def _matches(ids: np.ndarray, of: np.ndarray, first: np.ndarray, lex: Lexicon, index: Index) -> Iterator[tuple[int, str, int, int, float]]:
    """(text, label, first and last word of the region, share) of verified candidates."""
    found = {p: places_of(ids, of, lex.phrases[p]) for p in {p for keys in lex.required for p in keys}}
    for text, t, low, high in aligned(ids, of, first, index):
        start = first[text] + max(0, low - SLACK)
        end = min(first[text + 1], first[text] + high + len(lex.templates[t]) + SLACK)
        for p in lex.required[t]:
            i = np.searchsorted(found[p], start)
            if i == len(found[p]) or found[p][i] + len(lex.phrases[p]) > end:
                break
        else:
            share = share_of(lex.templates[t], ids[start:end])
            if share >= LEAST:
                yield text, lex.labels[t], int(start - first[text]), int(end - 1 - first[text]), share


def document_frequency(docs: DataFrame, lex: Lexicon) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many each word of the lexicon occurs: as many numbers as it has words."""
    n = len(lex.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for part, data, offsets in slices(batch):
                ids, of, _ = words_in(data, offsets, lex)
                some = ids >= 0
                total[:n] += np.bincount(np.unique(of[some] * n + ids[some]) % n, minlength=n)
                total[n] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(total)], ["word", "n"])

    out = np.zeros(n + 1, np.int64)
    for row in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[row["word"]] = row["n"]
    return int(out[n]), out[:n]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label: string, first_word: long, last_word: long, share: double>>"
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))


def licensed(docs: DataFrame, templates: list[Template] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row per document: base places and labels, all labels, score, and the notices that were verified with their place and share.

    score is the largest share of a verified notice, 0.5 at least where a base phrase stands, else 0."""
    lex = lexicon(templates, base)
    n_docs, df = document_frequency(docs, lex)
    index = index_of(lex, np.log((n_docs + 1) / (df + 1)))
    sent = docs.sparkSession.sparkContext.broadcast((lex, index))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, index = sent.value
        for batch in batches:
            for part, data, offsets in slices(batch):
                ids, of, first = words_in(data, offsets, lex)
                n = part.num_rows
                n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                own: list[set[str]] = [set() for _ in range(n)]
                for p, label in lex.base:
                    at = places_of(ids, of, lex.phrases[p])
                    text, place = of[at], at - first[of[at]]
                    n_base += np.bincount(text, minlength=n)
                    np.minimum.at(low, text, place)
                    np.maximum.at(high, text, place)
                    for i in np.unique(text).tolist():
                        own[i].add(label)
                more: list[list[dict]] = [[] for _ in range(n)]
                for text, label, start, end, share in _matches(ids, of, first, lex, index):
                    more[text].append({"label": label, "first_word": start, "last_word": end, "share": share})
                joined = lambda labels: ",".join(sorted(labels))
                score = [max([0.5 if a else 0.0, *(m["share"] for m in b)]) for a, b in zip(own, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=n_base == 0), pa.array(high, mask=n_base == 0), pa.array(map(joined, own), pa.string()), pa.array((joined(a | {m["label"] for m in b}) for a, b in zip(own, more, strict=True)), pa.string()), pa.array(score, pa.float64()), pa.array(more, _MATCH)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    return texts(docs).mapInArrow(run, SCHEMA)
