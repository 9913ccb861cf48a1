"""License scans with a positional index of rare words.

Templates (license notices) are indexed by word and position. The document frequency of every template word is
counted over the corpus. Every occurrence in a file of the word that is rarest in a template's key phrase is looked up,
and where the phrase stands in full around it the template is aligned: each word beside the phrase, at position p,
that the template has at position q votes with its rarity for an alignment at p - q. A template is accepted where
enough of its rarity-weighted words stand in place and one of its key phrases occurs in full beside it. Templates do
not compete: a file has the label of each license in it.

Base rule: the places where a short phrase stands word by word; its labels always stay.

The index has as many entries as the templates have words; only document frequencies of template words (as many)
come to the driver. Files are scanned each on its own inside a task.

Defined cases: a null text counts as empty; a file without words has no labels and score 0; ties between alignments
go to the earliest place; repeated rows are scanned alike; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt

#: Phrases of the base rule and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License notices, (label, text, key phrases of which one must occur).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights "
     "to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0", "apache license 2 0")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license you may obtain a copy of the license at", ("apache license version 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ("gnu general public license version 3", "general public license version 3")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 2 of the license or at your option any later version",
     ("general public license", "version 2 of the license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice this list of conditions "
     "and the following disclaimer", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0", "cc by nc")),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0", "cc by sa")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
COVER = 0.7

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of lower-cased bytes."""
    word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_of(words: list[str]) -> np.ndarray:
    """The hashes that ``bytetext.span_hashes`` gives to these words."""
    joined = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    sizes = np.array([len(w) for w in joined])
    ends = np.cumsum(sizes + 1) - 1
    return bt.span_hashes(data, ends - sizes, ends)


class Index:
    """Templates by word: positions in each template, with the words' weights by rarity."""

    def __init__(self, templates=TEMPLATES):
        self.templates = [(label, _WORDS.findall(text), [_WORDS.findall(k) for k in keys]) for label, text, keys in templates]
        self.words = sorted({w for _, text, keys in self.templates for part in (text, *keys) for w in part})
        hashes = hash_of(self.words)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [self.words[i] for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        self.texts = [[number[w] for w in text] for _, text, _ in self.templates]
        self.keys = [[[number[w] for w in k] for k in keys] for _, _, keys in self.templates]
        self.postings = [defaultdict(list) for _ in self.texts]
        for positions, text in zip(self.postings, self.texts, strict=True):
            for q, w in enumerate(text):
                positions[w].append(q)
        self.idf = np.ones(len(self.words))
        base = [p.split() for p in BASE]
        self.base = [(list(BASE.values())[i], hash_of(p)) for i, p in enumerate(base)]
        # a file can only be accepted if it has the rarest word of some key phrase; set with the frequencies
        self.anchors = np.zeros(len(self.words), bool)
        self.anchored = defaultdict(list)  # by such a word: (template, key phrase, the word's position in the phrase)

    def weigh(self, n_files: int, frequency: dict[int, int]) -> Index:
        seen = np.array([frequency.get(i, 0) for i in range(len(self.words))], np.float64)
        self.idf = np.log((n_files + 1) / (seen + 0.5)) + 0.01
        self.idf = np.maximum(self.idf, 0.01)
        self.weights = self.idf.tolist()
        self.totals = [self.idf[text].sum() for text in self.texts]
        for t, keys in enumerate(self.keys):
            for key in keys:
                rarest = max(key, key=lambda w: (self.idf[w], -w))
                self.anchors[rarest] = True
                self.anchored[rarest].append((t, key, key.index(rarest)))
        return self

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def match(self, places: np.ndarray, numbers: np.ndarray) -> tuple[set[str], float]:
        """(labels, best share of weight in place) of one file from its template words and their positions."""
        at = dict(zip(places.tolist(), numbers.tolist(), strict=True))
        beside = defaultdict(set)  # by template: places where a key phrase of it begins
        for p, w in at.items():
            for t, key, k in self.anchored.get(w, ()):
                if all(at.get(p - k + i) == x for i, x in enumerate(key)):
                    beside[t].add(p - k)
        labels, best = set(), 0.0
        for t, begins in beside.items():
            size = len(self.texts[t])
            shares, done = defaultdict(float), 0
            for begin in sorted(begins):  # words in reach of some key phrase, each once
                reach = range(max(begin - size - 1, done), begin + size + 2)
                for p in reach:
                    w = at.get(p)
                    for q in self.postings[t].get(w, ()):
                        shares[p - q] += self.weights[w]
                done = reach.stop
            for shift, weight in shares.items():
                share = min(1.0, weight / self.totals[t])  # sums in another order may differ in the last bit
                if share >= COVER and any(p in begins for p in range(shift - 2, shift + size + 2)):
                    best = max(best, share)
                    labels.add(self.templates[t][0])
        return labels, float(best)


def _frequencies(batches):
    """How many files have each template word, of a partition, and the number of files under -1."""
    index = Index()
    counts, files = np.zeros(len(index.words), np.int64), 0
    for batch in batches:
        files += len(batch)
        for first, end, data, offsets in bt.slices(batch.column(0)):
            data = bt.lower(data)
            starts, ends, rows = spans(data, offsets)
            number = index.lookup(bt.span_hashes(data, starts, ends))
            hit = number >= 0
            pairs = np.unique(rows[hit] * len(index.words) + number[hit])
            counts += np.bincount(pairs % len(index.words), minlength=len(index.words))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(counts))), pa.array(np.append(files, counts))], ["word", "n"])


def _scan(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for first, end, data, offsets in bt.slices(batch.column(1)):
                data = bt.lower(data)
                starts, ends, rows = spans(data, offsets)
                hashes = bt.span_hashes(data, starts, ends)
                n = end - first
                begin = np.searchsorted(rows, np.arange(n))
                base_row, base_place, base_label = [], [], []
                for label, phrase in index.base:
                    hit = np.ones(max(len(hashes) - len(phrase) + 1, 0), bool)
                    for k, h in enumerate(phrase):
                        hit &= hashes[k : k + len(hit)] == h
                    at = np.flatnonzero(hit)
                    at = at[rows[at] == rows[at + len(phrase) - 1]]
                    base_row.append(rows[at])
                    base_place.append(at - begin[rows[at]])
                    base_label += [label] * len(at)
                base_row, base_place = np.concatenate(base_row), np.concatenate(base_place)
                number = index.lookup(hashes)
                hit = np.flatnonzero(number >= 0)
                anchored = np.unique(rows[hit][index.anchors[number[hit]]])
                found: dict[int, tuple[set[str], float]] = {}
                low, high = np.searchsorted(rows[hit], anchored), np.searchsorted(rows[hit], anchored, "right")
                for row, a, b in zip(anchored.tolist(), low, high, strict=True):
                    found[row] = index.match(hit[a:b] - begin[row], number[hit[a:b]])
                base: dict[int, list] = defaultdict(list)
                for row, place, label in zip(base_row.tolist(), base_place.tolist(), base_label, strict=True):
                    base[row].append((place, label))
                places = [base.get(i, []) for i in range(n)]
                own = [{label for _, label in x} for x in places]
                final = [sorted(a | found.get(i, (set(), 0.0))[0]) for i, a in enumerate(own)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), pa.array(np.bincount(rows, minlength=n), pa.int64()),
                    pa.array([len(x) for x in places], pa.int64()),
                    pa.array([min(p for p, _ in x) if x else None for x in places], pa.int64()),
                    pa.array([max(p for p, _ in x) if x else None for x in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in own], pa.string()), pa.array([",".join(x) for x in final], pa.string()),
                    pa.array([1.0 if own[i] else found.get(i, (set(), 0.0))[1] for i in range(n)]),
                ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    counted = docs.select(text).mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {row.word: row.n for row in counted}  # a row for each template word
    index = docs.sparkSession.sparkContext.broadcast(Index().weigh(frequency.pop(-1, 0), frequency))
    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(
        _scan(index),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )


def op3_licenses(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_licenses": op3_licenses}
ORACLES: dict[str, str] = {}
