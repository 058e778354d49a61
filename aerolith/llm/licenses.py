"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template's block is 2n words of a text, one beginning each n words (n: the template's words), so that any n
words in a row lie in one block. A block matches if it holds at least `threshold` of the template's distinct words.
Words are ordered by their frequency in the whole corpus; a matching block must hold one of the template's
rarest words (its prefix), which gives the candidates. A candidate needs as many known words as the match (length), and
as many distinct ones from its first shared word on, in that order (place): a block's later words bound what the two can
still share. The templates and their words are a fixed, small set.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, kept_columns, prefix_hash, restored, span_hash, text_slices, word_spans
from .license_texts import LICENSES

# Phrases and notices with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "gpl",
    ),
    ("licensed under the apache license version 2 0", "apache"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at",
        "apache",
    ),
    ("licensed under cc by nc 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
        "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
        "merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met",
        "bsd",
    ),
    (
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including "
        "but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "bsd",
    ),
    (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
        "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
        "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of "
        "or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied",
        "apache",
    ),
    (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
        "of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies",
        "isc",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
        "with this file you can obtain one at",
        "mpl",
    ),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    *((" ".join(re.findall("[a-z0-9]+", text.lower())), label) for text, label in LICENSES),
)
THRESHOLD = 0.8
#: so many words of evidence count half
HALF = 5.0

MATCH = "array<struct<label:string,template:int,start_word:bigint,end_word:bigint,containment:double>>"
PLACE = "array<struct<label:string,word:bigint>>"


def hash_words(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0])
    return np.array(out, np.uint64)


class Vocabulary:
    """The words of all phrases and templates; ids follow the sorted hashes."""

    def __init__(self, phrases: tuple, templates: tuple):
        words = sorted({w for text, _ in (*phrases, *templates) for w in text.split()})
        h = hash_words(words)
        order = np.argsort(h)
        self.hashes, self.words = h[order], [words[i] for i in order]
        at = {w: i for i, w in enumerate(self.words)}
        self.phrases = [([at[w] for w in text.split()], label) for text, label in phrases]
        self.templates = [(sorted({at[w] for w in text.split()}), len(text.split()), label) for text, label in templates]

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary id of each word (-1: none), and the index of each row's first word."""
        low = LOWER[data]
        starts, ends, first = word_spans(low, offs, ALNUM)
        h = span_hash(prefix_hash(low), starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1).astype(np.int32), first


def count_words(df: DataFrame, text_col: str, vocab: Vocabulary) -> np.ndarray:
    """How often each word of the vocabulary stands in the whole corpus."""
    size = len(vocab.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, _, data, offs in text_slices(b.column(0)):
                ids, _ = vocab.ids(data, offs)
                total += np.bincount(ids[ids >= 0], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["id", "n"])

    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


class Index:
    """Prefix words of the templates under a global order of words, rarest first."""

    def __init__(self, vocab: Vocabulary, counts: np.ndarray, threshold: float):
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        self.rank = rank
        self.prefix: dict[int, list[tuple[int, int]]] = {}  # word -> (template, its place in the ordered template)
        self.need, self.ordered = [], []
        for k, (words, _, _) in enumerate(vocab.templates):
            need = math.ceil(threshold * len(words) - 1e-9)
            self.need.append(need)
            self.ordered.append(sorted(words, key=lambda x: rank[x]))
            for i, w in enumerate(self.ordered[k][: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.is_prefix = np.zeros(len(counts), bool)
        self.is_prefix[list(self.prefix)] = True


def prefix_blocks(ids: np.ndarray, vocab: Vocabulary, index: Index) -> dict[tuple[int, int], int]:
    """The blocks of one row that hold a prefix word: (template, block) and the first such word's place in the template."""
    hits = np.flatnonzero((ids >= 0) & index.is_prefix[np.maximum(ids, 0)])
    best: dict[tuple[int, int], int] = {}
    for p in hits.tolist():
        for k, place in index.prefix[int(ids[p])]:
            n = vocab.templates[k][1]
            for block in {p // n, p // n - 1} if p >= n else {0}:
                best[k, block] = min(place, best.get((k, block), place))
    return best


def can_match(held: np.ndarray, k: int, place: int, index: Index) -> bool:
    """Whether a block with these known words (distinct ids) can share enough with template k from the word at `place` on."""
    need = index.need[k]
    if len(held) < need:  # by length
        return False
    behind = int(np.count_nonzero(index.rank[held] >= index.rank[index.ordered[k][place]]))
    return min(behind, len(index.ordered[k]) - place) >= need  # by place, in the block and in the template


def block_matches(ids: np.ndarray, vocab: Vocabulary, index: Index) -> list[tuple[str, int, int, int, float]]:
    """The matching blocks of one row: (label, template, first word, end, containment), neighbours as found."""
    out = []
    for (k, block), place in sorted(prefix_blocks(ids, vocab, index).items()):
        words, n, label = vocab.templates[k]
        lo, hi = block * n, min(len(ids), block * n + 2 * n)
        held = np.unique(ids[lo:hi])
        held = held[held >= 0]
        if not can_match(held, k, place, index):
            continue
        got = len(np.intersect1d(held, words, assume_unique=True))
        if got >= index.need[k]:
            out.append((label, k, lo, hi, got / len(words)))
    return out


def evidence(places: Column, matches: Column, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> Column:
    """How much stands for a license, 0 to 1: the best of all matches' containments, each times d / (d + 5) for a template of d
    distinct words, so that a whole text says more than a notice, and a notice more than a phrase of d words, which counts
    as fully contained."""
    weight = lambda text: len(set(text.split())) / (len(set(text.split())) + HALF)
    said = [F.when(F.array_contains(places.getField("label"), label), max(weight(p) for p, at in phrases if at == label)).otherwise(0.0) for label in sorted({at for _, at in phrases})]
    weights = F.array(*[F.lit(weight(text)) for text, _ in templates])
    best = F.array_max(F.transform(matches, lambda m: m["containment"] * F.get(weights, m["template"])))
    return F.greatest(F.lit(0.0), *said, F.coalesce(best, F.lit(0.0)))


def license_scan(df: DataFrame, keep: list[str], text_col: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns with n_words, places (each place of a phrase) and matches (each matching block).

    A null or empty text has no words, places or matches. Repeated rows each get their own result, an empty table
    gives no rows. A kept column named like a result column keeps its name, and the result's gets an underscore.
    """
    vocab = Vocabulary(phrases, templates)
    index = Index(vocab, count_words(df, text_col, vocab), threshold)
    n_keep = len(keep)
    src = df.select(*kept_columns(keep), F.col(f"`{text_col}`").cast("string").alias("scan_text"))
    schema = T.StructType([*src.schema.fields[:n_keep], *T._parse_datatype_string(f"n_words bigint, places {PLACE}, matches {MATCH}").fields])
    place_t = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    match_t = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("label", "template", "start_word", "end_word", "containment")
        for b in batches:
            counts, places, matches = [], [], []
            for lo, hi, data, offs in text_slices(b.column(n_keep)):
                ids, first = vocab.ids(data, offs)
                counts.append(np.diff(first))
                at: dict[int, list] = {}
                for phrase, label in vocab.phrases:
                    hit = np.flatnonzero(ids == phrase[0])
                    for i, w in enumerate(phrase[1:], 1):
                        hit = hit[hit + i < len(ids)]
                        hit = hit[ids[hit + i] == w]
                    row = np.searchsorted(first, hit, side="right") - 1
                    whole = hit + len(phrase) <= first[row + 1]
                    for h, r in zip(hit[whole].tolist(), row[whole].tolist(), strict=True):
                        at.setdefault(r, []).append({"label": label, "word": h - int(first[r])})
                some = np.flatnonzero((ids >= 0) & index.is_prefix[np.maximum(ids, 0)])
                rows = set(np.unique(np.searchsorted(first, some, side="right") - 1).tolist())
                for r in range(hi - lo):
                    places.append(sorted(at.get(r, []), key=lambda x: (x["word"], x["label"])))
                    found = block_matches(ids[first[r] : first[r + 1]], vocab, index) if r in rows else []
                    matches.append([dict(zip(names, m, strict=True)) for m in found])
            n = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], n, pa.array(places, place_t), pa.array(matches, match_t)], schema.names)

    return restored(src.mapInArrow(scan, schema), keep, ["n_words", "places", "matches"])
