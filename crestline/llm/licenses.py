"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Every SHINGLE successive words of a template give a hash; of each WINDOW successive hashes the smallest is kept (the
rightmost of equal ones). The kept ones of all templates form an inverted index. A document's words are winnowed the
same way, so a shared passage of WINDOW + SHINGLE - 1 words meets in the index at least once. Of a template that may
reach the coverage without such a passage (as short ones do, with a word replaced or left out in their middle) all
shingles of two words are indexed, or all words where even two may not be left, and nothing is winnowed. Words that a
document inserts at several places can still part a template into passages that are too short. Hits of one template
that follow one another in it and in the document are chained to a region, and a local alignment of the template
against the region, within a band of BAND words around the chain's diagonals, gives the matched words: equal words
score 2, a substitution, insertion or deletion -1. Of overlapping alignments of one template the first of the best
coverage is reported.

Templates are a bounded parameter (MAX_WORDS words in all), so the index is broadcast. Null and empty texts have no
match; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crestline.llm.common import arrow_limits, binary_text, narrow, tidied

SHINGLE, WINDOW, BAND = 3, 2, 8
#: Least share of a template's words that is reported.
COVERAGE = 0.8
MAX_WORDS = 200_000

#: Short public notices that name a license.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-line": "Released under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
}

_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SPACE).split()


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the kept hashes."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < window:
        return np.array([n - 1 - int(hashes[::-1].argmin())])
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


def hashes(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of size successive words; codes are hashes of words."""
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = codes[:n].copy()
    for k in range(1, size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return h ^ (h >> np.uint64(29))


def align(a: list, b: list, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Local alignment of a against b near b's place = a's place + diagonal: matched words, begin and end in b. Of equal ones that which ends nearest the diagonal."""
    best, row = (0, 0, 0, 0, 0), {}
    for i, w in enumerate(a):
        new: dict[int, tuple[int, int, int]] = {}
        lo, hi = max(0, i + diagonal - band), min(len(b), i + diagonal + band + 1)
        for j in range(lo, hi):
            score, matched, begin = row.get(j - 1, (0, 0, j))
            if w == b[j]:
                options = [(score + 2, matched + 1, begin)]
            else:
                options = [(score - 1, matched, begin)]
            for x in (row.get(j), new.get(j - 1)):
                if x is not None:
                    options.append((x[0] - 1, x[1], x[2]))
            top = max(options, key=lambda o: (o[0], o[1], -o[2]))
            if top[0] > 0:
                new[j] = top
                if (rank := (top[0], top[1], -abs(j - i - diagonal))) > best[:3]:
                    best = (*rank, top[2], j + 1)
        row = new
    return best[1], best[3], best[4]


def passage(words: int, coverage: float) -> int:
    """Words of the longest passage that is left, at least, of a template at the coverage, by replaced or left out words."""
    matched = math.ceil(coverage * words)
    return -(-matched // (words - matched + 1))


class Index:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.words = [words_of(templates[x].encode()) for x in self.names]
        if sum(map(len, self.words)) > MAX_WORDS:
            raise ValueError(f"templates of more than {MAX_WORDS} words")
        self.codes: dict[bytes, int] = {}
        #: By size of shingle; those of SHINGLE words are winnowed.
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}
        with np.errstate(over="ignore"):
            for k, words in enumerate(self.words):
                left = passage(len(words), coverage)
                size = SHINGLE if left >= WINDOW + SHINGLE - 1 else max(1, min(2, left))
                h = hashes(self.code(words), size)
                for place in winnow(h).tolist() if size == SHINGLE else range(len(h)):
                    self.at.setdefault(size, {}).setdefault(int(h[place]), []).append((k, place))
        self.known = {size: np.array(sorted(at), np.uint64) for size, at in self.at.items()}

    def code(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((zlib.crc32(w) * 0x1_0001 + len(w) for w in words), np.uint64, len(words))

    def scan(self, text: bytes, coverage: float) -> list[tuple[str, int, int, int, float]]:
        """License, first and last word (exclusive), matched words and coverage of each match."""
        words = words_of(text)
        codes = self.code(words)
        hits: dict[int, list[tuple[int, int]]] = {}
        for size, at in self.at.items():
            with np.errstate(over="ignore"):
                h = hashes(codes, size)
            there = np.isin(h, self.known[size])
            if not there.any():
                continue
            for place in (winnow(h) if size == SHINGLE else np.flatnonzero(there)).tolist():
                for k, start in at.get(int(h[place]), ()):
                    hits.setdefault(k, []).append((place - start, place))
        out = []
        for k in sorted(hits):
            template, found = self.words[k], []
            for low, high in chains(hits[k], len(template)):
                lo = max(0, low - BAND)
                region = words[lo : high + len(template) + BAND]
                if sum(map(set(region).__contains__, template)) < coverage * len(template):  # so many can't match
                    continue
                middle = (low + high) // 2
                matched, a, z = align(template, region, middle - lo, BAND + high - middle)
                if matched >= coverage * len(template):
                    found.append((-matched, lo + a, lo + z))
            begins: list[int] = []
            ends: list[int] = []
            for matched, a, z in sorted(found):
                at = bisect.bisect_left(begins, a)
                if (at == 0 or ends[at - 1] <= a) and (at == len(begins) or begins[at] >= z):
                    begins.insert(at, a)
                    ends.insert(at, z)
                    out.append((self.names[k], a, z, -matched, round(-matched / len(template), 6)))
        return sorted(out)


def chains(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The least and the greatest diagonal of each region: hits (diagonal, place) of one template of size words.

    In the order of their places, a hit goes on with the latest open chain whose last hit lies before it in the
    template too, less than the template's length away, on a diagonal that BAND words allow; else it opens one.
    """
    done, open_ = [], []
    for place, diagonal in sorted((p, d) for d, p in hits):
        still = []
        for c in open_:
            (still if place - c[3] <= size + BAND else done).append(c)
        open_ = still
        start = place - diagonal
        for c in reversed(open_):
            if start > c[2] and abs(diagonal - c[4]) <= BAND:
                c[0], c[1], c[2:] = min(c[0], diagonal), max(c[1], diagonal), [start, place, diagonal]
                break
        else:
            open_.append([diagonal, diagonal, start, place, diagonal])
    return sorted({(c[0], c[1]) for c in done + open_})


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, start_word, end_word, matched_words and coverage: a row for each match."""
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(Index(templates or TEMPLATES, coverage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), binary_text(batch)):
                rows += [(doc, *x) for x in index.scan(text, coverage)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "license", "start_word", "end_word", "matched_words", "coverage"])

    return narrow(docs, {"doc_id": "long", "text": "string"}).mapInArrow(tidied(run), "doc_id long, license string, start_word long, end_word long, matched_words long, coverage double")
