"""License notices in documents: an exact set-similarity join of text blocks with notice templates.

Words are runs of digits, letters a-z and characters beyond ASCII after lower-casing A-Z. Blocks are windows of
``BLOCK`` words that overlap by half, so any run of half a block lies within one; a block matches a template
when it contains at least the share ``THRESHOLD`` of the template's distinct words. The join is exact:

* words of templates are ordered by how often they occur in all documents, rarest first;
* prefix: a matching block holds one of the ``n - need + 1`` rarest words of a template of ``n`` words;
* length: it holds at least ``need`` distinct template words;
* position: from its first match on, enough words must be left on both sides to reach ``need``;
* the pairs left are counted in full.

Base places are where all words of a phrase stand one after another. Templates and phrases are arguments; both are
small texts given by the user, and only their words are counted over the corpus.

Cases: a null text is an empty one; a document without words has one empty block, which matches nothing; phrases
or templates without words are an error; rows are handled one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import record_batch, slices, text_buffers
from fieldledger.llm.words import LETTERS, hash_of, word_hashes

BLOCK = 64
THRESHOLD = 0.85

# The phrases of the contract, and wording of common public license notices.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def split(text: str) -> list[str]:
    data = text.encode()
    lowered = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in data)
    marks = bytes(b if LETTERS[b] else 0x20 for b in lowered)
    return [w for w in marks.decode().split(" ") if w]


@dataclass(frozen=True)
class Index:
    """Templates over a vocabulary ordered by frequency. ``hashes`` are sorted and ``rank`` gives each one's place in
    that order; ``inside`` and ``prefix`` say which ranks a template holds, and holds in its prefix."""

    labels: tuple[str, ...]
    hashes: np.ndarray
    rank: np.ndarray
    inside: np.ndarray
    prefix: np.ndarray
    need: np.ndarray


def vocabulary(templates: Sequence[tuple[str, str]]) -> np.ndarray:
    """Hashes of all words of the templates, sorted."""
    return np.unique(np.array([hash_of(w) for _, text in templates for w in split(text)], np.uint64))


def build_index(templates: Sequence[tuple[str, str]], counts: Mapping[int, int], threshold: float) -> Index:
    hashes = vocabulary(templates)
    order = np.lexsort((hashes, [counts.get(i, 0) for i in range(len(hashes))]))
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.arange(len(hashes))
    inside = np.zeros((len(hashes), len(templates)), bool)
    prefix = np.zeros_like(inside)
    need = np.zeros(len(templates), np.int64)
    for t, (_, text) in enumerate(templates):
        own = np.unique(np.array([hash_of(w) for w in split(text)], np.uint64))
        if not len(own):
            raise ValueError("a template has no words")
        ranks = np.sort(rank[np.searchsorted(hashes, own)])
        need[t] = math.ceil(threshold * len(ranks) - 1e-9)
        inside[ranks, t] = True
        prefix[ranks[: len(ranks) - need[t] + 1], t] = True
    return Index(tuple(label for label, _ in templates), hashes, rank, inside, prefix, need)


def _find(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each hash among the sorted known ones, -1 for others."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def _tally(batches: Iterable[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])
    counts = np.zeros(len(known), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            at = _find(word_hashes(*text_buffers(part.column("text")), LETTERS)[0], known)
            counts += np.bincount(at[at >= 0], minlength=len(known))
    yield record_batch(schema, np.arange(len(known), dtype=np.int32), counts)


def frequencies(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> dict[int, int]:
    """How often each word of the vocabulary occurs in all documents, by its place there."""
    counted = docs.select("text").mapInArrow(partial(_tally, known=vocabulary(templates)), "word int, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def block_matches(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, index: Index):
    """Text, template and containment of every matching block (a text and template may come more than once)."""
    rank = _find(hashes, index.hashes)
    words = np.flatnonzero(rank >= 0)
    rank, text = index.rank[rank[words]], owner[words]
    within = words - (np.cumsum(counts) - counts)[text]
    half = BLOCK // 2
    blocks = np.maximum(1, -(-(counts - half) // half))
    first = np.cumsum(blocks) - blocks
    # A word of half number h lies in blocks h - 1 and h, as far as the text has them.
    part = within // half
    keys = []
    for block in (part - 1, part):
        real = (block >= 0) & (block < blocks[text])
        keys.append((first[text] + block)[real] * len(index.hashes) + rank[real])
    keys = np.unique(np.concatenate(keys))
    block, rank = keys // len(index.hashes), keys % len(index.hashes)
    none = np.zeros(0, np.int64)
    if not len(keys):
        return none, none, np.zeros(0)
    begin = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    size = np.diff(np.append(begin, len(block)))
    group = np.repeat(np.arange(len(begin)), size)
    # Prefix: pairs of block and template; the first match of each pair has the lowest rank.
    hit, template = np.nonzero(index.prefix[rank])
    pair, at = np.unique(group[hit] * len(index.labels) + template, return_index=True)
    at = hit[at]
    which, template = pair // len(index.labels), pair % len(index.labels)
    need = index.need[template]
    left = np.cumsum(index.inside[::-1], axis=0)[::-1][rank[at], template]
    fits = (size[which] >= need) & (np.minimum(left, begin[which] + size[which] - at) >= need)
    which, template, need = which[fits], template[fits], need[fits]
    # Counted in full: template words of each block that is left.
    chosen, place = np.unique(which, return_inverse=True)
    rows = np.isin(group, chosen)
    if not rows.any():
        return none, none, np.zeros(0)
    starts = np.searchsorted(group[rows], chosen)
    overlap = np.add.reduceat(index.inside[rank[rows]].astype(np.int64), starts, axis=0)[place, template]
    good = overlap >= need
    text = np.searchsorted(np.cumsum(blocks), block[begin[which[good]]], "right")
    return text, template[good], overlap[good] / index.inside.sum(axis=0)[template[good]]


def base_places(hashes: np.ndarray, owner: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Words at which a phrase starts, all its words in one text."""
    n = len(hashes) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    here = np.flatnonzero(hashes[:n] == phrase[0])
    for i in range(1, len(phrase)):
        here = here[hashes[here + i] == phrase[i]]
    return here[owner[here] == owner[here + len(phrase) - 1]]


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64())]
    + [("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def _scan(batches: Iterable[pa.RecordBatch], index: Index, phrases: list[tuple[np.ndarray, str]]):
    for batch in batches:
        for part in slices(batch, "text"):
            n = len(part)
            hashes, owner = word_hashes(*text_buffers(part.column("text")), LETTERS)
            counts = np.bincount(owner, minlength=n)
            start = np.cumsum(counts) - counts
            places = np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in phrases:
                here = base_places(hashes, owner, phrase)
                text = owner[here]
                places += np.bincount(text, minlength=n)
                np.minimum.at(first, text, here - start[text])
                np.maximum.at(last, text, here - start[text])
                for t in np.unique(text):
                    base[t].add(label)
            labels = [set(b) for b in base]
            score = (places > 0).astype(float)
            for t, template, share in zip(*block_matches(hashes, owner, counts, index), strict=True):
                labels[t].add(index.labels[template])
                score[t] = max(score[t], share)
            none = places == 0
            yield record_batch(
                _OUT,
                part.column("doc_id"),
                counts,
                places,
                pa.array(first, pa.int64(), mask=none),
                pa.array(last, pa.int64(), mask=none),
                [",".join(sorted(b)) for b in base],
                [",".join(sorted(x)) for x in labels],
                score,
            )


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: n_words, base places (n_base, first_word, last_word, base_labels), labels (those of
    matching templates too) and score: 1 with a base place, else the largest containment of a match, else 0."""
    index = build_index(templates, frequencies(docs, templates), threshold)
    found = [(np.array([hash_of(w) for w in split(p)], np.uint64), label) for p, label in phrases.items()]
    if not all(len(p) for p, _ in found):
        raise ValueError("a phrase has no words")
    return docs.select("doc_id", "text").mapInArrow(
        partial(_scan, index=index, phrases=found),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double",
    )
