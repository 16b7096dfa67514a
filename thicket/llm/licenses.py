"""License scans as an exact set-similarity join of text blocks with license templates.

A document's words fall into overlapping blocks; a template is a short set of words. A block is
found when it contains at least a given share of a template's words. Tokens are ordered by their
frequency in the whole corpus, rarest first, and three filters leave few blocks to verify, none
of them wrongly dropped:

  prefix    a block with `need` of a template's n tokens has one of its n - need + 1 rarest;
  length    a block with fewer template tokens than `need` is out;
  position  at the first shared token, what is left on either side must still make up `need`.

Phrases that must stand word by word are templates with a share of one, whose blocks are then read
for the places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .attach import attach
from .words import PLAIN, Words, batch_of, split, split_column, text_bytes

#: Phrases and the labels of their places.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Passages from the public texts of licenses, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
#: A block has so many words and begins half as many after the one before: any passage of half a block lies in one.
BLOCK_WORDS = 64

FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,word:long,share:double>>"


@dataclass
class Template:
    label: str
    words: np.ndarray
    #: Ranks of its distinct words, rarest first, and how many of them a block needs.
    ranks: np.ndarray
    need: int
    base: bool


@dataclass
class Index:
    """vocabulary: sorted word hashes of all templates; rank: by frequency; owners: for each rank, (template, position) of the prefixes it is in."""

    vocabulary: np.ndarray
    rank: np.ndarray
    templates: list[Template]
    prefixes: list[tuple[int, int, int]]

    @staticmethod
    def hashes(text: str) -> np.ndarray:
        data, offsets = text_bytes(pa.array([text], pa.large_string()))
        return split(data, offsets, PLAIN).hashes

    @classmethod
    def of(cls, phrases, templates, share: float, counts: dict[int, int] | None = None) -> Index:
        """counts: how often the corpus has each word of the vocabulary, by its place there."""
        texts = [(label, cls.hashes(text), 1.0, True) for text, label in phrases] + [(label, cls.hashes(text), share, False) for text, label in templates]
        if any(not 0 < len(words) <= BLOCK_WORDS // 2 for _, words, _, _ in texts):
            raise ValueError(f"a template has 1 to {BLOCK_WORDS // 2} words")
        vocabulary = np.unique(np.concatenate([words for _, words, _, _ in texts])) if texts else np.zeros(0, np.uint64)
        counts = counts or {}
        order = sorted(range(len(vocabulary)), key=lambda k: (counts.get(k, 0), k))
        rank = np.empty(len(vocabulary), np.int64)
        rank[order] = np.arange(len(vocabulary))
        made, prefixes = [], []
        for t, (label, words, least, base) in enumerate(texts):
            ranks = np.unique(rank[np.searchsorted(vocabulary, words)])
            need = max(1, math.ceil(least * len(ranks) - 1e-9))
            made.append(Template(label, words, ranks, need, base))
            prefixes += [(int(r), t, i) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
        return cls(vocabulary, rank, made, sorted(prefixes))

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that any template has, and their ranks."""
        if not len(self.vocabulary) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == words.hashes)
        return hit, self.rank[at[hit]]


def joined(words: Words, index: Index) -> Iterator[tuple[Template, np.ndarray, np.ndarray, np.ndarray]]:
    """For each template with blocks: itself, and each block's text, first word in it, and share of the template."""
    hit, rank = index.tokens(words)
    if not len(hit):
        return
    half = BLOCK_WORDS // 2
    text = np.searchsorted(words.first, hit, "right") - 1
    within = (hit - words.first[text]) // half
    # A word is in the block that begins in its own half and in the one before.
    spans = (words.counts + half - 1) // half
    base = np.concatenate([[0], np.cumsum(spans)])
    block = base[text] + within
    both = np.concatenate([block, block[within > 0] - 1])
    sets = np.unique(both * np.int64(len(index.vocabulary)) + np.concatenate([rank, rank[within > 0]]))
    block, rank = np.divmod(sets, len(index.vocabulary))
    edge = np.concatenate([[True], block[1:] != block[:-1]])
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(block)))
    nth = np.cumsum(edge) - 1
    position, total = np.arange(len(block)) - start[nth], size[nth]

    by_rank = np.argsort(rank, kind="stable")
    sorted_rank = rank[by_rank]
    candidates: dict[int, list[np.ndarray]] = {}
    for token, t, i in index.prefixes:
        template = index.templates[t]
        have = by_rank[np.searchsorted(sorted_rank, token) : np.searchsorted(sorted_rank, token, "right")]
        left = np.minimum(len(template.ranks) - i, total[have] - position[have])
        candidates.setdefault(t, []).append(nth[have[(total[have] >= template.need) & (left >= template.need)]])
    for t, parts in candidates.items():
        template, found = index.templates[t], np.unique(np.concatenate(parts))
        if not len(found):
            continue
        wanted = np.zeros(len(index.vocabulary), bool)
        wanted[template.ranks] = True
        among = np.zeros(len(start), bool)
        among[found] = True
        shared = np.bincount(nth[wanted[rank] & among[nth]], minlength=len(start))[found]
        good = shared >= template.need
        if good.any():
            ids = block[start[found[good]]]
            of = np.searchsorted(base, ids, "right") - 1
            yield template, of, (ids - base[of]) * half, shared[good] / len(template.ranks)


def places(words: Words, template: Template, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the words where the template's words stand one after another, of those that begin in the blocks' first halves."""
    half = BLOCK_WORDS // 2
    begin = words.first[text] + first
    stop = np.minimum(begin + half, words.first[text + 1])
    at = np.concatenate([np.arange(a, b) for a, b in zip(begin, stop, strict=True)])
    end = np.repeat(words.first[text + 1], stop - begin)
    keep = at + len(template.words) <= end
    at = at[keep]
    for k, word in enumerate(template.words):
        at = at[words.hashes[at + k] == word]
    return at


def scanned(column: pa.Array, index: Index) -> dict[str, list]:
    n = len(column)
    out: dict[str, list] = {"n_words": [0] * n, "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "blocks": [[]] * n}
    for start, end, words in split_column(column, PLAIN):
        out["n_words"][start:end] = words.counts.tolist()
        base: dict[int, list[tuple[int, str]]] = {}
        blocks: dict[int, list[dict]] = {}
        for template, text, first, share in joined(words, index):
            if template.base:
                at = places(words, template, text, first)
                of = np.searchsorted(words.first, at, "right") - 1
                for d, p in zip(of.tolist(), (at - words.first[of]).tolist(), strict=True):
                    base.setdefault(d, []).append((p, template.label))
                keep = np.isin(text, of)
                text, first, share = text[keep], first[keep], share[keep]
                for d in np.unique(text).tolist():
                    out["score"][start + d] = 1.0
            else:
                for d, p, s in zip(text.tolist(), first.tolist(), share.tolist(), strict=True):
                    blocks.setdefault(d, []).append({"label": template.label, "word": p, "share": s})
        for d in {*base, *blocks}:
            k, found = start + d, sorted(base.get(d, []))
            own = {label for _, label in found}
            if found:
                out["n_base"][k], out["first_word"][k], out["last_word"][k] = len(found), found[0][0], found[-1][0]
            out["base_labels"][k] = ",".join(sorted(own))
            out["labels"][k] = ",".join(sorted(own | {b["label"] for b in blocks.get(d, [])}))
            out["score"][k] = max([out["score"][k], *(b["share"] for b in blocks.get(d, []))])
            out["blocks"][k] = sorted(blocks.get(d, []), key=lambda b: (b["word"], b["label"], b["share"]))
    return out


def frequencies(docs: DataFrame, index: Index) -> dict[int, int]:
    """How often the whole corpus has each word of the templates; one row a word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary), np.int64)
        back = np.argsort(index.rank)
        for batch in batches:
            for _, _, words in split_column(batch.column("text"), PLAIN):
                total += np.bincount(back[index.tokens(words)[1]], minlength=len(total))
        yield batch_of(["word", "n"], [np.arange(len(total)), total])

    counts = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


def license_scan(spark: SparkSession, docs: DataFrame, carry: list[str], share: float = 0.8, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(row, found): the carried columns of each document, and the licenses that its text names or quotes.

    found: n_words; n_base, first_word, last_word and base_labels of the places of phrases (null
    words and an empty string where there are none); blocks, each one that holds at least `share`
    of a template's distinct words; labels of both; score, the largest share (1 for a phrase, 0
    for nothing). Labels are sorted and joined by commas. A null or empty text has no words.
    """
    index = Index.of(phrases, templates, share, frequencies(docs, Index.of(phrases, templates, share)))
    return attach(docs, carry, lambda: lambda column: scanned(column, index), FOUND)
