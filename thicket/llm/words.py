"""Vectorised word hashing over Arrow string columns.

A block is a run of whole texts laid end to end as UTF-8 bytes. Words get 64-bit hashes by one
pass of array arithmetic; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are worked on at a time (a longer text makes a block of its own).
BLOCK_BYTES = 1 << 20

#: Separators of the two kinds of words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NON_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * BASE)


class Alphabet:
    """Which bytes part words, and a 64-bit number for each byte; A-Z count as a-z."""

    def __init__(self, separators: bytes):
        folded = np.arange(256)
        folded[0x41:0x5B] += 0x20
        self.word = np.ones(256, bool)
        self.word[list(separators)] = False
        # A-Z are lower-cased before words are taken, so they part words only if a-z do.
        self.word[0x41:0x5B] = self.word[0x61:0x7B]
        self.value = numbers(256, 7)[folded]
        self.value[~self.word] = 0


SPACED = Alphabet(SPACES)
PLAIN = Alphabet(NON_WORD)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """hashes: of all words of a block; first: the index of each text's first word, and the end; starts: byte offsets."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each text in them; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes, or one text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def split(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Words:
    """The words of a block of texts; offsets begin at 0."""
    inside = alphabet.word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), starts)
    up, down = powers(len(data))
    values = alphabet.value[data]
    values *= up[: len(data)]
    hashes = mix(np.add.reduceat(values, starts) * down[starts])
    return Words(hashes, np.searchsorted(starts, offsets), starts)


def split_column(column: pa.Array, alphabet: Alphabet, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_bytes(column)
    for at, end in blocks(offsets, limit):
        yield at, end, split(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], alphabet)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of so many words of each text, and the text of each; a shorter text is one run."""
    owner = words.owner()
    n = len(words.hashes)
    if not n:
        return np.zeros(0, np.uint64), owner
    runs = np.zeros(n, np.uint64)
    left = words.first[1:][owner] - np.arange(n)
    for k in range(min(size, n)):
        part = words.hashes[k:] * np.uint64((int(BASE) + 2 * k * 0xD1342543DE82EF95) % (1 << 64))
        runs[: n - k] += np.where(left[: n - k] > k, mix(part + np.uint64(k)), np.uint64(0))
    # A run that its text cuts short counts only if it is the whole text.
    keep = (left >= size) | ((left == words.counts[owner]) & (left < size))
    short = (left < size).astype(np.uint64) * left.astype(np.uint64)
    return mix(runs + short)[keep], owner[keep]


def distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, in order."""
    if not len(hashes):
        return hashes, owner
    hashes = hashes.copy()
    edges = np.flatnonzero(np.diff(owner)) + 1
    for at, end in zip([0, *edges], [*edges, len(hashes)], strict=True):
        hashes[at:end].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], owner[keep]


def long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def batch_of(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)
