"""Token counts that follow edits without encoding a document again.

A document is a sequence of pre-tokens, which byte-pair merges never cross. Its tree has leaves of
a few dozen pre-tokens with their lengths and token counts, and inner nodes with the sums. An edit
is found by descending along the sums. Pre-tokens are cut again from shortly before the edit until
a cut falls where the old text had one too; from there on nothing changes. The new pre-tokens are
counted, the leaves that held the old ones are replaced, and the sums above them are updated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .attach import attach

#: Where the vocabulary lies unless a caller says otherwise, and how its texts are cut.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A cut depends on the text before it and on at most so many characters after it.
LOOKAHEAD = 2
LEAF = 48
#: Pre-tokens whose counts a task keeps at hand.
CACHE = 200_000

Edit = tuple[int, int, str]


class Counter(dict):
    """Token counts of pre-tokens, kept for those seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        super().__init__()
        self.cut = regex.compile(pattern)
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = len(self.encode(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TokenTree:
    """The pre-tokens of one text under a tree of sums (characters, tokens)."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.encoded = text, counter, 0
        pieces = counter.pieces(text)
        self._build(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(counter.counts(pieces), np.int64))

    def _build(self, lengths: np.ndarray, counts: np.ndarray) -> None:
        edges = range(0, max(1, len(lengths)), LEAF)
        self.leaves = [(lengths[a : a + LEAF], counts[a : a + LEAF]) for a in edges]
        self.room = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.room, 2), np.int64)
        if len(lengths):
            self.sums[self.room : self.room + len(self.leaves), 0] = np.add.reduceat(lengths, edges)
            self.sums[self.room : self.room + len(self.leaves), 1] = np.add.reduceat(counts, edges)
        low = self.room
        while low > 1:
            self.sums[low // 2 : low] = self.sums[low : 2 * low].reshape(-1, 2, 2).sum(axis=1)
            low //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pre_tokens(self) -> int:
        return sum(len(lengths) for lengths, _ in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with the character at a place (the last leaf for the end), and where it begins."""
        node, before = 1, 0
        while node < self.room:
            node *= 2
            if place - before >= self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.room, before

    def _put(self, leaf: int, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.leaves[leaf] = (lengths, counts)
        node = self.room + leaf
        change = np.array([lengths.sum(), counts.sum()]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; gives the new number of tokens."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("an edit lies within the text")
        # A cut stands if everything that it depends on lies before the edit.
        leaf, place = self._leaf_at(max(0, start - LOOKAHEAD))
        lengths, counts = self.leaves[leaf]
        cuts = place + np.cumsum(lengths)
        kept = int(np.searchsorted(cuts, start - LOOKAHEAD, "right"))
        begin = int(cuts[kept - 1]) if kept else place
        first = leaf
        while not kept and first and begin > start - LOOKAHEAD:
            # The leaf's own first cut is too near: begin at the leaf before.
            first -= 1
            lengths, counts = self.leaves[first]
            begin -= int(lengths.sum())
            place, cuts = begin, begin + np.cumsum(lengths)
            kept = int(np.searchsorted(cuts, start - LOOKAHEAD, "right"))
            begin = int(cuts[kept - 1]) if kept else place

        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # Old cuts from the edit's end on, in the new text's terms, leaf by leaf.
        at, last, old = begin, first, kept
        made: list[str] = []
        matcher = self.counter.cut.finditer(self.text, begin)
        old_at = begin
        for found in matcher:
            made.append(found.group())
            at = found.end()
            while last < len(self.leaves) and old_at + shift < at:
                if old == len(self.leaves[last][0]):
                    if last + 1 == len(self.leaves):
                        break
                    last, old = last + 1, 0
                    continue
                old_at += int(self.leaves[last][0][old])
                old += 1
            if old_at >= end and old_at + shift == at:
                break
        else:
            last, old = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += sum(map(len, made))
        fresh = np.fromiter(map(len, made), np.int64, len(made)), np.array(self.counter.counts(made), np.int64)
        head, tail = (x[:kept] for x in self.leaves[first]), [x[old:] for x in self.leaves[last]]
        joined = [np.concatenate([a, b]) for a, b in zip(head, fresh, strict=True)]
        empty = np.zeros(0, np.int64)
        for k in range(first + 1, last + (first != last)):
            self._put(k, empty, empty)
        self._put(first, *(joined if first != last else [np.concatenate([a, b]) for a, b in zip(joined, tail, strict=True)]))
        if first != last:
            self._put(last, *tail)
        if len(self.leaves[first][0]) > 8 * LEAF:
            self._build(*(np.concatenate(x) for x in zip(*self.leaves, strict=True)))
        return self.tokens


#: What production cleaning replaces in a text, and by what.
CLEANING = (
    (r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})+", "<email>"),
    (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "<ip>"),
    (r"(?<!\w)(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?!\w)", "<key>"),
    (r"(?<![\w+])\+?\d{1,3}[ -]\(?\d{2,4}\)?[ -]\d{3,4}[ -]?\d{3,4}(?!\w)", "<phone>"),
)


@dataclass(frozen=True)
class Cleaning:
    """Edits of a text: each match of a pattern goes, from the end to the start, so that places stay valid."""

    rules: tuple[tuple[str, str], ...] = CLEANING

    def __call__(self, text: str) -> list[Edit]:
        found: list[Edit] = []
        for pattern, new in self.rules:
            if "@" in pattern and "@" not in text:
                continue
            found += [(m.start(), m.end(), new) for m in re.finditer(pattern, text)]
        out: list[Edit] = []
        for edit in sorted(found, key=lambda e: (-e[1], e[0])):
            if not out or edit[1] <= out[-1][0]:
                out.append(edit)
        return out


COUNTS = "n_tokens long, n_pretokens long, n_edits long, n_tokens_edited long, n_chars_encoded_again long"


def token_counts(spark: SparkSession, docs: DataFrame, carry: list[str], edits: Callable[[str], list[Edit]] = Cleaning(), ranks: str = RANKS) -> DataFrame:
    """(row, found): the carried columns of each document, its token count, and the count after its edits.

    edits(text) lists (start, end, new) in the order in which they are made, each in terms of the
    text as it is by then. found: n_tokens and n_pretokens before, n_edits, n_tokens_edited after,
    and how many characters had to be cut and encoded again. A null text is an empty one: 0 tokens.
    The vocabulary is read by the driver from `ranks` and sent to the tasks; it has a fixed size.
    """
    sent = spark.sparkContext.broadcast(load_ranks(ranks))

    def make():
        counter = Counter(sent.value)

        def count(column: pa.Array) -> dict[str, list]:
            out: dict[str, list] = {name: [] for name in COUNTS.replace(",", "").split()[::2]}
            for text in texts(column):
                changes = edits(text)
                if changes:
                    tree = TokenTree(text, counter)
                    row = [tree.tokens, tree.pre_tokens, len(changes)]
                    for change in changes:
                        tree.edit(*change)
                    row += [tree.tokens, tree.encoded]
                else:
                    pieces = counter.pieces(text)
                    n = sum(counter.counts(pieces))
                    row = [n, len(pieces), 0, n, 0]
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
            return out

        return count

    return attach(docs, carry, make, COUNTS)


def texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""
