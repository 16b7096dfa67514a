"""Benchmark decontamination with suffix arrays of the training text.

Training documents form shards of bounded size. Each shard's words get a suffix array, in which
every suffix of every benchmark item is looked up by binary search, one word deeper at a time. The
interval at the depth of a window holds all its occurrences; where a suffix stops is its longest
verbatim match. Documents never leave their task: nothing is shuffled. Suffixes of less than a
window are not looked up, as no match of theirs counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attach import attach
from .shared import Scratch
from .words import PLAIN, Words, split, split_column, text_bytes

WINDOW = 10
#: Bytes of benchmark text that one pass holds in every task; more text takes more passes.
PASS_BYTES = 16 << 20
#: Bytes of training text in a shard (a longer text makes one of its own).
SHARD_BYTES = 2 << 20
#: Pairs of a place and a benchmark suffix that are looked at together.
PAIRS = 1 << 20

#: The column that carries findings from pass to pass.
BEFORE = "found in earlier passes"
MATCH = "n_words long, hits array<int>, items array<string>, longest long, longest_at long, longest_item string"


@dataclass
class Items:
    """A benchmark: its words end to end, each word's item, and for each suffix the window that starts there (0: none)."""

    names: list[str]
    words: np.ndarray
    left: np.ndarray
    item: np.ndarray
    window: np.ndarray


def items_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Items:
    data, offsets = text_bytes(pa.array([text for _, text in rows], pa.large_string()))
    words = split(data, offsets, PLAIN)
    owner = words.owner()
    left = words.first[1:][owner] - np.arange(len(owner))
    size = words.counts[owner]
    starts = np.where(left >= window, window, np.where((size < window) & (left == size), left, 0))
    return Items(["" if name is None else str(name) for name, _ in rows], words.hashes, left, owner, starts)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a word sequence in the order of what follows, to the given depth, by prefix doubling."""
    n, rank, k = len(ids), ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        key = rank * np.int64(max(int(rank.max()), n) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1:
            break
    return order


def bound(values: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each search, the first place in [low, high) whose word at this depth is not below (after: is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        word = values[order[np.where(open_, middle, 0)] + depth]
        right = open_ & ((word <= wanted) if after else (word < wanted))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)


@dataclass
class Shard:
    """Training words with a suffix array. Texts end in word 0, which no item has; back: which word stands at a place (-1: none)."""

    values: np.ndarray
    order: np.ndarray
    back: np.ndarray
    wanted: np.ndarray


def shard_of(words: Words, items: Items) -> Shard:
    vocabulary, ids = np.unique(words.hashes, return_inverse=True)
    # The tail lets a search look past the end.
    depth = int(items.left.max())
    gap = words.owner()
    values = np.zeros(len(ids) + int(gap[-1]) + 1 + depth, np.int64)
    place = np.arange(len(ids)) + gap
    values[place] = ids + 1
    back = np.full(len(values), -1, np.int64)
    back[place] = np.arange(len(ids))
    found = np.minimum(np.searchsorted(vocabulary, items.words), len(vocabulary) - 1)
    wanted = np.where(vocabulary[found] == items.words, found + 1, -1)
    # Windows are all that is searched for, so the order need be no deeper.
    return Shard(values, suffix_array(values[: len(values) - depth], min(depth, int(items.window.max()))), back, wanted)


def intervals(shard: Shard, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The benchmark suffixes whose windows occur in a shard, each with the interval of the order that holds all its occurrences."""
    first = shard.values[shard.order]
    low, high = np.searchsorted(first, shard.wanted, "left"), np.searchsorted(first, shard.wanted, "right")
    active = np.flatnonzero((low < high) & (items.window > 0))
    low, high = low[active], high[active]
    found = []
    for at in range(1, int(items.window.max(initial=0)) + 1):
        full = items.window[active] == at
        found.append(np.stack([active[full], low[full], high[full]]))
        active, low, high = active[~full], low[~full], high[~full]
        if not len(active):
            break
        next_word = shard.wanted[active + at]
        low, high = bound(shard.values, shard.order, low, high, at, next_word, False), bound(shard.values, shard.order, low, high, at, next_word, True)
        live = low < high
        active, low, high = active[live], low[live], high[live]
    suffix, low, high = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return suffix, low, high


def longest_matches(shard: Shard, items: Items, suffix: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(places, suffix, window) of verbatim matches that begin with a window and can't be begun a word earlier.

    Occurrences of a window are parted by the word before them, so that a match is met once and
    not again from each of its later windows, however often a text or an item repeats itself.
    """
    before = np.where(shard.order > 0, shard.values[shard.order - 1], 0)
    early = suffix > 0
    early[early] = (items.item[suffix[early] - 1] == items.item[suffix[early]]) & (items.window[suffix[early] - 1] > 0)
    previous = np.where(early, shard.wanted[suffix - 1], -2)
    # Within each interval, places in order of the word before them.
    kinds = {}
    for lo, hi in {*zip(low.tolist(), high.tolist(), strict=True)}:
        own = lo + np.argsort(before[lo:hi], kind="stable")
        kinds[lo, hi] = own, before[own]
    # A suffix takes the places below and above those with its own previous word.
    for which, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        own, word = kinds[lo, hi]
        a, b = np.searchsorted(word, previous[which], "left"), np.searchsorted(word, previous[which], "right")
        for part in (own[:a], own[b:]):
            for at in range(0, len(part), PAIRS):
                yield shard.order[part[at : at + PAIRS]], int(suffix[which]), int(items.window[suffix[which]])


def grown(shard: Shard, items: Items, place: np.ndarray, suffix: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words match from each place and suffix on, from a length on that is known to."""
    length, going = length.copy(), np.arange(len(place))
    while len(going):
        going = going[length[going] < items.left[suffix[going]]]
        going = going[shard.values[place[going] + length[going]] == shard.wanted[suffix[going] + length[going]]]
        length[going] += 1
    return length


def matches(column: pa.Array, items: Items) -> dict[str, list]:
    n = len(column)
    out: dict[str, list] = {"n_words": [0] * n, "hits": [[]] * n, "items": [[]] * n, "longest": [0] * n, "longest_at": [None] * n, "longest_item": [None] * n}
    for at, end, words in split_column(column, PLAIN, SHARD_BYTES):
        out["n_words"][at:end] = words.counts.tolist()
        if not len(words.hashes) or not items.window.any():
            continue
        shard = shard_of(words, items)
        suffix, low, high = intervals(shard, items)
        if len(suffix):
            note(out, at, words, items, shard, suffix, low, high)
    return out


def note(out: dict[str, list], at: int, words: Words, items: Items, shard: Shard, suffix: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Writes what a shard's texts (from number `at` on) share with the items."""
    # Equal windows have one interval: its places are marked once, as a difference of starts and ends.
    spans, which = np.unique(np.stack([low, high, items.window[suffix]]), axis=1, return_inverse=True)
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    of: dict[int, set[int]] = {}
    for (lo, hi, size), own in zip(spans.T.tolist(), groups(items.item[suffix], which, spans.shape[1]), strict=True):
        place = shard.back[shard.order[lo:hi]]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        for d in np.unique(np.searchsorted(words.first, place, "right") - 1).tolist():
            of.setdefault(d, set()).update(own.tolist())
    inside = np.cumsum(cover[:-1]) > 0
    # A text's last hit word and the next text's first one don't touch.
    start = inside & ~np.concatenate([[False], inside[:-1]])
    stop = inside & ~np.concatenate([inside[1:], [False]])
    edges = words.first[(words.first > 0) & (words.first < len(inside))]
    start[edges], stop[edges - 1] = inside[edges], inside[edges - 1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    doc = np.searchsorted(words.first, start, "right") - 1
    for d, own in of.items():
        a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
        out["hits"][at + d] = (np.stack([start[a:b], stop[a:b]], axis=1) - words.first[d]).reshape(-1).tolist()
        out["items"][at + d] = sorted({items.names[k] for k in own})

    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> None:
        place, own, size = (np.concatenate(x) for x in zip(*waiting, strict=True))
        length = grown(shard, items, place, own, size)
        word = shard.back[place]
        text = np.searchsorted(words.first, word, "right") - 1
        best = np.lexsort((own, word, -length, text))
        best = best[np.concatenate([[True], text[best][1:] != text[best][:-1]])]
        for d, n, w, k in zip(text[best].tolist(), length[best].tolist(), word[best].tolist(), own[best].tolist(), strict=True):
            w -= int(words.first[d])
            if (n, -w) > (out["longest"][at + d], -(out["longest_at"][at + d] or 0)):
                out["longest"][at + d], out["longest_at"][at + d], out["longest_item"][at + d] = n, w, items.names[items.item[k]]
        waiting.clear()

    held = 0
    for place, own, size in longest_matches(shard, items, suffix, low, high):
        waiting.append((place, np.full(len(place), own), np.full(len(place), size)))
        held += len(place)
        if held >= PAIRS:
            settle()
            held = 0
    if waiting:
        settle()


def groups(values: np.ndarray, which: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct values of each of n groups."""
    order = np.lexsort((values, which))
    return [np.unique(x) for x in np.split(values[order], np.searchsorted(which[order], np.arange(1, n)))]


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(row, found): the carried columns of each document and what it shares with the benchmark (item_id, text).

    found: n_words; hits, the word ranges (start, end, start, end, ...) that windows cover; items,
    the ids of items with a window there, as sorted strings (a null id is the empty string);
    longest, longest_at, longest_item: the longest verbatim match that begins with a window, in
    words, the first of the longest, and its item. A null or empty text has no words, and a null
    or empty item no window. Items are sent to every task, in passes of bounded size; each pass
    adds to what the passes before it found. An item larger than a pass makes one of its own.
    Repeated rows get equal findings; an empty table gives no rows.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    named = benchmark.select(F.col("item_id").cast("string").alias("name"), "text")
    texts = named.withColumn("pass", F.pmod(F.xxhash64("name", "text"), F.lit(passes)))
    frame, scratch = docs, Scratch(spark, "contamination")
    for k in range(passes):
        items = items_of([(r["name"], r["text"]) for r in texts.where(F.col("pass") == k).collect()], window)
        sent = spark.sparkContext.broadcast(items)
        if k == passes - 1 == 0:
            return attach(docs, carry, lambda: lambda column, sent=sent: matches(column, sent.value), MATCH)
        got = attach(frame, frame.columns, lambda sent=sent: lambda column: matches(column, sent.value), MATCH)
        all_found = joined(F.col(f"row.`{BEFORE}`"), F.col("found")) if k else F.col("found")
        # Each pass is written, so that its items can go before the next ones come.
        frame = scratch.cut(got.select(*(F.col(f"row.`{c}`") for c in docs.columns), all_found.alias(BEFORE)), f"pass-{k}")
        sent.destroy()
        if k:
            scratch.drop(f"pass-{k - 1}")
    return frame.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(BEFORE).alias("found"))


def joined(a: Column, b: Column) -> Column:
    """Two passes' findings as one; ranges may overlap and are merged by digest()."""
    better = b["longest"] > a["longest"]
    return F.struct(
        a["n_words"].alias("n_words"), F.concat(a["hits"], b["hits"]).alias("hits"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
        *(F.when(better, b[c]).otherwise(a[c]).alias(c) for c in ("longest", "longest_at", "longest_item")),
    )


def hit_words(hits: Column) -> Column:
    """Words that ranges cover; ranges of several passes may overlap."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.floor(F.size(hits) / 2) - 1), lambda k: F.struct(F.get(hits, (2 * k).cast("int")).alias("s"), F.get(hits, (2 * k + 1).cast("int")).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    total = F.aggregate(pairs, start, lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0), p["e"] - F.greatest(p["s"], acc["upto"]))).cast("long").alias("n"), F.greatest(acc["upto"], p["e"]).alias("upto")), lambda acc: acc["n"])
    return F.when(F.size(hits) > 0, total).otherwise(F.lit(0).cast("long"))


def digest(found: DataFrame) -> DataFrame:
    """The findings as numbers: n_words, n_hit, n_items, items_sha256, contaminated, and the longest match in words."""
    f = F.col("found")
    out = found.select("row.doc_id", f["n_words"].alias("n_words"), hit_words(f["hits"]).alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(f["items"], ",").cast("binary"), 256).alias("items_sha256"), f["longest"].alias("longest"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of a benchmark item."""
    return contamination(spark, docs, benchmark, docs.columns, window).where(F.size("found.items") == 0).select("row.*")
