"""Removal of repeated byte strings by prefix-free parsing.

Parsing. The trigger of a string of `length` bytes is the smallest rolling hash among its grams of
`gram` bytes (the first of equal ones). Text positions whose strings have one trigger in common
stand together; the bytes they span are a phrase. So every string of that length lies in exactly
one phrase of its text, equal strings have equal triggers at equal places, and no phrase can be
continued into another one. Neighbouring phrases overlap by length - 1 bytes.

Dictionary. Phrases meet by trigger. A trigger that no other text position has settles its phrase:
nothing in it repeats. A phrase that occurs twice repeats as a whole. Only distinct phrases with
one trigger need a closer look: they are the dictionary, and a suffix array over it, to the depth
of the string length, puts equal strings next to each other.

Parse. Documents are lists of phrases, so what the dictionary says of a phrase goes back to its
places in the corpus. However often a passage is copied, its phrases enter the suffix array once.

All shuffles are by trigger or by document. A trigger that very many texts share streams through
its task one row at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch
from .words import batch_of, blocks, long, mix, numbers, powers, text_bytes

LENGTH = 200
GRAM = 64
#: A place in a text takes so many bits of a trigger's key; longer texts are parsed in pieces.
PLACE_BITS = 24
PIECE_BYTES = 1 << 23
#: Bytes of phrases that one suffix array is built over.
ARRAY_BYTES = 1 << 18

BYTE_VALUES = numbers(256, 11) | np.uint64(1)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def hash_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start])


def keys_of(ids: pa.Array, sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What tells documents apart: the id (if any) and the whole text."""
    known = np.asarray(ids.fill_null(0).cast(pa.int64())).astype(np.uint64)
    missing = np.asarray(ids.is_null())
    whole = hash_between(sums, offsets[:-1], offsets[1:])
    return mix(mix(known + missing.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)) + whole + np.diff(offsets).astype(np.uint64))


def minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key in each window of that width, in two passes whatever the width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the stretches to parse: whole texts, or overlapping pieces of very long ones."""
    size = np.diff(offsets)
    count = np.where(size >= length, -(-np.maximum(size - length + 1, 1) // PIECE_BYTES), 0)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + nth * PIECE_BYTES
    return text, start, np.minimum(start + PIECE_BYTES + length - 1, offsets[text + 1])


def parsed(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of a block of texts: (text, first and last string start in the block, trigger hash, phrase hash)."""
    text, start, end = pieces(offsets, length)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    width, n = length - gram + 1, len(data) - gram + 1
    grams = hash_between(sums, np.arange(n), np.arange(gram, n + gram))
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = np.zeros(len(data) - length + 1, np.uint64)
    owner = np.full(len(least), -1, np.int64)
    # Pieces of one text share grams, so of these two sets alternate, each with places of its own.
    turn = np.arange(len(text)) - np.searchsorted(text, text)
    for odd in (0, 1):
        mine = np.flatnonzero(turn % 2 == odd)
        if not len(mine):
            continue
        place = np.zeros(n, np.uint64)
        for s, e in zip(start[mine], end[mine], strict=True):
            place[s : e - gram + 1] = np.arange(e - gram + 1 - s, dtype=np.uint64)
        own = minima((grams & ~mask) | place, width)
        for k, s, e in zip(mine, start[mine], end[mine], strict=True):
            least[s : e - length + 1] = own[s : e - length + 1]
            owner[s : e - length + 1] = k
    valid = np.flatnonzero(owner >= 0)
    changes = np.ones(len(valid), bool)
    changes[1:] = (least[valid[1:]] != least[valid[:-1]]) | (owner[valid[1:]] != owner[valid[:-1]])
    edge = np.flatnonzero(changes)
    first = valid[edge]
    last = valid[np.append(edge[1:], len(valid)) - 1]
    own = owner[first]
    trigger = start[own] + (least[first] & mask).astype(np.int64)
    shape = ((trigger - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64)
    return text[own], first, last, grams[trigger], mix(hash_between(sums, first, last + length) + mix(shape))


def phrases(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The parse: (trigger, phrase, key, first, last) of every phrase of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for at, end in blocks(offsets):
                part = offsets[at : end + 1] - offsets[at]
                own = data[offsets[at] : offsets[end]]
                sums = prefix_hashes(own)
                text, first, last, trigger, phrase = parsed(own, part, sums, length, gram)
                keys = keys_of(batch.column("doc_id").slice(at, end - at), sums, part)
                yield batch_of(["trigger", "phrase", "key", "first", "last"], [long(trigger), long(phrase), long(keys[text]), first - part[text], (last - first).astype(np.int32)])

    out = docs.select("doc_id", "text").mapInArrow(run, "trigger long, phrase long, key long, first long, last int")
    return out.withColumn("last", F.col("first") + F.col("last"))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for at, end in blocks(offsets):
                part = offsets[at : end + 1] - offsets[at]
                keys = keys_of(batch.column("doc_id").slice(at, end - at), prefix_hashes(data[offsets[at] : offsets[end]]), part)
                yield batch_of(["key", "doc_id", "text"], [long(keys), batch.column("doc_id").slice(at, end - at).cast(pa.int64()), batch.column("text").slice(at, end - at).fill_null("")])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, text string")


SORTED = ["trigger", "phrase", "key", "first", "last"]


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of trigger and phrase: repeated phrases as they are, and one or two of each of several phrases with one trigger as open."""

    def told(rows: list[np.ndarray], before: list | None, after: list | None) -> pa.RecordBatch:
        trigger, phrase = rows[0], rows[1]
        n = len(trigger)
        kin = np.zeros(n + 1, bool)
        same = np.zeros(n + 1, bool)
        kin[1:n] = trigger[1:] == trigger[:-1]
        same[1:n] = kin[1:n] & (phrase[1:] == phrase[:-1])
        for at, other, k in ((0, before, 0), (n, after, -1)):
            if other is not None:
                kin[at] = other[0] == trigger[k]
                same[at] = kin[at] and other[1] == phrase[k]
        repeated = same[:-1] | same[1:]
        open_ = (kin[:-1] & ~same[:-1]) | (kin[1:] & ~same[1:])
        keep = np.flatnonzero(repeated | open_)
        return batch_of([*SORTED, "repeated", "open"], [*(c[keep] for c in rows), repeated[keep], open_[keep]])

    held: list[np.ndarray] | None = None
    before: list | None = None
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in SORTED]
        if not len(new[0]):
            continue
        rows = new if held is None else [np.concatenate([h, c]) for h, c in zip(held, new, strict=True)]
        if len(rows[0]) > 1:
            yield told([c[:-1] for c in rows], before, [c[-1] for c in rows])
            before = [c[-2] for c in rows]
        held = [c[-1:] for c in rows]
    if held is not None:
        yield told(held, before, None)


def equal_strings(data: np.ndarray, length: int) -> np.ndarray:
    """For each place of a byte sequence, a number that is equal for equal strings of that length (read past the end as 0).

    A suffix array by prefix doubling, from 8 bytes on; the last step joins two overlapping halves.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    rank, depth = np.unique(word, return_inverse=True)[1].astype(np.int64) + 1, 8
    while depth < length:
        step = min(depth, length - depth)
        key = rank * np.int64(n + 2)
        key[: max(0, n - step)] += rank[step:]
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        depth += step
    return rank


def repeated_in(phrase_data: list[bytes], length: int) -> list[np.ndarray]:
    """For each distinct phrase, the places whose strings another place of these phrases has too."""
    size = np.array([len(p) for p in phrase_data])
    start = np.cumsum(size) - size
    rank = equal_strings(np.frombuffer(b"".join(phrase_data), np.uint8), length)
    at = np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(start, size, strict=True)])
    _, inverse, count = np.unique(rank[at], return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    ends = np.cumsum(size - length + 1)
    return [np.flatnonzero(x) for x in np.split(hit, ends[:-1])]


def repeated_in_many(phrase_data: list[bytes], triggers: np.ndarray, length: int) -> list[np.ndarray]:
    """The same for one trigger with very many phrases: strings are sorted place by place from the trigger, a column at a time."""
    size = np.array([len(p) for p in phrase_data])
    data = np.frombuffer(b"".join(phrase_data), np.uint8)
    start = np.cumsum(size) - size
    out: list[list[int]] = [[] for _ in phrase_data]
    for ahead in range(int(triggers.max()) + 1):
        first = triggers - ahead
        here = np.flatnonzero((first >= 0) & (first <= size - length))
        if len(here) < 2:
            continue
        rows = data[(start[here] + first[here])[:, None] + np.arange(length)]
        _, inverse, count = np.unique(np.ascontiguousarray(rows).view(f"V{length}").reshape(-1), return_inverse=True, return_counts=True)
        for k in here[count[inverse] > 1].tolist():
            out[k].append(int(first[k]))
    return [np.array(sorted(x), np.int64) for x in out]


def stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]


def repeated_strings(opened: DataFrame, texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, first, last) of the places in open phrases whose strings occur in another phrase."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("opened")
            bounds = np.asarray(lists.offsets)
            flat = lists.flatten()
            trigger, first, last = (np.asarray(flat.field(c)) for c in ("trigger", "first", "last"))
            row = np.repeat(np.arange(len(batch)), np.diff(bounds))
            key = np.asarray(batch.column("key"))[row]
            begin, end = offsets[row] + first, offsets[row] + last + length
            for at in range(0, len(row), 20_000):
                part = slice(at, at + 20_000)
                yield batch_of(["trigger", "key", "first", "phrase"], [trigger[part], key[part], first[part], pa.array([data[b:e].tobytes() for b, e in zip(begin[part], end[part], strict=True)], pa.binary())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        waiting: list[tuple[int, int, int, bytes]] = []

        def settle(rows: list) -> pa.RecordBatch | None:
            data = [r[3] for r in rows]
            if rows[0][0] == rows[-1][0] and sum(map(len, data)) > 4 * ARRAY_BYTES:
                at = np.array([trigger_place(p, length, gram) for p in data])
                found = repeated_in_many(data, at, length)
            else:
                found = repeated_in(data, length)
            key, first, last = [], [], []
            for (_, k, base, _), places in zip(rows, found, strict=True):
                if len(places):
                    a, b = stretches(places)
                    key += [k] * len(a)
                    first += (a + base).tolist()
                    last += (b + base).tolist()
            return batch_of(["key", "first", "last"], [pa.array(key, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())])

        bytes_waiting = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("trigger", "key", "first", "phrase")), strict=True):
                if held and held[-1][0] != row[0]:
                    own = sum(len(r[3]) for r in held)
                    if waiting and bytes_waiting + own > ARRAY_BYTES:
                        yield settle(waiting)
                        waiting, bytes_waiting = [], 0
                    waiting += held
                    bytes_waiting += own
                    held = []
                held.append(row)
        if held and waiting:
            yield settle(waiting)
        if held:
            yield settle(held)

    asked = opened.groupBy("key").agg(F.collect_list(F.struct("trigger", "first", "last")).alias("opened"))
    found = asked.join(texts, "key").select("key", "opened", "text").mapInArrow(fetch, "trigger long, key long, first long, phrase binary")
    return found.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(sort, "key long, first long, last long")


def trigger_place(phrase: bytes, length: int, gram: int) -> int:
    """Where a phrase's trigger stands in it."""
    data = np.frombuffer(phrase, np.uint8)
    sums = prefix_hashes(data)
    n = len(data) - gram + 1
    grams = hash_between(sums, np.arange(n), np.arange(gram, n + gram)) & ~np.uint64((1 << PLACE_BITS) - 1)
    # The one trigger that all of the phrase's strings share.
    low, high = len(data) - length, length - gram
    return low + int(np.argmin(grams[low : high + 1]))


def removed(data: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[bytes, list[int]]:
    """What is left of a text, and the maximal removed spans as start, end, start, end, ..."""
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, first, 1)
    np.add.at(cover, np.minimum(last + length, len(data)), -1)
    gone = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), edges.tolist()


def without_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, kept binary, spans array<long>) for each row of docs (doc_id long, text string).

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else in the
    table, the same text included. spans are the maximal removed runs, start and end in turn. What
    is kept may begin or end inside a character. Texts shorter than `length`, null ones (empty)
    among them, keep everything. Rows may repeat a doc_id, or lack one; equal rows remove each other.
    """
    scratch = Scratch(spark, "repeats")
    told = phrases(docs, length, gram).repartition("trigger").sortWithinPartitions("trigger", "phrase").mapInArrow(compared, "trigger long, phrase long, key long, first long, last long, repeated boolean, open boolean")
    told = scratch.cut(told.drop("phrase"), "told")
    texts = keyed(docs)
    whole = told.where("repeated").select("key", "first", "last")
    part = repeated_strings(told.where("open").select("key", "trigger", "first", "last"), texts, length, gram)
    # Equal rows have one key and tell the same spans, each of which counts once.
    spans = whole.union(part).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("all"))
    spans = spans.select("key", F.transform("all", lambda x: x["first"]).alias("first"), F.transform("all", lambda x: x["last"]).alias("last"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            n, kept, spans = np.diff(offsets), [], []
            for k, (first, last) in enumerate(zip(batch.column("first"), batch.column("last"), strict=True)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                out = removed(text, first.values.to_numpy(), last.values.to_numpy(), length) if first.is_valid else (text, [])
                kept.append(out[0])
                spans.append(out[1])
            yield batch_of(["doc_id", "n_bytes", "kept", "spans"], [batch.column("doc_id"), n, pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))])

    return texts.join(spans, "key", "left").select("doc_id", "text", "first", "last").mapInArrow(remove, "doc_id long, n_bytes long, kept binary, spans array<long>")
