"""Document fingerprints that add up: a homomorphic multiset hash over paragraphs.

A paragraph is what lies between line feeds. It has a wide vector: four lanes modulo 2^64 from its
bytes, and LANES lanes modulo 2^24 in which each of its byte grams adds 1 or -1 in one lane. A
document's fingerprint is the sum of its paragraphs' vectors. So the order of paragraphs doesn't
matter, equal multisets of paragraphs have equal fingerprints (unequal ones have with probability
2^-256), and an edit takes away the vectors of paragraphs that go and adds those that come. The
lanes of grams are a count sketch: their inner products estimate how many grams two texts share.

`edited_rows` needs each document's next one in order of doc_id. Rows are dealt out by ranges of
(doc_id, hash of the text) and stream through in order; the first row of each range is also sent to
the range before. Texts are shuffled once, and a task holds two texts.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import batch_of, blocks, mix, text_bytes

#: Lanes of grams, bits of each, and bytes of a gram. Likeness of unrelated texts strays from 0 by about 1 / sqrt(LANES).
LANES = 128
LANE_BITS = 24
GRAM = 8
EXACT = 4
#: Rows that a task of the ordered pass gets, about.
RANGE_ROWS = 20_000


@dataclass
class Sums:
    """Fingerprints of some texts. They add and subtract as their texts' multisets of paragraphs do."""

    exact: np.ndarray
    lanes: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.exact - other.exact, self.lanes - other.lanes)

    def written(self) -> list[str]:
        """Base64 of the exact lanes, then of the lanes of grams, lowest byte first."""
        narrow = (self.lanes & ((1 << LANE_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, LANES, 4)[:, :, : LANE_BITS // 8]
        whole = np.concatenate([self.exact.astype("<u8").view(np.uint8).reshape(-1, EXACT * 8), narrow.reshape(-1, LANES * LANE_BITS // 8)], axis=1)
        return [b64encode(row).decode() for row in whole]

    @staticmethod
    def read(written: list[str]) -> Sums:
        whole = np.frombuffer(b"".join(map(b64decode, written)), np.uint8).reshape(len(written), -1)
        exact = np.ascontiguousarray(whole[:, : EXACT * 8]).view("<u8")
        narrow = np.zeros((len(written), LANES, 4), np.uint8)
        narrow[:, :, : LANE_BITS // 8] = whole[:, EXACT * 8 :].reshape(len(written), LANES, -1)
        return Sums(exact, narrow.reshape(-1, LANES * 4).view("<u4").astype(np.int64))


def centred(lanes: np.ndarray) -> np.ndarray:
    """Lanes as numbers around 0; right while a text's sums stay below 2^23."""
    half = 1 << (LANE_BITS - 1)
    return ((lanes + half) & ((1 << LANE_BITS) - 1)) - half


def sums(texts: pa.Array) -> Sums:
    """Fingerprints of a column of texts; a null is an empty text, which has one empty paragraph."""
    data, offsets = text_bytes(texts)
    exact, lanes = np.zeros((len(texts), EXACT), np.uint64), np.zeros((len(texts), LANES), np.int64)
    for at, end in blocks(offsets):
        own = np.ascontiguousarray(data[offsets[at] : offsets[end]])
        edges = offsets[at : end + 1] - offsets[at]
        feeds = np.flatnonzero(own == 10)
        # A paragraph begins where a text does and behind each line feed; the line feed is no part of it.
        starts = np.sort(np.concatenate([edges[:-1], feeds + 1]), kind="stable")
        stops = np.sort(np.concatenate([edges[1:], feeds]), kind="stable")
        owner = np.repeat(np.arange(end - at), 1 + np.searchsorted(feeds, edges[1:]) - np.searchsorted(feeds, edges[:-1]))
        raw = own.tobytes()
        digests = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=EXACT * 8).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), "<u8").reshape(-1, EXACT)
        exact[at:end] = np.add.reduceat(digests, np.searchsorted(owner, np.arange(end - at)), axis=0)

        # Grams: each run of GRAM bytes inside a paragraph; a shorter paragraph is one, unless it is empty.
        padded = np.zeros(len(own) + GRAM, np.uint8)
        padded[: len(own)] = own
        grams = np.ndarray((len(own),), "<u8", padded.data, strides=(1,)).copy()
        sizes = stops - starts
        lone = (sizes < GRAM) & (sizes > 0)
        grams[starts[lone]] &= (np.uint64(1) << (sizes[lone].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        count = np.where(lone, 1, np.maximum(sizes - GRAM + 1, 0))
        total = int(count.sum())
        if not total:
            continue
        place = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(total)
        spread = mix(grams[place] + np.uint64(1))
        slot = np.repeat(owner, count) * LANES + (spread & np.uint64(LANES - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((spread >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
        lanes[at:end] = np.bincount(slot, sign, (end - at) * LANES).astype(np.int64).reshape(-1, LANES)
    return Sums(exact, lanes)


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """0 to 1 from two columns of fingerprints: twice the shared grams by the grams of both, as estimated; 1 for equal ones."""
    x, y = centred(a.lanes).astype(float), centred(b.lanes).astype(float)
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.divide(2 * (x * y).sum(axis=1), both, out=np.zeros(len(x)), where=both > 0)
    return np.where((a.exact == b.exact).all(axis=1), 1.0, np.clip(near, 0.0, 1.0))


def likeness_of(a: list[str], b: list[str]) -> np.ndarray:
    """likeness of written fingerprints."""
    return likeness(Sums.read(a), Sums.read(b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs as the struct `row` with `fingerprint`: map-only, for any columns. A null text counts as empty."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(["row", "fingerprint"], [batch.column("row"), pa.array(sums(batch.column("text")).written(), pa.string())])

    schema = packed.select("row", F.lit("").alias("fingerprint")).schema
    return packed.mapInArrow(run, schema)


def range_of(bounds: list[tuple[int, int]], place: Column) -> Column:
    """How many of the sorted (doc_id, hash) bounds are at most `place`: a binary search as an expression."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*(F.struct(F.lit(a).cast("long").alias("id"), F.lit(b).cast("long").alias("hash")) for a, b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(listed, at + step) <= place), at + step).otherwise(at))


def bounds_of(ids: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Sorted bounds that cut ids (doc_id) into about equal parts. An id that holds several parts is cut by hash."""
    found = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).head()[0] if parts > 1 else None
    out: list[tuple[int, int]] = []
    for value in sorted(set(found or [])):
        n = found.count(value)
        # The first bound lies before the id, the others part its rows by hash.
        out += [(value, -(1 << 63) + (k << 64) // n) for k in range(n)]
    return out


#: The next row's columns that an ordered pass adds.
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(texts: list[str], after: list[str]) -> dict[str, list | np.ndarray]:
    """Of each text and the next document's: the text with its last quarter replaced, and fingerprints found by taking away and adding paragraphs."""
    edited, old, new = [], [], []
    for text, other in zip(texts, after, strict=True):
        quarter = len(text) // 4
        cut = len(text) - quarter
        out = text[:cut] + other[:quarter]
        # Paragraphs before the one with the cut stay.
        stay = text.rfind("\n", 0, cut) + 1 if quarter else len(text)
        edited.append(out)
        old.append(text[stay:])
        new.append(out[stay:])
    column = lambda x: pa.array(x, pa.large_string())
    own = sums(column(texts))
    changed = own - sums(column(old)) + sums(column(new))
    follow = sums(column(after))
    return {
        "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited], "fingerprint": own.written(), "edited_fingerprint": changed.written(),
        "near_edited": likeness(own, changed), "near_next": likeness(own, follow),
    }


#: Characters of texts that are worked on at a time.
WORK_CHARS = 1 << 20


def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order, each range ending with the first row of the next one."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        got = edits([r[1] for r in rows], [r[2] for r in rows])
        return batch_of(["doc_id", *got], [pa.array([r[0] for r in rows], pa.int64()), *(pa.array(x) for x in got.values())])

    held, ready, chars = None, [], 0
    for batch in batches:
        for part, borrowed, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text")), strict=True):
            text = text or ""
            if held is not None and held[0] == part:
                ready.append((held[1], held[2], text))
                chars += len(held[2]) + len(text)
            held = None if borrowed else (part, doc, text)
            if chars >= WORK_CHARS:
                yield out(ready)
                ready, chars = [], 0
    if ready:
        yield out(ready)


def edited_rows(spark: SparkSession, docs: DataFrame, rows: int) -> DataFrame:
    """A row for each of docs (doc_id long, text string): EDITED. rows: about how many there are.

    The next document is that of the next larger doc_id; the last one's is the first. Rows without
    doc_id come last, rows of one doc_id stand in order of their texts' hashes. A null text is
    empty; an only document is its own next one. No rows give no rows; other columns are ignored.
    """
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // RANGE_ROWS))
    last = (1 << 63) - 1
    keyed = docs.select("doc_id", "text", F.struct(F.coalesce("doc_id", F.lit(last)).alias("id"), F.xxhash64("text").alias("hash")).alias("place"))
    bounds = bounds_of(docs.select(F.coalesce("doc_id", F.lit(last)).alias("doc_id")), parts)
    keyed = keyed.withColumn("part", range_of(bounds, F.col("place")))
    # One row a range.
    firsts = sorted((r.part, tuple(r.place)) for r in keyed.groupBy("part").agg(F.min("place").alias("place")).collect())
    if not firsts:
        return spark.createDataFrame([], EDITED)
    before = [(place, firsts[k - 1][0]) for k, (_, place) in enumerate(firsts)]
    lent = F.array(*(F.struct(F.lit(a).cast("long").alias("id"), F.lit(b).cast("long").alias("hash")) for (a, b), _ in before))
    to = F.array(*(F.lit(part) for _, part in before))
    own = F.struct("part", F.lit(False).alias("borrowed"))
    at = F.array_position(lent, F.col("place")).cast("int")
    # A text's other copies under one doc_id may be lent with it: what follows the first one lent isn't read.
    borrowed = F.struct(F.element_at(to, at).alias("part"), F.lit(True).alias("borrowed"))
    sent = keyed.select("doc_id", "text", "place", F.explode(F.when(at > 0, F.array(own, borrowed)).otherwise(F.array(own))).alias("as"))
    dealt = sent.select("as.part", "as.borrowed", "place", "doc_id", "text").repartition(parts, "part").sortWithinPartitions("part", "borrowed", "place")
    return dealt.select("part", "borrowed", "doc_id", "text").mapInArrow(ordered, EDITED)
