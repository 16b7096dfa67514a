"""MinHash near-duplicate detection with tensored banding.

A document is the set of its distinct word shingles. Each of a few small collections of minhashes
makes one part key, and each pair of collections one table key: m collections give m(m-1)/2
tables for the work of m. Documents that share a table key are candidates; each candidate pair
that could join two groups is confirmed on the full sets.

Work is kept off repeated content twice over: documents with one and the same set are one class
from the start, and within a key only the smallest class is paired with the rest, then twice the
one with the most links found so far (a text that many were derived from). What that leaves open
(groups that share a key by then) is told in a last pass, so no pair that shares a key and could
change a group goes unchecked: groups that keys connect meet as a cluster, cut into blocks of
bounded size, and each pair of blocks is one unit of work. A unit compares its members' parity
maps, which grow with the sets, and names only pairs that may be links: first each member's
nearest ones, then, as groups have grown by these, the rest. Nothing else is listed.

Null and empty texts have an empty set and link with nothing. Repeated doc_ids are legal: links
are found among sets, and rows of one doc_id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, bounded
from .words import SPACED, batch_of, blocks, distinct, long, mix, numbers, shingles, split, split_column, text_bytes


@dataclass(frozen=True)
class Banding:
    """shingle_words and (num, den), the least similarity, say what a link is; the rest how links are found.

    With similarity s, a collection of r minhashes agrees with probability s^r, and a pair of
    documents is found unless fewer than two collections agree. 14 collections of 3 miss a pair
    of similarity 0.8 with probability 0.0007, one of 0.85 with 0.00004; unrelated documents of
    similarity 0.02 meet in one of 91 tables with probability 6e-9.
    """

    shingle_words: int = 5
    num: int = 80
    den: int = 100
    collections: int = 14
    minhashes: int = 3
    #: Passes that pair each key's best linked class with the rest before all open pairs are taken.
    hub_rounds: int = 2


#: Bits of a set's parity map: each element flips one. Maps differ in no more bits than sets in elements.
PARITY = ["p0", "p1", "p2", "p3"]
SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, p0 long, p1 long, p2 long, p3 long, parts array<long>"


def sketches(docs: DataFrame, how: Banding) -> DataFrame:
    """A row for each document: set size, a 128-bit fingerprint of the set, and its part keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = how.collections * how.minhashes
        keys, odd = numbers(rows, 1), numbers(rows, 2) | np.uint64(1)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, end, words in split_column(batch.column("text"), SPACED):
                hashes, owner = distinct(*shingles(words, how.shingle_words))
                n = np.bincount(owner, minlength=end - at)
                full = np.flatnonzero(n)
                first = np.searchsorted(owner, full)
                sums, least = np.zeros((2, end - at), np.uint64), np.zeros((end - at, rows), np.uint64)
                if len(full):
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(mix(hashes ^ keys[k]), first)
                    for k in range(rows):
                        least[full, k] = np.minimum.reduceat((hashes ^ keys[k]) * odd[k], first)
                bits = np.bincount(owner * 256 + (mix(hashes) & np.uint64(255)).astype(np.int64), minlength=(end - at) * 256).reshape(end - at, 256)
                maps = np.packbits((bits & 1).astype(bool), axis=1).view(np.int64)
                parts = np.zeros((end - at, how.collections), np.uint64)
                for k in range(how.minhashes):
                    parts = mix(parts * np.uint64(31) + least[:, k * how.collections : (k + 1) * how.collections])
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, how.collections, 0))]).astype(np.int32)
                yield batch_of(SKETCH.replace(",", "").split()[::2], [ids.slice(at, end - at).cast(pa.int64()), n.astype(np.int64), long(sums[0]), long(sums[1]), *np.ascontiguousarray(maps.T), pa.ListArray.from_arrays(ends, pa.array(long(parts[full].reshape(-1))))])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def table_rows(classes: DataFrame, how: Banding, *order: Column) -> DataFrame:
    """A row for each class and table, grouped by key within partitions and in the given order in a key."""
    pairs = [(i, j) for j in range(how.collections) for i in range(j)]
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("parts")[i], F.col("parts")[j]) for k, (i, j) in enumerate(pairs)))
    rows = classes.select(F.explode(keys).alias("key"), *(c for c in ("component", "doc_id", "n_shingles", "degree", *PARITY) if c in classes.columns))
    return rows.repartition("key").sortWithinPartitions("key", *order)


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The sorted rows as columns, cut only where a key (the first column) ends."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(new[0]):
            continue
        change = np.flatnonzero(new[0][1:] != new[0][:-1]) + 1
        if len(change):
            cut = int(change[-1])
        elif held and held[-1][0][-1] != new[0][0]:
            cut = 0
        else:
            held.append(new)
            continue
        done = [*held, [c[:cut] for c in new]]
        yield [np.concatenate(parts) for parts in zip(*done, strict=True)]
        held = [[c[cut:] for c in new]]
    if held:
        yield [np.concatenate(parts) for parts in zip(*held, strict=True)]


def fits(how: Banding, size_a: np.ndarray, size_b: np.ndarray, maps_a: np.ndarray, maps_b: np.ndarray) -> np.ndarray:
    """Whether set sizes and parity maps leave a link possible; never false for a link.

    Linked sets differ in at most (1 - s) / (1 + s) of their sizes' sum, and their maps in no more bits.
    """
    apart = np.bitwise_count(maps_a ^ maps_b).sum(axis=0, dtype=np.int64)
    near = how.den * np.minimum(size_a, size_b) >= how.num * np.maximum(size_a, size_b)
    return near & ((how.den + how.num) * apart <= (how.den - how.num) * (size_a + size_b))


def stars(how: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each key, its first class with each other one, and whether their sizes allow a link."""
        for key, doc, size in runs(batches, ["key", "doc_id", "n_shingles"]):
            hub = hubs(key)
            fit = how.den * np.minimum(size, size[hub]) >= how.num * np.maximum(size, size[hub])
            found, at = np.unique(np.stack([doc[hub], doc])[:, doc != doc[hub]], axis=1, return_index=True)
            yield batch_of(["a", "b", "fit"], [found[0], found[1], fit[doc != doc[hub]][at]])

    return run


def hubs(key: np.ndarray) -> np.ndarray:
    """For each row, the first one of its key."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def hub_pairs(how: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each key, its first class with each other one of another group, if sizes and maps allow a link."""
        for key, group, doc, size, *parity in runs(batches, ["key", "component", "doc_id", "n_shingles", *PARITY]):
            hub = hubs(key)
            bits = np.array(parity, np.int64).view(np.uint64)
            keep = (group != group[hub]) & fits(how, size, size[hub], bits, bits[:, hub])
            a, b = doc[hub[keep]], doc[keep]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield batch_of(["a", "b"], [found[0], found[1]])

    return run


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key with several groups, the first group with each other one."""
    for key, group in runs(batches, ["key", "component"]):
        hub = hubs(key)
        other = np.flatnonzero(group != group[hub])
        found = np.unique(np.stack([group[hub[other]], group[other]]), axis=1)
        yield batch_of(["a", "b"], [found[0], found[1]])


#: Parity maps that make a block; a unit of work holds two blocks.
CLUSTER_BYTES = 4 << 20
#: Members that one member is asked about before groups are looked at again.
NEAREST = 4
MAPS = "cluster long, component long, doc_id long, n_shingles long, map binary"


def wide_maps(members: DataFrame, how: Banding) -> DataFrame:
    """(cluster, component, doc_id, text) with the set's size and its parity map of 16 to 32 bits an element instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, words in split_column(batch.column("text"), SPACED):
                hashes, owner = distinct(*shingles(words, how.shingle_words))
                edges = np.searchsorted(owner, np.arange(end - at + 1))
                maps = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    width = max(256, 16 << int(b - a).bit_length())
                    place = (mix(hashes[a:b]) & np.uint64(width - 1)).astype(np.int64)
                    maps.append(np.packbits((np.bincount(place, minlength=width) & 1).astype(bool)).tobytes())
                yield batch_of(["cluster", "component", "doc_id", "n_shingles", "map"], [*(batch.column(c).slice(at, end - at) for c in ("cluster", "component", "doc_id")), np.diff(edges).astype(np.int64), pa.array(maps, pa.binary())])

    return members.select("cluster", "component", "doc_id", "text").mapInArrow(run, MAPS)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Narrower parity maps of the same sets: elements keep the low bits of their places."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def possible(how: Banding, nearest: int):
    """Pairs of a unit's members of different groups whose sizes and maps allow a link; of each member at most the nearest so many (0: all)."""

    def pairs(group: np.ndarray, doc: np.ndarray, size: np.ndarray, part: np.ndarray, across: bool, maps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(size, kind="stable")
        group, doc, size, part, maps = (x[order] for x in (group, doc, size, part, maps))
        width = np.array([len(m) // 8 for m in maps])
        full, row = {}, np.zeros(len(maps), np.int64)
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            full[w] = np.frombuffer(b"".join(maps[mine]), np.uint64).reshape(-1, w)
            row[mine] = np.arange(len(mine))
        least = min(full)
        short = np.empty((len(maps), least), np.uint64)
        for w, rows in full.items():
            short[width == w] = folded(rows, least)
        stop = np.searchsorted(size, size * how.den // how.num, "right")
        for k in range(len(doc)):
            near = slice(k + 1, stop[k])
            others = k + 1 + np.flatnonzero((group[near] != group[k]) & ((part[near] != part[k]) | (not across)))
            most = (how.den - how.num) * (size[k] + size[others])
            keep = (how.den + how.num) * np.bitwise_count(short[others] ^ short[k]).sum(axis=1, dtype=np.int64) <= most
            others, most = others[keep], most[keep]
            if not len(others):
                continue
            apart = np.zeros(len(others), np.int64)
            for w in np.unique(width[others]).tolist():
                same, both = np.flatnonzero(width[others] == w), min(w, int(width[k]))
                apart[same] = np.bitwise_count(folded(full[w][row[others[same]]], both) ^ folded(full[width[k]][row[k]][None], both)).sum(axis=1, dtype=np.int64)
            keep = (how.den + how.num) * apart <= most
            others, apart = others[keep], apart[keep]
            if nearest and len(others) > nearest:
                others = others[np.argsort(apart, kind="stable")[:nearest]]
            yield np.minimum(doc[k], doc[others]), np.maximum(doc[k], doc[others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, *columns in runs(batches, ["unit", "component", "doc_id", "n_shingles", "part", "across", "map"]):
            edges = np.flatnonzero(unit[1:] != unit[:-1]) + 1
            for at, end in zip([0, *edges], [*edges, len(unit)], strict=True):
                group, doc, size, part, across, maps = (c[at:end] for c in columns)
                if (group != group[0]).any():
                    for a, b in pairs(group, doc, size, part, bool(across[0]), maps):
                        yield batch_of(["a", "b"], [a, b])

    return run


def units(mapped: DataFrame) -> DataFrame:
    """Members of each cluster, in order of unit: one for each pair of its blocks (and each block with itself)."""
    sizes = mapped.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("map")) / CLUSTER_BYTES).cast("int").alias("parts"))
    placed = mapped.join(bounded(sizes), "cluster").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    ends = F.least("part", "with"), F.greatest("part", "with")
    dealt = dealt.select(F.xxhash64("cluster", *ends).alias("unit"), "component", "doc_id", "n_shingles", "part", (F.col("part") != F.col("with")).alias("across"), "map")
    # A block's members meet each other in the unit that is not across.
    return dealt.repartition("unit").sortWithinPartitions("unit")


def confirmed(pairs: DataFrame, texts: DataFrame, how: Banding) -> DataFrame:
    """The pairs whose full sets meet the least similarity. texts: doc_id, text of every class named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_bytes(batch.column(c)) for c in ("text_a", "text_b")]
            for at, end in blocks(sides[0][1] + sides[1][1]):
                sets = []
                for data, offsets in sides:
                    part = offsets[at : end + 1]
                    sets.append(distinct(*shingles(split(data[part[0] : part[-1]], part - part[0], SPACED), how.shingle_words)))
                edges = [np.searchsorted(owner, np.arange(end - at + 1)) for _, owner in sets]
                good = []
                for k in range(end - at):
                    x, y = (hashes[e[k] : e[k + 1]] for (hashes, _), e in zip(sets, edges, strict=True))
                    both = np.sort(np.concatenate([x, y]))
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    good.append(how.den * shared >= how.num * (len(x) + len(y) - shared))
                keep = pa.array(good)
                yield batch_of(["a", "b"], [batch.column(c).slice(at, end - at).filter(keep) for c in ("a", "b")])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, how: Banding = Banding()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id long, text string).

    component_id is the smallest doc_id reachable by links, itself included; kept marks it. A
    row without words is its own component. Rows that repeat a doc_id get the same component. A row
    without doc_id links with nothing, has no component and is kept.
    """
    scratch = Scratch(spark, "near-dedup")
    drawn = scratch.cut(sketches(docs, how), "sketches")
    full = drawn.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("parts").alias("parts"), *(F.first(c).alias(c) for c in PARITY))
    reps = scratch.cut(classes, "classes")

    # All classes go through the tables here, so their rows are kept narrow.
    shared = scratch.cut(table_rows(reps.select("doc_id", "n_shingles", "parts"), how, F.asc("doc_id")).mapInArrow(stars(how), "a long, b long, fit boolean").distinct(), "stars")
    pairs = shared.where("fit").select("a", "b")
    # A class that shares no key of a fitting size with the smallest one there may still share it with others.
    met = scratch.cut(shared.select(F.col("a").alias("doc_id")).union(shared.select("b")).distinct(), "met")
    members = scratch.cut(reps.join(bounded(met), "doc_id", "left_semi"), "members")
    texts = scratch.cut(docs.select("doc_id", "text").join(bounded(met), "doc_id", "left_semi"), "texts")
    links = scratch.cut(confirmed(pairs, texts, how), "links-0")

    def grouped(name: str) -> DataFrame:
        return scratch.cut(components(links, scratch, f"groups-{name}").toDF("doc_id", "component"), f"known-{name}")

    def asked_anew(found: DataFrame, name: str) -> DataFrame:
        """Confirms pairs that weren't asked before."""
        nonlocal links, pairs
        asked = scratch.cut(found.distinct().join(pairs, ["a", "b"], "left_anti"), f"asked-{name}")
        new = scratch.cut(confirmed(asked, texts, how), f"links-{name}")
        links, pairs = links.union(new), pairs.union(asked)
        return new

    known, new = grouped("0"), links
    for k in range(how.hub_rounds):
        groups = members.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        ends = links.select(F.col("a").alias("doc_id")).union(links.select("b")).groupBy("doc_id").agg(F.count("*").alias("degree"))
        rows = table_rows(groups.join(ends, "doc_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), how, F.desc("degree"), F.asc("doc_id"))
        new = asked_anew(rows.mapInArrow(hub_pairs(how), "a long, b long"), f"hub-{k}")
        if not new.limit(1).count():
            break
        known = grouped(f"hub-{k}")

    groups = members.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    met_groups = scratch.cut(table_rows(groups.select("component", "parts"), how, F.asc("component")).mapInArrow(meetings, "a long, b long").distinct(), "meetings")
    clusters = scratch.cut(components(met_groups, scratch, "clusters").toDF("component", "cluster"), "clusters")
    if clusters.limit(1).count():
        of = groups.select("doc_id", "component").distinct().join(bounded(clusters), "component")
        mapped = scratch.cut(wide_maps(of.join(texts, "doc_id"), how), "maps")
        for name, nearest in (("nearest", NEAREST), ("rest", 0)):
            new = asked_anew(units(mapped).mapInArrow(possible(how, nearest), "a long, b long"), name)
            if nearest and new.limit(1).count():
                known = grouped(name)
                mapped = mapped.drop("component").join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        known = known.toDF("a", "b").union(new)
        scratch.drop("maps")
    scratch.drop("texts")

    same = full.join(reps.select("set_a", "set_b", "n_shingles", F.col("doc_id").alias("rep")), ["set_a", "set_b", "n_shingles"])
    same = same.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(known.toDF("a", "b").union(same), scratch, "last")
    out = drawn.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, how: Banding = Banding()) -> DataFrame:
    """docs with one document of each group of near duplicates; rows that repeat a doc_id stay together."""
    lost = near_duplicates(spark, docs, how).where("not kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
