"""Near duplicates among embeddings by lattice hashing.

Each table projects unit vectors at random to eight dimensions and decodes them to the nearest
point of the E8 lattice, the densest packing there. A vector is filed under its own point and asks
at the neighbouring points that lie closest; whoever is filed there is a candidate. Candidates are
sifted by an 8-bit copy of the vectors, whose error is bounded, so that no link is lost there, and
confirmed by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .near_dedup import runs
from .shared import Scratch
from .words import batch_of, long, mix

#: Candidate pairs that are sifted at a time.
PAIRS = 1 << 17


@dataclass(frozen=True)
class Lattice:
    """With 20 tables, scale 1.2 and 2 neighbours asked from either side, a pair of cosine 0.95 is missed with probability 0.006, one of 0.97 with 0.00002."""

    cosine: float = 0.95
    tables: int = 20
    scale: float = 1.2
    probes: int = 2
    seed: int = 5


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    gap = (x - near)[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by a half in every coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    steps = [v for v in product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
    halves = [tuple(x / 2 for x in v) for v in product((-1, 1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(steps + halves, float)


def cell_keys(points: np.ndarray, table: int, size: int) -> np.ndarray:
    key = np.full(len(points), (table << 32) + size, np.uint64)
    for column in (points * 2).astype(np.int64).T:
        key = mix(key * np.uint64(31) + column.astype(np.uint64))
    return long(key)


def usable(vectors: list) -> list[np.ndarray | None]:
    """Vectors of length one; None for null, empty, zero, and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or not len(v) or any(c is None for c in v) else np.asarray(v, float)
        top = 0.0 if x is None else np.abs(x).max()
        out.append(x / top / np.linalg.norm(x / top) if x is not None and np.isfinite(top) and top > 0 else None)
    return out


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places and unit vectors of the usable rows."""
    good = [(k, x) for k, x in enumerate(usable(column.to_pylist())) if x is not None]
    return np.array([k for k, _ in good], np.int64), [x for _, x in good]


CELL = "key long, asks boolean, vec_id long, error double, scale double, copy binary"


def cells(vectors: DataFrame, how: Lattice) -> DataFrame:
    """Where each vector is filed (asks false) and where it asks, with its 8-bit copy and the norm of the copy's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = neighbours()
        for batch in batches:
            at, rows = unit_rows(batch.column("embedding"))
            ids = np.asarray(batch.column("vec_id"))[at]
            sizes = np.array([len(x) for x in rows])
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                x = np.stack([rows[k] for k in mine])
                scale = np.abs(x).max(axis=1) / 127
                copy = np.rint(x / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(x - copy * scale[:, None], axis=1)
                packed = pa.array([c.tobytes() for c in copy], pa.binary())
                for table in range(how.tables):
                    rng = np.random.default_rng((how.seed, table, size))
                    y = x @ (rng.standard_normal((size, 8)) * how.scale) + rng.random(8)
                    home = nearest_e8(y)
                    near = np.argsort(-((y - home) @ around.T), axis=1, kind="stable")[:, : how.probes]
                    for probe in range(-1, how.probes):
                        points = home if probe < 0 else home + around[near[:, probe]]
                        yield batch_of(CELL.replace(",", "").split()[::2], [cell_keys(points, table, size), np.full(len(mine), probe >= 0), ids[mine], error, scale, packed])

    return vectors.select("vec_id", "embedding").mapInArrow(run, CELL)


def sifted(how: Lattice):
    def pairs(start: np.ndarray, filed: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, filed row) of each cell: filed rows among each other, and those that ask with all filed ones."""
        row = np.arange(len(asks))
        count = np.where(asks, filed, row - start)
        ends = np.cumsum(count)
        at = 0
        while at < len(row):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = count[at:stop]
            left = np.repeat(row[at:stop], n)
            yield left, start[left] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, asks, ids, error, scale, packed in runs(batches, ["key", "asks", "vec_id", "error", "scale", "copy"]):
            edge = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(edge)
            nth = np.cumsum(edge) - 1
            filed = np.add.reduceat((~asks).astype(np.int64), first)[nth]
            start = first[nth]
            busy = (filed > 0) & ((np.diff(np.append(first, len(key)))[nth]) > 1)
            if not busy.any():
                continue
            keep = np.flatnonzero(busy)
            moved = np.cumsum(busy) - 1
            start, filed, asks_, ids_ = moved[start[keep]], filed[keep], asks[keep], ids[keep]
            width = np.array([len(p) for p in packed[keep]])
            copies = np.zeros((len(keep), width.max()), np.float32)
            for size in np.unique(width).tolist():
                same = np.flatnonzero(width == size)
                copies[same, :size] = np.frombuffer(b"".join(packed[keep][same]), np.int8).reshape(-1, size)
            copies *= scale[keep][:, None].astype(np.float32)
            error_ = error[keep]
            for left, right in pairs(start, filed, asks_):
                about = np.einsum("ij,ij->i", copies[left], copies[right])
                # |x.y - x'.y'| <= |x-x'| + |y-y'| (1 + |x-x'|); the rest is float32 rounding.
                slack = error_[left] + error_[right] + error_[left] * error_[right] + 1e-4
                good = np.flatnonzero((about >= how.cosine - slack) & (ids_[left] != ids_[right]))
                if len(good):
                    a, b = ids_[left[good]], ids_[right[good]]
                    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield batch_of(["a", "b"], [found[0], found[1]])

    return run


def confirmed(pairs: DataFrame, vectors: DataFrame, how: Lattice) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unit_rows(batch.column(c))[1] for c in ("x", "y"))
            good = pa.array([float(np.dot(u, v)) >= how.cosine for u, v in zip(x, y, strict=True)], pa.bool_())
            yield batch_of(["a", "b"], [batch.column(c).filter(good) for c in ("a", "b")])

    left, right = (vectors.select(F.col("vec_id").alias(i), F.col("embedding").alias(v)) for i, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_vectors(spark: SparkSession, table: DataFrame, how: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table (vec_id long, embedding array of numbers).

    Vectors are linked if their cosine is at least `how.cosine` and both have as many components.
    Null, empty and zero vectors, those with null or non-finite components and rows without vec_id
    link with nothing.
    Equal vectors are one class, compared once; a vector's links count all members. component_id
    is the smallest vec_id reachable, kept marks it.
    """
    scratch = Scratch(spark, "lattice")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    marked = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = marked.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members"))
    classes = scratch.cut(classes, "classes")

    filed = cells(classes, how).repartition("key").sortWithinPartitions("key", "asks")
    pairs = scratch.cut(filed.mapInArrow(sifted(how), "a long, b long").distinct(), "pairs")
    links = scratch.cut(confirmed(pairs, classes, how), "links")

    members = classes.select(F.col("vec_id").alias("other"), "members")
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = both.join(members, "other").groupBy("rep").agg(F.sum("members").alias("outside"))
    reps = classes.select(F.col("vec_id").alias("rep"), "embedding", "members").join(degree, "rep", "left")
    reps = reps.select("rep", "embedding", (F.col("members") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    of = marked.where("sound").join(reps, "embedding").select("vec_id", "rep", "n_links")
    of = of.union(marked.where("not sound").select("vec_id", "vec_id", F.lit(0).cast("long")))
    # vec_id is the smallest of its class, so a class's component is that of its representative.
    groups = components(links, scratch).withColumnRenamed("id", "rep")
    out = of.join(groups, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.select("vec_id", "n_links", "component_id").withColumn("kept", F.expr("vec_id <=> component_id"))
