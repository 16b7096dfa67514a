"""All pairs of rows, block by block: a task holds one block of vectors and lets another pass, instead of one expression a pair.

Rows are dealt to blocks by a hash of their key, so keys should be (nearly) unique; rows of one key
don't make pairs with each other. Each two blocks, and each block with itself, meet in one task. A
block has up to BLOCK_ROWS rows, so until then the number of blocks, and of copies of a row, stays
as it is and the shuffle grows with the table; pairs are worked out, and leave, a tile at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a block at most, which one task holds; blocks that there are at least, so that all cores have work.
BLOCK_ROWS, LEAST_BLOCKS = 60_000, 12
#: Pairs of a tile, about.
TILE_PAIRS = 1 << 18
#: Below this share of the two squared lengths a product has lost half of its digits, and the difference is taken instead.
CLOSE = 1e-6
#: Numbers that differences may take in a task at once.
AT_ONCE = 1 << 22


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b: one matrix product, close pairs by their difference."""
    if a.shape[1] != b.shape[1]:
        # A block of null vectors has no length of its own.
        if np.isnan(a).all() or np.isnan(b).all():
            return np.full((len(a), len(b)), np.nan)
        raise ValueError("vectors of different lengths have no distance")
    long_a, long_b = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)
    with np.errstate(invalid="ignore", over="ignore"):
        squares = long_a + long_b - 2 * (a @ b.T)
        # What isn't a number compares as false, and goes the plain way too.
        rows, cols = np.nonzero(~((squares > CLOSE * (long_a + long_b)) & np.isfinite(squares)))
        out = np.sqrt(np.maximum(squares, 0))
        step = max(1, AT_ONCE // max(1, a.shape[1]))
        for at in range(0, len(rows), step):
            i, j = rows[at : at + step], cols[at : at + step]
            out[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
    return out


def stacked(vectors: pd.Series) -> np.ndarray:
    """Rows of one length; a null vector is one of NaN."""
    known = [len(v) for v in vectors if v is not None]
    d = known[0] if known else 0
    if any(n != d for n in known):
        raise ValueError("vectors of different lengths have no distance")
    return np.array([np.full(d, np.nan) if v is None else v for v in vectors], float).reshape(len(vectors), d)


def tiles(n: int, m: int, pairs: int) -> Iterator[tuple[slice, slice]]:
    """Pieces of an n x m table of about so many pairs."""
    wide = min(m, max(1, int(pairs**0.5)))
    high = max(1, pairs // max(1, wide))
    return ((slice(a, a + high), slice(b, b + wide)) for a in range(0, n, high) for b in range(0, m, wide))


def met(frame: DataFrame, names: list[str], run: Callable[[pd.DataFrame, Iterator[pd.DataFrame], bool], Iterator], schema: str) -> DataFrame:
    """run(a block, the pieces of another, whether they are one block) for each two blocks of frame, which has a column key. Counts the frame.

    run gives data frames, or record batches of the schema.
    """
    blocks = max(LEAST_BLOCKS, -(-frame.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    dealt = frame.select(*names, block.alias("own"))
    held = dealt.withColumn("other", F.explode(F.sequence("own", F.lit(blocks - 1)))).select(*names, F.col("own").alias("bi"), F.col("other").alias("bj"), F.lit(False).alias("passing"))
    others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), "own"))).select(*names, F.col("other").alias("bi"), F.col("own").alias("bj"), F.lit(True).alias("passing"))
    # A unit of work a task, whatever its bytes: two blocks meet in n^2 steps. In order of keys, so that products round alike in each job.
    unit = F.expr(f"bi * {blocks} - (bi * (bi + 1)) div 2 + bj").cast("int")
    units = held.union(others).repartitionById(blocks * (blocks + 1) // 2, unit).sortWithinPartitions("bi", "bj", "passing", "key")
    wanted = to_arrow_schema(T.StructType.fromDDL(schema))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for batch in batches:
            yield from batch.to_pandas().groupby(["bi", "bj", "passing"], sort=False)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (i, j), parts in groupby(cut(batches), key=lambda part: part[0][:2]):
            sides = groupby(parts, key=lambda part: part[0][2])
            passing, own = next(sides)
            if passing:
                continue
            left = pd.concat([rows for _, rows in own], ignore_index=True)
            for _, right in islice(sides, 1):
                for out in run(left, (rows for _, rows in right), i == j):
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pandas(out, schema=wanted, preserve_index=False)

    return units.mapInArrow(both, schema)


Side = dict[str, np.ndarray]


def pair_tiles(frame: DataFrame, key: str, columns: list[str], run: Callable[[Iterator[tuple[np.ndarray, np.ndarray, Side, Side]]], Iterator], schema: str, at_once: int = 1 << 15) -> DataFrame:
    """run over the tiles (i, j, first, second) of two blocks, for each two blocks: keys i < j, and the columns' rows of either.

    What run adds up over its tiles leaves a task as sums, not as pairs. Array columns are matrices,
    nulls NaN. Rows without key have no pairs.
    """
    arrays = {c for c in columns if isinstance(frame.schema[c].dataType, T.ArrayType)}
    rows = frame.select(F.col(key).alias("key"), *columns).where("key is not null")

    def sides(side: pd.DataFrame) -> Side:
        return {c: stacked(side[c]) if c in arrays else side[c].to_numpy() for c in columns}

    def of_unit(left: pd.DataFrame, pieces: Iterator[pd.DataFrame], same: bool) -> Iterator[tuple]:
        a, own = left["key"].to_numpy(), sides(left)
        for right in pieces:
            b, other = right["key"].to_numpy(), sides(right)
            for p, q in tiles(len(a), len(b), at_once):
                keys = np.concatenate([a[p], b[q]])
                both = {c: np.concatenate([own[c][p], other[c][q]]) for c in columns}
                n, m = len(a[p]), len(b[q])
                i, j = np.nonzero(a[p][:, None] < b[q]) if same else (np.repeat(np.arange(n), m), np.tile(np.arange(m), n))
                j = j + n
                ahead = keys[i] < keys[j]
                first, second = np.where(ahead, i, j), np.where(ahead, j, i)
                if len(first):
                    yield keys[first], keys[second], {c: v.take(first, axis=0) for c, v in both.items()}, {c: v.take(second, axis=0) for c, v in both.items()}

    return met(rows, ["key", *columns], lambda left, pieces, same: run(of_unit(left, pieces, same)), schema)


def whole_tiles(frame: DataFrame, key: str, columns: list[str], run: Callable[[Iterator[tuple[np.ndarray, Side, Side]]], Iterator], schema: str, at_once: int = 1 << 14) -> DataFrame:
    """run over (which pairs count, rows of either side) of tiles of two blocks, for each two blocks: as pair_tiles, but for products of rows, without a row a pair.

    All columns are matrices, nulls NaN.
    """
    rows = frame.select(F.col(key).alias("key"), *columns).where("key is not null")

    def of_unit(left: pd.DataFrame, pieces: Iterator[pd.DataFrame], same: bool) -> Iterator[tuple]:
        a, own = left["key"].to_numpy(), {c: stacked(left[c]) for c in columns}
        for right in pieces:
            b, other = right["key"].to_numpy(), {c: stacked(right[c]) for c in columns}
            for p, q in tiles(len(a), len(b), at_once):
                wanted = a[p][:, None] < b[q] if same else np.ones((len(a[p]), len(b[q])), bool)
                yield wanted, {c: v[p] for c, v in own.items()}, {c: v[q] for c, v in other.items()}

    return met(rows, ["key", *columns], lambda left, pieces, same: run(of_unit(left, pieces, same)), schema)


def pair_distances(frame: DataFrame, key: str, x: str, most: float | None = None, within: str | None = None) -> DataFrame:
    """(i, j, dist) for all keys i < j; dist is null where a vector is, or where it isn't a number. Rows without key have no pairs.

    most: only pairs that are no farther apart; within: only pairs with equal values, not null, of that column.
    """
    kind = frame.schema[key].dataType.simpleString()
    rows = frame.select(F.col(key).alias("key"), F.col(x).alias("x"), (F.lit(0) if within is None else F.col(within)).alias("within")).where("key is not null and within is not null")

    def run(left: pd.DataFrame, pieces: Iterator[pd.DataFrame], same: bool) -> Iterator[pd.DataFrame]:
        a, own = left["key"].to_numpy(), stacked(left["x"])
        for right in pieces:
            b, other = right["key"].to_numpy(), stacked(right["x"])
            for p, q in tiles(len(a), len(b), TILE_PAIRS):
                dist = distances(own[p], other[q])
                wanted = a[p][:, None] < b[q] if same else np.ones(dist.shape, bool)
                if most is not None:
                    wanted &= dist <= most
                if within is not None:
                    wanted &= left["within"].to_numpy()[p][:, None] == right["within"].to_numpy()[q]
                i, j = np.nonzero(wanted)
                if not len(i):
                    continue
                i, j, dist = a[p][i], b[q][j], dist[i, j]
                ahead = i < j
                yield pd.DataFrame({"i": np.where(ahead, i, j), "j": np.where(ahead, j, i), "dist": dist})

    return met(rows, ["key", "x", "within"], run, f"i {kind}, j {kind}, dist double")


def label_distances(frame: DataFrame, key: str, x: str, label: str) -> DataFrame:
    """(id, own, other, total, n): for each key and label, the sum and number of distances to that label's other keys.

    Sums leave a task, not pairs. Rows without key or label don't count.
    """
    kinds = [frame.schema[c].dataType.simpleString() for c in (key, label)]
    rows = frame.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(label).alias("label")).where("key is not null and label is not null")

    def runs(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels of sorted rows, and where each begins."""
        starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
        return labels[starts], starts

    def summed(ids: np.ndarray, own: np.ndarray, total: np.ndarray, n: np.ndarray, names: list) -> pd.DataFrame:
        i, k = np.nonzero(n)
        return pd.DataFrame({"id": ids[i], "own": own[i], "other": np.array(names, own.dtype)[k], "total": total[i, k], "n": n[i, k]})

    def run(left: pd.DataFrame, pieces: Iterator[pd.DataFrame], same: bool) -> Iterator[pd.DataFrame]:
        left = left.sort_values("label", kind="stable")
        a, of_a, own = left["key"].to_numpy(), left["label"].to_numpy(), stacked(left["x"])
        sums: dict = {}
        for right in pieces:
            right = right.sort_values("label", kind="stable")
            b, of_b, other = right["key"].to_numpy(), right["label"].to_numpy(), stacked(right["x"])
            back, back_n = {}, {}
            for p, q in tiles(len(a), len(b), TILE_PAIRS):
                dist = distances(own[p], other[q])
                counts = a[p][:, None] != b[q] if same else np.ones(dist.shape, bool)
                if same:
                    dist = np.where(counts, dist, 0.0)
                names, starts = runs(of_b[q])
                for name, total, n in zip(names.tolist(), np.add.reduceat(dist, starts, axis=1).T, np.add.reduceat(counts, starts, axis=1, dtype=np.int64).T, strict=True):
                    held = sums.setdefault(name, (np.zeros(len(a)), np.zeros(len(a), np.int64)))
                    held[0][p] += total
                    held[1][p] += n
                if same:
                    continue
                names, starts = runs(of_a[p])
                for name, total, n in zip(names.tolist(), np.add.reduceat(dist, starts, axis=0), np.add.reduceat(counts, starts, axis=0, dtype=np.int64), strict=True):
                    back.setdefault(name, np.zeros(len(b)))[q] += total
                    back_n.setdefault(name, np.zeros(len(b), np.int64))[q] += n
            if back:
                yield summed(b, of_b, np.stack(list(back.values()), axis=1), np.stack(list(back_n.values()), axis=1), list(back))
        if sums:
            yield summed(a, of_a, np.stack([t for t, _ in sums.values()], axis=1), np.stack([n for _, n in sums.values()], axis=1), list(sums))

    parts = met(rows, ["key", "x", "label"], run, f"id {kinds[0]}, own {kinds[1]}, other {kinds[1]}, total double, n long")
    return parts.groupBy("id", "own", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
