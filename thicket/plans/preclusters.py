"""Preclusters within each stimulus: standardised, reduced to most of the variance, k-means with k by silhouette.

A stimulus may have any number of rows: components come from its moments, rounds of k-means are
sums over all rows, and silhouettes take blocks of rows against all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import moments, selection
from ..sources.written import written


def _matrix(frame: pd.DataFrame, features: list[str]) -> np.ndarray:
    return frame[features].to_numpy(float)


#: Rows of a stimulus that starting centres are drawn from, about; rows of a block whose silhouettes one task works out, at most.
SEED_ROWS, BLOCK_ROWS = 20_000, 50_000
#: Blocks that a stimulus is cut into before a block grows, and rows that are worth one.
BLOCKS, SMALL_ROWS = 16, 1_000
#: Tasks that blocks are dealt to, at most.
MOST_TASKS = 2_000
ROUNDS = 300
#: Numbers of a tile; rows that pass a block at once; the share of squared lengths below which a product has lost half of its digits.
TILE, PASSING, CLOSE = 1 << 18, 1 << 17, 1e-6


def points(cells: DataFrame, features: list[str], share: float = 0.8) -> DataFrame:
    """cells with n_cells, pca_dims and point: scores on the first principal components whose share of the variance exceeds `share`.

    Within a stimulus, missing and infinite values are column means and columns are standardised.
    Components are eigenvectors of the moments, d x d for a stimulus, and are applied as expressions.
    """
    d = len(features)
    inner = [f"feature {k}" for k in range(d)]
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    clean = cells.withColumns({name: F.nanvl(finite(c), F.lit(None).cast("double")) for name, c in zip(inner, features, strict=True)})
    z = moments.zscore(moments.mean_imputed(clean, inner, "stimulus"), inner, "stimulus", ddof=0).withColumn("x", F.array(*inner)).drop(*inner)

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stimulus, m, xtx in zip(batch["stimulus"], batch["m"], batch["xtx"], strict=True):
                values, vectors = np.linalg.eigh(np.asarray(xtx, float).reshape(d, d))
                values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
                dims = min(d, int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share, "right")) + 1)
                vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(d)])
                yield pd.DataFrame({"of": [stimulus], "n_cells": [m], "pca_dims": [dims], "axes": [vectors[:, :dims].T.ravel()]})

    kind = z.schema["stimulus"].dataType.simpleString()
    found = moments.additive(z, d, "stimulus").select("stimulus", "m", "xtx").mapInPandas(axes, f"of {kind}, n_cells long, pca_dims int, axes array<double>")
    score = F.transform(F.sequence(F.lit(0), F.col("pca_dims") - 1), lambda c: sum((F.get("x", F.lit(k)) * F.get("axes", c * d + k) for k in range(d)), F.lit(0.0)))
    return z.join(found, z["stimulus"].eqNullSafe(found["of"])).withColumn("point", score).drop("of", "x", "axes")


Centres = dict[tuple, np.ndarray]


def seeds(placed: DataFrame, ks: list[int], starts: int, seed: int) -> Centres:
    """{(stimulus, k): centres (starts, k, dims)}, drawn with weight by distance from a bounded share of each stimulus's rows.

    A stimulus of up to SEED_ROWS rows is drawn from as a whole.
    """
    chosen = placed.where(F.pmod(F.xxhash64("point"), F.lit(1 << 40)) < F.lit(float(SEED_ROWS)) / F.col("n_cells") * (1 << 40))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(map(tuple, frame["point"])))
        k, rng, out = int(frame["k"].iloc[0]), np.random.default_rng((seed, int(frame["k"].iloc[0]))), []
        for start in range(starts):
            at = [rng.integers(len(x))]
            gap = ((x - x[at[0]]) ** 2).sum(axis=1)
            while len(at) < k:
                at.append(rng.choice(len(x), p=gap / gap.sum()) if gap.sum() else rng.integers(len(x)))
                gap = np.minimum(gap, ((x - x[at[-1]]) ** 2).sum(axis=1))
            out.append((frame["stimulus"].iloc[0], k, start, x[at].ravel()))
        return pd.DataFrame(out, columns=["stimulus", "k", "start", "centres"])

    kind = placed.schema["stimulus"].dataType.simpleString()
    # A task a stimulus and k; a stimulus with fewer rows than k has as many centres as rows.
    wanted = F.explode(F.array_distinct(F.array(*(F.least(F.lit(k), F.col("n_cells")).cast("int") for k in ks)))).alias("k")
    drawn = chosen.select("stimulus", "point", wanted).groupBy("stimulus", "k").applyInPandas(draw, f"stimulus {kind}, k int, start int, centres array<double>").orderBy("stimulus", "k", "start").toPandas()
    return {key: np.stack(rows["centres"].to_list()).reshape(len(rows), key[1], -1) for key, rows in drawn.groupby(["stimulus", "k"], dropna=False)}


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each start's centres (starts, k, dims) for each row, and the squared distance to it."""
    flat = centres.reshape(-1, centres.shape[-1])
    dist = ((x * x).sum(axis=1)[:, None] - 2 * x @ flat.T + (flat * flat).sum(axis=1)).reshape(len(x), *centres.shape[:2])
    return dist.argmin(axis=2), np.maximum(dist.min(axis=2), 0.0)


def runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(the values of names, points) for each run of rows that share them; column 'point' has arrays of numbers, of one length in a run."""
    keys = batch.select(names).to_pandas()
    new = (keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())).any(axis=1).to_numpy()
    new[:1] = True
    starts = np.flatnonzero(new)
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        values = batch.column("point").slice(at, end - at).flatten().to_numpy(zero_copy_only=False)
        yield tuple(None if pd.isna(v) else v for v in keys.iloc[at]), values.reshape(end - at, -1)


def moved(x: np.ndarray, centres: np.ndarray) -> list[np.ndarray]:
    """[counts, sums, inertia] of rows by the nearest of each start's centres (starts, k, dims)."""
    starts, k, dims = centres.shape
    # The nearest has the largest 2 c x - c^2.
    lift = np.concatenate([2 * centres, -(centres * centres).sum(axis=2, keepdims=True)], axis=2).reshape(starts * k, dims + 1)
    total, gain = np.zeros((starts * k, dims + 1)), np.zeros(starts)
    step = max(64, TILE // (starts * k))
    for at in range(0, len(x), step):
        part = np.concatenate([x[at : at + step], np.ones((min(step, len(x) - at), 1))], axis=1)
        value = (lift @ part.T).reshape(starts, k, len(part))
        best = value.max(axis=1)
        own = (value == best[:, None]).astype(float).reshape(starts * k, -1)
        added = own @ part
        if added[:, -1].sum() != starts * len(part):  # of equally near ones the first
            own = (value.argmax(axis=1)[:, None] == np.arange(k)[:, None]).astype(float).reshape(starts * k, -1)
            added = own @ part
        total += added
        gain += best.sum(axis=1)
    return [total[:, -1], total[:, :-1], np.maximum((x * x).sum() - gain, 0.0)]


def packs(placed: DataFrame) -> RDD:
    """(stimulus, points as the bytes of their numbers, dims), some thousands of points a row, in a task a core, kept: what rounds read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"stimulus": stimulus, "x": x.tobytes(), "dims": x.shape[1]} for (stimulus,), x in runs(batch, ["stimulus"])]
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    schema = f"stimulus {placed.schema['stimulus'].dataType.simpleString()}, x binary, dims int"
    wanted = to_arrow_schema(T.StructType.fromDDL(schema))
    return placed.select("stimulus", "point").mapInArrow(pack, schema).rdd.map(tuple).coalesce(placed.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)


def lloyd(points: RDD, centres: Centres) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{(stimulus, k): (counts, sums, inertia by start)} of one pass over all packs: sums in each task, added up by the driver.

    What comes back are k (dims + 1) numbers a run and task, however many rows there are.
    """
    of: dict = {}
    for key in centres:
        of.setdefault(None if pd.isna(key[0]) else key[0], []).append((key, centres[key]))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[tuple, list[np.ndarray]] = {}
        for stimulus, x, dims in rows:
            x = np.frombuffer(x).reshape(-1, dims)
            for (_, k), c in of.get(stimulus, []):
                new = moved(x, c)
                held[stimulus, k] = new if (stimulus, k) not in held else [a + b for a, b in zip(held[stimulus, k], new, strict=True)]
        return iter(held.items())

    found: dict[tuple, list[np.ndarray]] = {}
    for key, numbers in points.mapPartitions(run).collect():
        found[key] = numbers if key not in found else [a + b for a, b in zip(found[key], numbers, strict=True)]
    out = {}
    for stimulus, keys in of.items():
        for key, c in keys:
            starts, k, dims = c.shape
            counts, sums, inertia = found[stimulus, key[1]]
            out[key] = counts.reshape(starts, k), sums.reshape(starts, k, dims), inertia
    return out


def kmeans(placed: DataFrame, ks: list[int], starts: int = 50, seed: int = 42) -> dict[tuple, tuple[np.ndarray, float]]:
    """{(stimulus, k): (centres, inertia)} of the best start. Each round moves all starts of all k that still move, in one pass over the rows."""
    going, best, points = seeds(placed, ks, starts, seed), {}, packs(placed)
    for turn in range(ROUNDS + 1):
        found, then = lloyd(points, going), {}
        for key, (counts, sums, inertia) in found.items():
            old = going[key]
            new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], old)
            still = (np.abs(new - old) > 1e-8 + 1e-5 * np.abs(old)).any(axis=(1, 2)) & (turn < ROUNDS)
            for start in np.flatnonzero(~still):
                if key not in best or inertia[start] < best[key][1] - 1e-12:
                    best[key] = old[start], float(inertia[start])
            if still.any():
                then[key] = new[still]
        if not then:
            break
        going = then
    points.unpersist()
    return best


def dealt(placed: DataFrame) -> DataFrame:
    """placed in a few tasks a core, and kept: a round is much work on few bytes, so its tasks must not follow the bytes."""
    return placed.repartition(2 * placed.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions("stimulus").persist()


def silhouettes(cells: DataFrame, features: list[str], ks: list[int], share: float = 0.8, starts: int = 50, seed: int = 42) -> DataFrame:
    """(stimulus, n_cells, pca_dims, k, silhouette): exact, from all pairs of a stimulus's rows, block against all.

    A task holds one block of rows and lets the others pass; distances are taken once for all k.
    """
    placed = dealt(points(cells, features, share).select("stimulus", "n_cells", "pca_dims", "point"))
    return scores(placed, kmeans(placed, sorted(set(ks)), starts, seed))


class Sums:
    """For each row of a block and cluster of each k, the sum of its distances to the rows that have passed."""

    def __init__(self, block: np.ndarray, centres: list[np.ndarray]):
        self.centres, self.middle = centres, block.mean(axis=0)
        self.block = block - self.middle
        self.ends = np.cumsum([len(c) for c in centres])
        self.total, self.sizes = np.zeros((len(block), self.ends[-1])), np.zeros(self.ends[-1])
        self.held, self.waiting = [], 0

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Each row's cluster for each k."""
        return np.stack([nearest(x, c[None])[0][:, 0] for c in self.centres])

    def see(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.waiting += len(x)
        if self.waiting >= PASSING:
            self.add()

    def add(self) -> None:
        """Rows that share their clusters of all k are one stretch, so that a distance is added once and not once for each k."""
        if not self.held:
            return
        x, self.held, self.waiting = np.concatenate(self.held), [], 0
        labels = self.labels(x)
        order = np.lexsort(labels)
        x, labels = x[order] - self.middle, labels[:, order]
        new = np.concatenate([[True], (labels[:, 1:] != labels[:, :-1]).any(axis=0)])
        a, b = self.block, x
        long_a, long_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        left, right = np.column_stack([-2 * a, long_a, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), long_b]).T
        wide, high = 4096, TILE // 4096
        for q in range(0, len(b), wide):
            starts = np.flatnonzero(new[q : q + wide])
            if not len(starts) or starts[0]:
                starts = np.append(0, starts)
            of, n = labels[:, q + starts], np.diff(np.append(starts, len(b[q : q + wide])))
            member = np.zeros((len(starts), self.ends[-1]))
            for own, first in zip(of, self.ends - [len(c) for c in self.centres], strict=True):
                member[np.arange(len(starts)), first + own] = 1.0
            self.sizes += n @ member
            short = len(starts) > wide // 8
            if short:  # stretches of a few rows
                member = np.repeat(member, n, axis=0)
            columns, far_b = np.ascontiguousarray(right[:, q : q + wide]), long_b[q : q + wide].max()
            for p in range(0, len(a), high):
                dist = left[p : p + high] @ columns
                # A product loses its digits where rows are close, so those are taken by their difference.
                close = dist <= CLOSE * (long_a[p : p + high].max() + far_b)
                if close.any():
                    r, c = np.nonzero(close)
                    dist[r, c] = ((a[p + r] - b[q + c]) ** 2).sum(axis=1)
                np.sqrt(dist, out=dist)
                self.total[p : p + high] += (dist if short else np.add.reduceat(dist, starts, axis=1)) @ member

    def silhouettes(self) -> list[tuple[int, float, int]]:
        """(k, sum of silhouettes, rows) of the block for each k, all rows having passed."""
        self.add()
        out = []
        for c, label, sums, n in zip(self.centres, self.labels(self.block + self.middle), np.split(self.total, self.ends[:-1], axis=1), np.split(self.sizes, self.ends[:-1]), strict=True):
            own = np.arange(len(label)), label
            a, b = sums[own] / np.maximum(n[label] - 1, 1), sums / np.maximum(n, 1)
            b[:, n == 0] = np.inf
            b[own] = np.inf
            b = b.min(axis=1)
            s = np.where((n[label] > 1) & (1 < (n > 0).sum() < n.sum()), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            out.append((len(c), float(s.sum()), len(s)))
        return out


def scores(placed: DataFrame, best: dict[tuple, tuple[np.ndarray, float]]) -> DataFrame:
    """silhouettes of placed rows by the centres of kmeans."""
    kind = placed.schema["stimulus"].dataType.simpleString()
    by_stimulus: dict = {}
    for (stimulus, _), (centres, _) in best.items():
        by_stimulus.setdefault(None if pd.isna(stimulus) else stimulus, []).append(centres)
    schema = f"stimulus {kind}, k int, total double, n long"
    wanted = to_arrow_schema(T.StructType.fromDDL(schema))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, sums = None, [], None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"stimulus": at[0], "k": k, "total": total, "n": n} for k, total, n in sums.silhouettes()], schema=wanted)

        for batch in batches:
            for (stimulus, block, passing), x in runs(batch, ["stimulus", "block", "passing"]):
                if (stimulus, block) != at:
                    if sums is not None:
                        yield out()
                    at, mine, sums = (stimulus, block), [], None
                if not passing:
                    mine.append(x)
                    continue
                if sums is None:
                    if not mine:  # a block that no row fell into
                        continue
                    sums = Sums(np.concatenate(mine), by_stimulus[stimulus])
                sums.see(x)
        if sums is not None:
            yield out()

    # Each block of each stimulus is a unit of work; a row a stimulus says where its units begin.
    firsts, units = [], 0
    for stimulus, n in placed.select("stimulus", "n_cells").distinct().collect():
        blocks = max(-(-n // BLOCK_ROWS), min(BLOCKS, -(-n // SMALL_ROWS)))
        firsts.append((stimulus, units, blocks))
        units += blocks
    starts_at = placed.sparkSession.createDataFrame(firsts, f"of {kind}, first long, blocks int")
    numbered = placed.join(F.broadcast(starts_at), placed["stimulus"].eqNullSafe(F.col("of")))
    mine = numbered.select("stimulus", F.pmod(F.xxhash64("point", F.monotonically_increasing_id()), "blocks").cast("int").alias("block"), F.lit(False).alias("passing"), "point", "first")
    others = numbered.select("stimulus", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("passing"), "point", "first")
    tasks = max(1, min(units, MOST_TASKS))
    units_met = mine.union(others).repartitionById(tasks, F.expr(f"cast((first + block) % {tasks} as int)")).drop("first").sortWithinPartitions("stimulus", "block", "passing")
    parts = units_met.mapInArrow(scored, schema).groupBy("stimulus", "k").agg((F.sum("total") / F.sum("n")).alias("silhouette"))
    shapes = placed.select(F.col("stimulus").alias("of"), "n_cells", "pca_dims").distinct()
    return parts.join(shapes, parts["stimulus"].eqNullSafe(shapes["of"])).select("stimulus", "n_cells", "pca_dims", "k", "silhouette")


def selected(scores: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(stimulus, n_cells, pca_dims, k): the smallest k whose silhouette is near the best one's."""
    chosen = selection.smallest_feasible(scores, ["stimulus"], "k", "silhouette", tolerance)
    return scores.select("stimulus", "n_cells", "pca_dims", "k").join(chosen, ["stimulus", "k"]).select("stimulus", "n_cells", "pca_dims", "k")


def assigned(cells: DataFrame, features: list[str], chosen: DataFrame, share: float = 0.8, starts: int = 50, seed: int = 42, best: dict[tuple, tuple[np.ndarray, float]] | None = None) -> DataFrame:
    """cells with cluster (from 0), for each stimulus's chosen k. Stimuli that aren't in `chosen` are left out. best: what kmeans found, if it is known."""
    wanted = [(r.stimulus, r.k) for r in chosen.select("stimulus", "k").collect()]  # a row a stimulus
    if not wanted:
        return cells.limit(0).withColumn("cluster", F.lit(0))
    placed = points(cells, features, share)
    kind = placed.schema["stimulus"].dataType.simpleString()
    if best is None:
        placed = dealt(placed)
        best = kmeans(placed, sorted({k for _, k in wanted}), starts, seed)
    rows = [(s, c.tolist()) for (s, k), (c, _) in best.items() if (s, k) in wanted]
    centres = cells.sparkSession.createDataFrame(rows, f"of {kind}, centres array<array<double>>")
    gaps = F.transform("centres", lambda c: F.aggregate(F.zip_with("point", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, v: total + v))
    joined = placed.join(centres, placed["stimulus"] == centres["of"]).withColumn("gaps", gaps)
    return joined.withColumn("cluster", (F.array_position("gaps", F.array_min("gaps")) - 1).cast("int")).select(*cells.columns, "cluster")


def preclusters(cells: DataFrame, features: list[str], ks: list[int] | None = None, tolerance: float = 0.01, starts: int = 50, least: int = 20) -> DataFrame:
    """cells (stimulus, features) with cluster, without (stimulus, cluster) groups of fewer than `least` rows."""
    placed = dealt(points(cells, features).select("stimulus", "n_cells", "pca_dims", "point"))
    best = kmeans(placed, sorted(set(ks or range(2, 11))), starts)
    # Written once: the choice reads them twice.
    found = written(scores(placed, best), "silhouettes")
    return selection.large_groups(assigned(cells, features, selected(found, tolerance), best=best), ["stimulus", "cluster"], least)
