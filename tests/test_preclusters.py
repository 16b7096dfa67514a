"""Preclusters against plain versions of each step."""

import numpy as np
import pytest

from thicket.functions import kernels as K
from thicket.plans import preclusters

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(2)
    rows = []
    for name, n, middles in (("x", 120, (0, 6, 12)), ("y", 60, (0, 9)), ("z", 3, (1,))):
        for k in range(n):
            a, b, c = rng.normal(middles[k % len(middles)], 0.5, 3)
            rows.append((name, float(a), None if k % 17 == 0 else float(b), float("nan") if k % 23 == 0 else float(c + 3 * a), k))
    return rows


@pytest.fixture(scope="module")
def cells(spark, table):
    return spark.createDataFrame(table, "stimulus string, a double, b double, c double, point long").withColumnRenamed("point", "id").repartition(3).persist()


def plain_points(rows, share=0.8):
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], float)
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    return (u * s)[:, : int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), share, "right")) + 1]


def test_points_are_principal_scores(cells, table):
    for name in "xyz":
        own = sorted((r for r in table if r[0] == name), key=lambda r: r[4])
        want = plain_points(own)
        got = np.array([r.point for r in sorted(preclusters.points(cells, FEATURES).where(f"stimulus = '{name}'").collect(), key=lambda r: r.id)])
        assert got.shape == want.shape
        assert np.allclose(np.abs((got * want).sum(axis=0)), (want * want).sum(axis=0))  # up to the sign of a component


def test_kmeans_and_silhouettes_equal_plain_ones(cells, table, monkeypatch):
    monkeypatch.setattr(preclusters, "BLOCK_ROWS", 25)
    placed = preclusters.points(cells, FEATURES).persist()
    best = preclusters.kmeans(placed, [2, 3, 5], starts=8)
    scores = {(r.stimulus, r.k): r.silhouette for r in preclusters.silhouettes(cells, FEATURES, [2, 3, 5], starts=8).collect()}
    assert set(best) == set(scores) == {("x", 2), ("x", 3), ("x", 5), ("y", 2), ("y", 3), ("y", 5), ("z", 2), ("z", 3)}
    for (name, k), (centres, inertia) in best.items():
        x = np.array([r.point for r in placed.where(f"stimulus = '{name}'").collect()])
        dist = ((x[:, None] - centres) ** 2).sum(axis=2)
        assert np.isclose(inertia, dist.min(axis=1).sum(), atol=1e-6)
        labels = dist.argmin(axis=1)
        for c in range(k):  # a fixed point
            assert not (labels == c).any() or np.allclose(centres[c], x[labels == c].mean(axis=0), atol=1e-4)
        want = K.silhouette(x, labels) if 1 < len(set(labels)) < len(x) else 0.0
        assert np.isclose(scores[name, k], want, atol=1e-6)
        if name != "z":
            assert inertia <= 1.05 * K.kmeans(x, k, 8, np.random.default_rng(0))[1] + 1e-9
    assert max((s, k) for (name, k), s in scores.items() if name == "x")[1] == 3


def test_cells_keep_their_columns_and_get_a_cluster(spark, cells):
    out = preclusters.preclusters(cells, FEATURES, ks=[2, 3], starts=4)
    assert sorted(out.columns) == sorted([*cells.columns, "cluster"])
    sizes = [(r.stimulus, r["count"]) for r in out.groupBy("stimulus", "cluster").count().collect()]
    # Imputed values may put a cell or two elsewhere; the three cells of z are too few.
    assert sorted(s for s, _ in sizes) == ["x", "x", "x", "y", "y"] and all(abs(n - (40 if s == "x" else 30)) <= 2 for s, n in sizes) and sum(n for _, n in sizes) == 180
    assert preclusters.preclusters(cells.limit(0), FEATURES, ks=[2], starts=2).count() == 0


def test_rounds_are_many_tasks_and_run_once(spark, cells, monkeypatch):
    calls, rounds = [], preclusters.kmeans

    def counted(placed, *args):
        calls.append(placed.rdd.getNumPartitions())
        return rounds(placed, *args)

    monkeypatch.setattr(preclusters, "kmeans", counted)
    assert preclusters.preclusters(cells.coalesce(1), FEATURES, ks=[2, 3], starts=2).count() == 180
    assert calls == [2 * spark.sparkContext.defaultParallelism]


def test_a_round_moves_rows_to_the_first_nearest_centre():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(700, 2)), np.zeros((5, 2))])
    centres = rng.normal(size=(4, 3, 2))
    centres[1, 0], centres[1, 1] = (-0.5, 0.0), (0.5, 0.0)  # rows at 0 are as near to either
    centres[1, 2] = 9.0
    counts, sums, inertia = preclusters.moved(x, centres)
    dist = ((x[:, None, None] - centres) ** 2).sum(axis=3)
    label = dist.argmin(axis=2)
    assert counts.reshape(4, 3).tolist() == [[(label[:, s] == c).sum() for c in range(3)] for s in range(4)]
    assert np.allclose(sums.reshape(4, 3, 2), [[x[label[:, s] == c].sum(axis=0) for c in range(3)] for s in range(4)])
    assert np.allclose(inertia, dist.min(axis=2).sum(axis=0))


@pytest.mark.parametrize("passing, tile", [(40, 1 << 13), (1 << 17, 1 << 18)])
def test_silhouettes_add_stretches_of_equal_labels(monkeypatch, passing, tile):
    monkeypatch.setattr(preclusters, "PASSING", passing)
    monkeypatch.setattr(preclusters, "TILE", tile)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.3, size=(90, 3)) for m in (1000, 1002, 1004)])
    x[:9] = x[0]
    centres = [x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 7)]
    sums = preclusters.Sums(x[::2], centres)
    for at in range(0, len(x), 50):
        sums.see(x[at : at + 50])
    other = preclusters.Sums(x[1::2], centres)
    other.see(x)
    for (k, a, n), (_, b, m), c in zip(sums.silhouettes(), other.silhouettes(), centres, strict=True):
        label = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        assert (k, n + m) == (len(c), len(x)) and np.isclose((a + b) / len(x), K.silhouette(x, label), atol=1e-9)


def test_silhouettes_are_worked_out_once_for_the_choice(spark, cells, monkeypatch):
    names, write = [], preclusters.written
    monkeypatch.setattr(preclusters, "written", lambda frame, name: (names.append(name), write(frame, name))[1])
    assert preclusters.preclusters(cells, FEATURES, ks=[2, 3], starts=2).count() == 180
    assert names == ["silhouettes"]
