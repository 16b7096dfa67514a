import numpy as np
import pytest
from thicket.functions import kernels as K
from thicket.operators import blocks, selection


def test_distances_keep_their_digits_for_close_and_odd_rows():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 7))
    b = np.concatenate([a[:5], a[5:10] + 1e-9, a[10:15] * 1e4, rng.normal(size=(6, 7))])
    b[-1, 0], b[-2, 0] = np.nan, np.inf
    want = np.sqrt(((a[:, None] - b) ** 2).sum(axis=2))
    assert np.allclose(blocks.distances(a, b), want, rtol=1e-9, atol=0, equal_nan=True)
    assert (np.diag(blocks.distances(a, b))[:5] == 0).all()


def test_pair_distances_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    rows = [(f"k{i:02d}", v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (None, [0.0] * 5), ("null", None), ("k00", rows[0][1])], "k string, x array<double>")
    got = {}
    for r in blocks.pair_distances(frame, "k", "x").collect():
        assert r.i < r.j
        got.setdefault((r.i, r.j), []).append(r.dist)
    names = [k for k, _ in rows] + ["null"]
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), dist in got.items():
        # The key that comes twice meets others twice, and not itself.
        assert len(dist) == (2 if a == "k00" else 1)
        assert dist[0] is None if b == "null" else abs(dist[0] - np.linalg.norm(x[int(a[1:])] - x[int(b[1:])])) < 1e-12
    assert blocks.pair_distances(frame.limit(0), "k", "x").count() == 0
    assert blocks.pair_distances(frame.limit(1), "k", "x").count() == 0
    with pytest.raises(Exception, match="different lengths"):
        blocks.pair_distances(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "k string, x array<double>"), "k", "x").collect()


def test_silhouettes_equal_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    rng = np.random.default_rng(2)
    labels = np.arange(70) % 3
    x = rng.normal(size=(70, 4)) + labels[:, None]
    rows = [(i, v.tolist(), "abc"[c]) for i, (v, c) in enumerate(zip(x, labels.tolist(), strict=True))]
    frame = spark.createDataFrame(rows, "id long, x array<double>, label string")
    got = [r.silhouette for r in selection.silhouette(frame).orderBy("id").collect()]
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for i in range(70):
        mean = [dist[i, labels == c].sum() / ((labels == c).sum() - (labels[i] == c)) for c in range(3)]
        a, b = mean[labels[i]], min(m for c, m in enumerate(mean) if c != labels[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-12
    assert abs(np.mean(got) - K.silhouette(x, labels)) < 1e-9
    # One of its label, none of another, no label, equal points: all 0.
    odd = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b"), (3, [1.0], "b"), (4, [5.0], None)], "id long, x array<double>, label string")
    assert [r.silhouette for r in selection.silhouette(odd).orderBy("id").collect()] == [0.0, 1.0, 1.0, 0.0]
    same = spark.createDataFrame([(i, [1.0], "ab"[i % 2]) for i in range(4)], "id long, x array<double>, label string")
    assert {r.silhouette for r in selection.silhouette(same).collect()} == {0.0}
