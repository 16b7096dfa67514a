"""Fits are held against optimality conditions, known graphs and published figures."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.functions import kernels as K
from thicket.plans import preclusters
from thicket.sources import simulate


def moment(seed, d=4, m=400):
    w = simulate.random_graph("UR", d, d, seed)
    x = simulate.observations(m, w, 0.0, 1.0, seed + 1)
    return x.T @ x / m, w


@given(st.integers(0, 1000), st.floats(0.01, 30))
@settings(max_examples=25, deadline=None)
def test_expm_agrees_with_its_eigenvalues(seed, scale):
    a = np.random.default_rng(seed).standard_normal((4, 4))
    a = (a + a.T) * scale / 8
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(K.expm(a), vectors @ np.diag(np.exp(values)) @ vectors.T, rtol=1e-8)


def test_acyclicity_is_zero_only_without_cycles_and_has_the_right_gradient():
    w = simulate.random_graph("ER", 5, 6, 3)
    assert K.acyclicity(w)[0] == 0
    w = np.random.default_rng(0).standard_normal((4, 4)) * 0.4
    h, g = K.acyclicity(w)
    assert h > 0
    step = np.zeros((4, 4))
    step[1, 2] = 1e-6
    assert np.isclose((K.acyclicity(w + step)[0] - K.acyclicity(w - step)[0]) / 2e-6, g[1, 2], rtol=1e-4)


@given(st.integers(0, 300), st.sampled_from([0.001, 0.05, 0.3]))
@settings(max_examples=15, deadline=None)
def test_lasso_meets_its_optimality_conditions(seed, l1):
    s, _ = moment(seed)
    w = K.lasso(s, l1)
    g = s @ (w - np.eye(4))
    off = ~np.eye(4, dtype=bool)
    assert (np.diag(w) == 0).all()
    active = off & (np.abs(w) > 1e-6)
    assert np.abs(g + l1 * np.sign(w))[active].max(initial=0) < 1e-3
    assert (np.abs(g)[off & ~active] <= l1 + 1e-3).all()


def test_notears_finds_an_acyclic_graph_close_to_the_true_one():
    s, w = moment(7, 5, 5000)
    got = K.notears(s, 0.01)
    assert K.acyclicity(got)[0] < 1e-7
    assert K.reconstruction(got, s) < K.reconstruction(np.zeros((5, 5)), s)
    assert K.reconstruction(got, s) <= K.reconstruction(w, s) * 1.02


def test_notears_obeys_constraints():
    s, _ = moment(3)
    got = K.notears(s, 0.001, K.edge_mask(4, edges=[(0, 1)], parents=[2], children=[3]))
    assert got[0, 1] == 0 and (got[2] == 0).all() and (got[:, 3] == 0).all()


@pytest.mark.parametrize("kind", ["l2", "logistic", "poisson"])
def test_row_losses(kind):
    rng = np.random.default_rng(0)
    rows = rng.poisson(1.0, (200, 3)).astype(float) if kind == "poisson" else (rng.random((200, 3)) < 0.5).astype(float)
    w = rng.standard_normal((3, 3)) * 0.1
    loss = K.row_loss(rows, kind)
    step = np.zeros((3, 3))
    step[0, 1] = 1e-6
    assert np.isclose((loss(w + step)[0] - loss(w - step)[0]) / 2e-6, loss(w)[1][0, 1], rtol=1e-4)
    assert np.isfinite(K.notears_rows(rows, 0.05, kind)).all()
    with pytest.raises(ValueError):
        K.row_loss(rows, "other")(w)


@given(st.integers(2, 14), st.integers(0, 100), st.floats(0.05, 1.5))
@settings(max_examples=40, deadline=None)
def test_linkage_keeps_clusters_within_the_cut(n, seed, cut):
    x = np.random.default_rng(seed).random((n, 2))
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    merges = K.complete_linkage(dist)
    assert len(merges) == n - 1
    labels = K.flat_labels(n, merges, cut)
    assert all(dist[np.ix_(labels == c, labels == c)].max() <= cut for c in set(labels))
    # No two clusters could be joined and stay within the cut by the next merge.
    assert labels[0] == 1 and set(labels) == set(range(1, labels.max() + 1))


def test_linkage_joins_at_the_cut_itself_and_jumps():
    dist = np.array([[0, 1.0, 5], [1, 0, 5], [5, 5, 0]])
    merges = K.complete_linkage(dist)
    assert K.flat_labels(3, merges, 1.0).tolist() == [1, 1, 2]
    assert K.jump_cut(merges) == 3.0
    assert K.jump_cut(merges[:1]) is None


@pytest.mark.parametrize("together", [False, True])
def test_published_example(together):
    sim = simulate.clustered(50, 300, 5, (0.6, 0.4), (5, 5), 1.0, 0)
    s = np.array([x.T @ x / len(x) for x in sim.rows])
    true = np.mean([K.reconstruction(w, m) for w, m in zip(sim.weights, s, strict=True)])
    assert abs(true - 4.9667) < 5e-5
    how = K.Settings(l1=0.01, l2=0.001, tau=0.7, rho1=0.1, rho2=0.05, max_admm=15)
    fit = K.fit_many(s[None], np.array([0]), [how])[0] if together else K.fit_groups(s, how)
    sizes = sorted(np.bincount(fit.labels)[1:].tolist(), reverse=True)
    assert sizes == [30, 10, 8, 1, 1]
    found = np.mean([K.reconstruction(fit.groups[k], m) for k, m in zip(fit.labels, s, strict=True)])
    assert abs(found - 4.9526) < 0.01
    largest = np.bincount(fit.labels).argmax()
    assert {sim.labels[k] for k in np.flatnonzero(fit.labels == largest)} == {1}


def test_many_minima_are_those_of_each(monkeypatch):
    """Problems solved together end where each does alone, by steps with the Hessian and without it."""
    rng, d, n = np.random.default_rng(3), 4, 30
    x = rng.normal(size=(n, 40, d)) @ (np.eye(d) + np.triu(rng.normal(size=(n, d, d)) * 0.4, 1))
    s = x.swapaxes(1, 2) @ x / 40
    l1, alpha, rho, pull = rng.choice([0.01, 0.1], n), rng.uniform(0, 2, n), rng.choice([0.1, 10.0, 1e4], n), rng.choice([0.05, 1.0], n)
    centre, off = rng.normal(size=(n, d, d)) * 0.5, ~np.eye(d, dtype=bool)
    start = np.where(off, np.array([K.lasso(m, 0.01) for m in s]), 0.0)
    flat = np.array([K.halves(w) for w in start])
    goal = K.penalized_many(s, l1, alpha, rho, pull, 3.0, centre)
    with_hessian = K.newton_many(s, l1, alpha, rho, pull, 3.0, centre, start, off)
    without = K.minimize_many(goal, flat, K.off_diagonal(d))
    for k in range(n):
        alone = K.penalized(s[k], l1[k], alpha[k], rho[k], pull[k], (3.0, centre[k]))
        best = alone(K.minimize(alone, flat[k], K.off_diagonal(d)))[0]
        assert alone(without[k])[0] < best + 1e-3 and alone(K.halves(with_hessian[k]))[0] < best + 1e-3
        # Nothing can move: the gradient of each entry that isn't 0 balances l1, that of others is within it.
        g = alone(K.halves(with_hessian[k]))[1][: d * d].reshape(d, d) - l1[k]
        w = with_hessian[k]
        assert np.abs(np.where(w != 0, g + l1[k] * np.sign(w), np.maximum(np.abs(g) - l1[k], 0)))[off].max() < 1e-3
        assert (np.diag(w) == 0).all()


def test_fits_together_are_those_of_each():
    rng, d = np.random.default_rng(4), 3
    graphs = [np.triu(np.full((d, d), 0.6), 1), np.tril(np.full((d, d), -0.6), -1)]
    s = np.array([[(lambda x: x.T @ x / 300)(rng.normal(size=(300, d)) @ np.linalg.inv(np.eye(d) - graphs[k % 2])) for k in range(6)] for _ in range(2)])
    hows = [K.Settings(l1=a, l2=0.01, tau=t, rho2=0.05, max_dc=3, max_admm=8, cut=c) for a in (0.01, 0.1) for t in (0.2, 0.6) for c in ("tau", "jump")]
    of = np.arange(len(hows)) % 2
    for fit, k, how in zip(K.fit_many(s, of, hows), of, hows, strict=True):
        alone = K.fit_groups(s[k], how)
        assert fit.labels.tolist() == alone.labels.tolist() and np.abs(fit.subjects - alone.subjects).max() < 0.03
    assert K.fit_many(s, np.zeros(0, int), []) == []


def test_fit_refuses_what_it_cannot_do():
    with pytest.raises(ValueError):
        K.fit_groups(np.eye(3)[None])
    with pytest.raises(ValueError):
        K.fit_groups(np.stack([np.eye(3)] * 2), K.Settings(rho2=0))


@pytest.mark.parametrize("kind", simulate.GRAPHS)
def test_generated_graphs_are_acyclic(kind):
    for seed in range(5):
        w = simulate.random_graph(kind, 6, 7, seed)
        assert K.acyclicity(w)[0] == 0
        assert ((np.abs(w[w != 0]) >= 0.2) & (np.abs(w[w != 0]) <= 0.5)).all()
    if kind == "UR":
        assert np.count_nonzero(w) == 7
    with pytest.raises(ValueError):
        simulate.random_graph("none", 4, 2, 0)


def test_kmeans_and_silhouette():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 3, 6)])
    labels, _ = K.kmeans(x, 3, 5, rng)
    assert len({tuple(sorted(np.flatnonzero(labels == c))) for c in range(3)} & {tuple(range(k, k + 20)) for k in (0, 20, 40)}) == 3
    assert K.silhouette(x, labels) > 0.9


def test_silhouette_of_many_rows():
    """More rows than distances are taken at a time agree with a plain version on a part, and 6000 rows need no cap."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (3000, 2)), rng.normal(30, 1, (3000, 2))])
    labels = np.repeat([0, 1], 3000)
    assert 0.9 < K.silhouette(x, labels) < 1
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})
    assert len(preclusters._matrix(frame, ["a", "b"])) == 6000


def test_many_notears_are_single_ones_and_equal_rows_count():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 80, 4))
    x[:, :, 1] += 0.8 * x[:, :, 0]
    x[:, :, 3] -= 0.7 * x[:, :, 1]
    s = x.swapaxes(1, 2) @ x / 80
    betas = np.where(np.arange(12) % 2, 0.01, 0.1)
    many = K.notears_many(s, betas)
    single = np.stack([K.notears(one, b) for one, b in zip(s, betas, strict=True)])
    goal = lambda found: np.array([0.5 * K.reconstruction(w, one) + b * np.abs(w).sum() for w, one, b in zip(found, s, betas, strict=True)])
    # Entries are not compared: single fits of moments moved by 1e-15 end in other minima too (0 to 5 of these 12), as good ones.
    assert np.allclose(goal(many), goal(single), rtol=1e-4)
    assert max(K.acyclicity(w)[0] for w in many) < 1e-7
    mask = K.edge_mask(4, [(0, 1)])
    assert (K.notears_many(s, 0.01, mask)[:, 0, 1] == 0).all() and K.notears_many(s[:0], 0.01).shape == (0, 4, 4)
    a = np.concatenate([s * 1e-3, s * 7])
    assert np.array_equal(K.expm_each(a), [K.expm(one) for one in a])

    signs = (x[0] > 0).astype(float)
    distinct, n = np.unique(signs, axis=0, return_counts=True)
    for kind in ("l2", "logistic", "poisson"):
        assert np.allclose(K.notears_rows(signs, 0.01, kind, least=0.1), K.notears_rows(distinct, 0.01, kind, least=0.1, counts=n.astype(float)), atol=1e-3)
