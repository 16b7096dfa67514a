"""Numpy kernels for what no DataFrame operation expresses: constrained fits and hierarchical linkage.

All of them work on second moments (d x d) alone; only the logistic and Poisson losses need rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


#: k!
TERM = np.cumprod(np.maximum(np.arange(13.0), 1.0))


def expm(a: np.ndarray) -> np.ndarray:
    """exp of square matrices (..., d, d): scaled Taylor series, squared back."""
    norm = float(np.abs(a).sum(axis=-1).max()) if a.size else 0.0
    if not np.isfinite(norm):
        return np.full_like(a, np.inf)
    halvings = max(0, int(np.ceil(np.log2(norm))) + 2) if norm > 0.25 else 0
    x = a / 2.0**halvings
    one = np.eye(a.shape[-1])
    out = one
    # Terms below 1e-17 of the sum are left out.
    terms = next(k for k in range(1, 13) if k == 12 or (norm / 2.0**halvings) ** k < 1e-17 * TERM[k])
    for k in range(terms, 0, -1):
        out = one + x @ out / k
    for _ in range(halvings):
        out = out @ out
    return out


def expm_each(a: np.ndarray) -> np.ndarray:
    """expm of each of (n, d, d) as if it were alone: with its own scaling and number of terms, so that small differences of its trace are the same."""
    norm = np.abs(a).sum(axis=-1).max(axis=-1)
    finite = np.isfinite(norm)
    halvings = np.zeros(len(a), int)
    large = finite & (norm > 0.25)
    halvings[large] = np.maximum(0, np.ceil(np.log2(norm[large])).astype(int) + 2)
    share = np.where(finite, norm, 0.0) / 2.0**halvings
    enough = share[:, None] ** np.arange(1, 12) < 1e-17 * TERM[1:12]
    kind = np.where(finite, halvings * 16 + np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, 12), -1)
    out = np.full_like(a, np.inf)
    for one in np.unique(kind[finite]):
        rows = np.flatnonzero(kind == one)
        out[rows] = expm_of(a[rows], *divmod(int(one), 16))
    return out


def expm_of(a: np.ndarray, halvings: int, terms: int) -> np.ndarray:
    one = np.eye(a.shape[-1])
    x, out = a / 2.0**halvings, one
    for k in range(terms, 0, -1):
        out = one + x @ out / k
    for _ in range(halvings):
        out = out @ out
    return out


def acyclicity(w: np.ndarray) -> tuple[float, np.ndarray]:
    """tr(exp(W o W)) - d and its gradient, clipped as the fits need it."""
    w = np.clip(w, -5.0, 5.0)
    e = expm(w * w)
    h = float(np.clip(np.trace(e) - len(w), 0.0, 1e3))
    return h, np.clip(2 * w * e.T, -1e3, 1e3)


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, free: np.ndarray, memory: int = 10, rounds: int = 15000, f_tol: float = 2.220446049250313e-09, g_tol: float = 1e-5, curvature: np.ndarray | None = None) -> np.ndarray:
    """The minimum of f (value and gradient) over x >= 0, x = 0 where not free. curvature: about the Hessian's diagonal, if known.

    A limited-memory quasi-Newton direction in the coordinates that aren't held at the bound, and
    a backtracking search along its projection. A step to where f isn't finite is too long.
    """
    with np.errstate(all="ignore"):
        return _minimize(f, x, free, memory, rounds, f_tol, g_tol, curvature)


def _minimize(f, x, free, memory, rounds, f_tol, g_tol, curvature) -> np.ndarray:
    x = np.where(free, np.maximum(x, 0.0), 0.0)
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(np.where(free, x - np.maximum(x - g, 0.0), 0.0)).max(initial=0.0) <= g_tol:
            break
        open_ = free & ~((x <= 0) & (g > 0))
        q = np.where(open_, g, 0.0)
        used = []
        for s, y, _ in reversed(steps):
            s_, y_ = s * open_, y * open_
            sy = float(s_ @ y_)
            if sy > 1e-12 * float(y_ @ y_):
                a = float(s_ @ q) / sy
                q = q - a * y_
                used.append((a, s_, y_, sy))
        if used:
            _, s_, y_, sy = used[0]
            q = q * (sy / float(y_ @ y_))
        elif curvature is not None:
            q = q / curvature
        else:
            q = q / max(1.0, float(np.linalg.norm(q)))
        for a, s_, y_, sy in reversed(used):
            q = q + s_ * (a - float(y_ @ q) / sy)
        direction = -np.where(open_, q, 0.0)
        if float(direction @ g) >= 0:
            direction = -np.where(open_, g, 0.0)
        size, before = 1.0, value
        for _ in range(40):
            trial = np.maximum(x + size * direction, 0.0)
            new, new_g = f(trial)
            if np.isfinite(new) and new <= value + 1e-4 * float(g @ (trial - x)):
                break
            size *= 0.5
        else:
            break
        s, y = trial - x, new_g - g
        if float(s @ y) > 1e-10 * float(y @ y):
            steps = [*steps[-(memory - 1) :], (s, y, 0.0)]
        x, value, g = trial, new, new_g
        if before - value <= f_tol * max(abs(before), abs(value), 1.0):
            break
    return x


def minimize_many(f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, free: np.ndarray, curvature: np.ndarray | None = None, memory: int = 10, rounds: int = 15000, f_tol: float = 2.220446049250313e-09, g_tol: float = 1e-5) -> np.ndarray:
    """minimize for many problems at once: x is (problems, coordinates), f takes points and the numbers of their problems.

    Each problem goes its own way as if it were alone, and leaves when it is done; all array
    operations are shared. Directions follow from inner products of the kept steps alone.
    """
    with np.errstate(all="ignore"):
        return _minimize_many(f, x, free, curvature, memory, rounds, f_tol, g_tol)


def _minimize_many(f, x, free, curvature, memory, rounds, f_tol, g_tol) -> np.ndarray:
    dot = lambda a, b: np.einsum("...i,...i->...", a, b)
    out = np.where(free, np.maximum(x, 0.0), 0.0)
    at, x = np.arange(len(out)), out
    value, g = f(x, at)
    s, y = np.zeros((2, len(x), memory, x.shape[1]))  # newest first
    kept, below = np.zeros((len(x), memory), bool), np.tri(memory, k=-1, dtype=bool)
    done = np.zeros(len(x), bool)
    for _ in range(rounds):
        done |= np.abs(np.where(free, x - np.maximum(x - g, 0.0), 0.0)).max(axis=1, initial=0.0) <= g_tol
        if done.any():
            out[at[done]] = x[done]
            at, x, value, g, s, y, kept = (v[~done] for v in (at, x, value, g, s, y, kept))
            done = np.zeros(len(x), bool)
        if not len(at):
            return out
        open_ = free & ~((x <= 0) & (g > 0))
        q = np.where(open_, g, 0.0)
        direction = q / (np.maximum(1.0, np.sqrt(dot(q, q)))[:, None] if curvature is None else curvature[at])
        depth = int(kept.any(axis=0).sum())
        if depth:
            s_, y_ = s[:, :depth] * open_[:, None], y[:, :depth]
            sy, yy = s_ @ y_.swapaxes(1, 2), (y_ * open_[:, None]) @ y_.swapaxes(1, 2)
            sq, yq = (s_ @ q[:, :, None])[..., 0], (y_ @ q[:, :, None])[..., 0]
            own, size = np.einsum("bii->bi", sy), np.einsum("bii->bi", yy)
            used, rows = kept[:, :depth] & (own > 1e-12 * size), np.arange(len(at))
            # Newest first, each coefficient follows from those before it: two triangular systems.
            both = used[:, :, None] & used[:, None]
            lower = np.where(both & below[:depth, :depth], sy, 0.0)
            lower[:, range(depth), range(depth)] = np.where(used, own, 1.0)
            a = np.linalg.solve(lower, np.where(used, sq, 0.0)[..., None])[..., 0]
            first = used.argmax(axis=1)
            scale = np.where(used[rows, first], own[rows, first] / np.maximum(size[rows, first], 1e-300), 1.0)
            turned = scale[:, None] * (yq - (yy @ a[:, :, None])[..., 0])
            b = np.linalg.solve(lower.swapaxes(1, 2), np.where(used, a * own - turned, 0.0)[..., None])[..., 0]
            step = scale[:, None] * (q - (a[:, None] @ (y_ * open_[:, None]))[:, 0]) + (b[:, None] @ s_)[:, 0]
            direction = np.where(used.any(axis=1)[:, None], step, direction)
        direction = -np.where(open_, direction, 0.0)
        direction = np.where((dot(direction, g) >= 0)[:, None], -np.where(open_, g, 0.0), direction)

        size, trial, new, new_g = np.ones(len(at)), x.copy(), value.copy(), g.copy()
        seek = np.arange(len(at))
        for _ in range(40):
            point = np.maximum(x[seek] + size[seek, None] * direction[seek], 0.0)
            v, v_g = f(point, at[seek])
            fine = np.isfinite(v) & (v <= value[seek] + 1e-4 * dot(g[seek], point - x[seek]))
            hit = seek[fine]
            trial[hit], new[hit], new_g[hit] = point[fine], v[fine], v_g[fine]
            seek = seek[~fine]
            if not len(seek):
                break
            size[seek] *= 0.5
        done[seek] = True
        ds, dy = trial - x, new_g - g
        store = dot(ds, dy) > 1e-10 * dot(dy, dy)
        store[seek] = False
        for old, latest in ((s, ds), (y, dy), (kept, np.ones(len(at), bool))):
            old[store, 1:] = old[store, :-1]
            old[store, 0] = latest[store]
        done |= value - new <= f_tol * np.maximum(np.maximum(np.abs(value), np.abs(new)), 1.0)
        x, value, g = trial, new, new_g
    out[at] = x
    return out


def signed(x: np.ndarray, d: int) -> np.ndarray:
    return (x[: d * d] - x[d * d :]).reshape(d, d)


def halves(w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum(w, 0.0).ravel(), np.maximum(-w, 0.0).ravel()])


def off_diagonal(d: int) -> np.ndarray:
    return np.tile(~np.eye(d, dtype=bool).ravel(), 2)


def edge_mask(d: int, edges=(), parents=(), children=()) -> np.ndarray:
    """Which coordinates may move: no self loops, no forbidden edge (parent, child), parent or child."""
    allowed = ~np.eye(d, dtype=bool)
    for a, b in edges:
        allowed[a, b] = False
    allowed[list(parents), :] = False
    allowed[:, list(children)] = False
    return np.tile(allowed.ravel(), 2)


def penalized(s: np.ndarray, l1: float, alpha: float = 0.0, rho: float = 0.0, pull: float = 0.0, centre: np.ndarray | None = None):
    """The objective of one subject: half the reconstruction error, l1, the acyclicity terms, and pull/2 ||W||^2 - pull <W, centre> for its neighbours."""
    d = len(s)
    one = np.eye(d)

    def f(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = np.clip(signed(x, d), -10, 10)
        left = s @ (w - one)
        value, g = 0.5 * float(((w - one) * left).sum()) + l1 * float(x.sum()), left
        if alpha or rho:
            h, gh = acyclicity(w)
            value += alpha * h + 0.5 * rho * h * h
            g = g + (alpha + rho * h) * gh
        if pull:
            value += pull * float((0.5 * w * w * centre[0] - w * centre[1]).sum())
            g = g + pull * (w * centre[0] - centre[1])
        g = g.ravel()
        return value, np.concatenate([g + l1, l1 - g])

    return f


def penalized_many(s: np.ndarray, l1: np.ndarray, alpha: np.ndarray | None = None, rho: np.ndarray | None = None, pull: np.ndarray | None = None, held: float = 0.0, centre: np.ndarray | None = None):
    """penalized for many subjects at once: s is (problems, d, d), penalties have a number a problem, `held` is what multiplies ||W||^2."""
    d = s.shape[-1]
    one = np.eye(d)

    def f(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.minimum(np.maximum((x[:, : d * d] - x[:, d * d :]).reshape(-1, d, d), -10), 10)
        away = w - one
        left = s[at] @ away
        value, g = 0.5 * np.einsum("kij,kij->k", away, left) + l1[at] * x.sum(axis=1), left
        if alpha is not None:
            short = np.minimum(np.maximum(w, -5.0), 5.0)
            e = expm(short * short)
            h = np.minimum(np.maximum(np.einsum("kii->k", e) - d, 0.0), 1e3)
            value = value + alpha[at] * h + 0.5 * rho[at] * h * h
            g = g + (alpha[at] + rho[at] * h)[:, None, None] * np.minimum(np.maximum(2 * short * e.swapaxes(1, 2), -1e3), 1e3)
        if pull is not None:
            middle = centre[at]
            value = value + pull[at] * np.einsum("kij,kij->k", w, 0.5 * held * w - middle)
            g = g + pull[at, None, None] * (w * held - middle)
        g = g.reshape(len(x), -1)
        return value, np.concatenate([g + l1[at, None], l1[at, None] - g], axis=1)

    return f


#: Variables up to which a subject's problem is solved with its Hessian, of (d^2)^2 numbers.
NEWTON_MOST = 12


def newton_many(s: np.ndarray, l1: np.ndarray, alpha: np.ndarray, rho: np.ndarray, pull: np.ndarray, held: float, centre: np.ndarray, w: np.ndarray, off: np.ndarray, rounds: int = 200, f_tol: float = 2.220446049250313e-09, g_tol: float = 1e-5) -> np.ndarray:
    """The minima that minimize_many seeks for penalized_many, from w (problems, d, d), by steps with the Hessian.

    The Hessian leaves out how the acyclicity term's gradient turns, and is positive definite
    without it. Entries keep their sign within a step, and those that would change it become 0.
    """
    d = s.shape[-1]
    size, one, free = d * d, np.eye(d), off.ravel()
    base = np.einsum("kab,ce->kacbe", s, one).reshape(-1, size, size)
    base[:, range(size), range(size)] += pull[:, None] * held + 1e-12

    def f(x: np.ndarray, at: np.ndarray):
        m = np.minimum(np.maximum(x.reshape(-1, d, d), -10), 10)
        away, middle = m - one, centre[at]
        left, short = s[at] @ away, np.minimum(np.maximum(m, -5.0), 5.0)
        e = expm(short * short)
        h = np.minimum(np.maximum(np.einsum("kii->k", e) - d, 0.0), 1e3)
        turned = e.swapaxes(1, 2)
        slope = np.minimum(np.maximum(2 * short * turned, -1e3), 1e3)
        value = 0.5 * np.einsum("kij,kij->k", away, left) + alpha[at] * h + 0.5 * rho[at] * h * h
        value += pull[at] * np.einsum("kij,kij->k", m, 0.5 * held * m - middle) + l1[at] * np.abs(x).sum(axis=1)
        force = alpha[at] + rho[at] * h
        g = left + force[:, None, None] * slope + pull[at, None, None] * (m * held - middle)
        return value, g.reshape(len(x), -1), slope.reshape(len(x), -1), (2 * force[:, None, None] * turned).reshape(len(x), -1)

    with np.errstate(all="ignore"):
        out = np.where(free, w.reshape(len(w), -1), 0.0)
        at, x = np.arange(len(out)), out
        value, g, slope, bend = f(x, at)
        done = np.zeros(len(x), bool)
        for _ in range(rounds):
            side = np.where(x == 0, -np.sign(g) * (np.abs(g) > l1[at, None]), np.sign(x))
            moves = free & (side != 0)
            lean = np.where(moves, g + l1[at, None] * side, 0.0)
            done |= np.abs(lean).max(axis=1, initial=0.0) <= g_tol
            if done.any():
                out[at[done]] = x[done]
                at, x, value, g, slope, bend, side, moves, lean = (v[~done] for v in (at, x, value, g, slope, bend, side, moves, lean))
                done = np.zeros(len(x), bool)
            if not len(at):
                return out.reshape(-1, d, d)
            hessian = base[at] + (rho[at, None] * slope)[:, :, None] * slope[:, None]
            hessian *= moves[:, :, None] & moves[:, None]
            diagonal = hessian[:, range(size), range(size)]
            hessian[:, range(size), range(size)] = np.where(moves, diagonal + bend, 1.0)
            step = -np.linalg.solve(hessian, lean[..., None])[..., 0]
            uphill = ~(np.einsum("ki,ki->k", step, lean) < 0)
            step[uphill] = -lean[uphill]
            part, seek = np.ones(len(at)), np.arange(len(at))
            trial, new = x.copy(), value.copy()
            # A step with the Hessian has its right length; where a few halvings don't help, rounding hides what is left.
            for _ in range(8):
                point = x[seek] + part[seek, None] * step[seek]
                point = np.where(point * side[seek] > 0, point, 0.0)
                v, *rest = f(point, at[seek])
                fine = np.isfinite(v) & (v <= value[seek] + 1e-4 * np.einsum("ki,ki->k", lean[seek], point - x[seek]))
                hit = seek[fine]
                trial[hit], new[hit] = point[fine], v[fine]
                g[hit], slope[hit], bend[hit] = (r[fine] for r in rest)
                seek = seek[~fine]
                if not len(seek):
                    break
                part[seek] *= 0.5
            done[seek] = True
            done |= value - new <= f_tol * np.maximum(np.maximum(np.abs(value), np.abs(new)), 1.0)
            x, value = trial, new
        out[at] = x
        return out.reshape(-1, d, d)


def lasso(s: np.ndarray, l1: float) -> np.ndarray:
    """A warm start: no acyclicity, zero diagonal."""
    d = len(s)
    return signed(minimize(penalized(s, l1), np.zeros(2 * d * d), off_diagonal(d)), d)


def notears(s: np.ndarray, beta: float, mask: np.ndarray | None = None, rounds: int = 100, h_tol: float = 1e-8, least: float = 0.0, commit: bool = False) -> np.ndarray:
    """One acyclic matrix for one second moment, by the augmented Lagrangian. commit: keep a solution though its cycles didn't shrink enough."""
    d = len(s)
    free = off_diagonal(d) if mask is None else mask
    one = np.eye(d)

    def acyclic(w: np.ndarray) -> tuple[float, np.ndarray]:
        e = expm(w * w)
        return float(np.trace(e)) - d, 2 * w * e.T

    x, rho, alpha, h = np.zeros(2 * d * d), 1.0, 0.0, np.inf
    for _ in range(rounds):
        while rho < 1e20:

            def f(v: np.ndarray, rho=rho, alpha=alpha) -> tuple[float, np.ndarray]:
                w = signed(v, d)
                left = s @ (w - one)
                now, gh = acyclic(w)
                g = (left + (alpha + rho * now) * gh).ravel()
                return 0.5 * float(((w - one) * left).sum()) + alpha * now + 0.5 * rho * now * now + beta * float(v.sum()), np.concatenate([g + beta, beta - g])

            trial = minimize(f, x, free)
            new = acyclic(signed(trial, d))[0]
            if new <= 0.25 * h:
                x, h = trial, new
                break
            if commit:
                x = trial
            rho *= 10
        alpha += rho * h
        if h <= h_tol or rho >= 1e20:
            break
    w = signed(x, d)
    return np.where(np.abs(w) < least, 0.0, w)


def notears_many(s: np.ndarray, beta: np.ndarray, mask: np.ndarray | None = None, rounds: int = 100, h_tol: float = 1e-8, least: float = 0.0) -> np.ndarray:
    """notears for many second moments (problems, d, d) at once, each with its own penalty; all array operations are shared.

    Every problem has its own multiplier and weight of the acyclicity term and leaves when it is done.
    """
    n, d = s.shape[:2]
    free, one = off_diagonal(d) if mask is None else mask, np.eye(d)
    x, rho, alpha, h = np.zeros((n, 2 * d * d)), np.ones(n), np.zeros(n), np.full(n, np.inf)
    beta, turn = np.broadcast_to(np.asarray(beta, float), n), np.zeros(n, int)
    live = np.arange(n) if rounds else np.arange(0)
    signs = lambda v: (v[:, : d * d] - v[:, d * d :]).reshape(-1, d, d)

    def acyclic(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = expm_each(w * w)
        return np.trace(e, axis1=1, axis2=2) - d, 2 * w * e.swapaxes(1, 2)

    while len(live):

        def f(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of, w = live[at], signs(v)
            away = w - one
            left = s[of] @ away
            now, gh = acyclic(w)
            g = (left + (alpha[of] + rho[of] * now)[:, None, None] * gh).reshape(len(v), -1)
            value = 0.5 * np.einsum("kij,kij->k", away, left) + alpha[of] * now + 0.5 * rho[of] * now * now + beta[of] * v.sum(axis=1)
            return value, np.concatenate([g + beta[of, None], beta[of, None] - g], axis=1)

        trial = minimize_many(f, x[live], free)
        new = acyclic(signs(trial))[0]
        better = new <= 0.25 * h[live]
        x[live[better]], h[live[better]] = trial[better], new[better]
        rho[live[~better]] *= 10
        # A round ends with a better solution, or with a weight that is too large.
        ended = live[better | (rho[live] >= 1e20)]
        alpha[ended] += rho[ended] * h[ended]
        turn[ended] += 1
        over = np.zeros(n, bool)
        over[ended] = (h[ended] <= h_tol) | (rho[ended] >= 1e20) | (turn[ended] >= rounds)
        live = live[~over[live]]
    w = signs(x)
    return np.where(np.abs(w) < least, 0.0, w)


def row_loss(rows: np.ndarray, kind: str, counts: np.ndarray | None = None):
    """Value and gradient of a loss that needs the rows: l2, logistic or poisson. counts: how often each row stands."""
    times = (np.ones(len(rows)) if counts is None else counts)[:, None]
    n = float(times.sum())

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = rows @ w
        if kind == "l2":
            gap = rows - m
            return 0.5 / n * float((gap**2 * times).sum()), -rows.T @ (gap * times) / n
        if kind == "logistic":
            return float(((np.logaddexp(0, m) - rows * m) * times).sum()) / n, rows.T @ ((0.5 * (1 + np.tanh(m / 2)) - rows) * times) / n
        if kind == "poisson":
            # Where a rate overflows the value is infinite, and a step that leads there is too long.
            e = np.exp(m)
            return float(((e - rows * m) * times).sum()) / n, rows.T @ ((e - rows) * times) / n
        raise ValueError(f"unknown loss {kind!r}")

    return f


def notears_rows(rows: np.ndarray, l1: float, kind: str = "l2", rounds: int = 100, h_tol: float = 1e-8, rho_max: float = 1e16, least: float = 0.3, counts: np.ndarray | None = None) -> np.ndarray:
    """The same for losses on rows. counts: how often each row stands."""
    d = rows.shape[1]
    rows = rows - np.average(rows, axis=0, weights=counts) if kind == "l2" else rows
    loss, free = row_loss(rows, kind, counts), off_diagonal(d)
    x, rho, alpha, h = np.zeros(2 * d * d), 1.0, 0.0, np.inf
    for _ in range(rounds):
        while rho < rho_max:

            def f(v: np.ndarray, rho=rho, alpha=alpha) -> tuple[float, np.ndarray]:
                w = signed(v, d)
                value, g = loss(w)
                e = expm(w * w)
                now = float(np.trace(e)) - d
                g = (g + (alpha + rho * now) * 2 * w * e.T).ravel()
                return value + alpha * now + 0.5 * rho * now * now + l1 * float(v.sum()), np.concatenate([g + l1, l1 - g])

            trial = minimize(f, x, free)
            w = signed(trial, d)
            new = float(np.trace(expm(w * w))) - d
            x = trial
            if new <= 0.25 * h:
                h = new
                break
            rho *= 10
        alpha += rho * h
        if h <= h_tol or rho >= rho_max:
            break
    w = signed(x, d)
    return np.where(np.abs(w) < least, 0.0, w)


def complete_linkage(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (member, member, height) of complete linkage, ascending, by nearest-neighbour chains."""
    n = len(dist)
    d = np.array((dist + dist.T) / 2, float)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            at = chain[-1]
            row = np.where(alive, d[at], np.inf)
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((a, b, float(d[a, b])))
        joined = np.maximum(d[a], d[b])
        d[a], d[:, a] = joined, joined
        d[a, a] = np.inf
        alive[b] = False
    return sorted(merges, key=lambda m: m[2])


def flat_labels(n: int, merges: list[tuple[int, int, float]], cut: float) -> np.ndarray:
    """Labels from 1, in the order of each cluster's first member; merges up to and including the cut hold."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b, height in merges:
        if height <= cut:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    order: dict[int, int] = {}
    return np.array([order.setdefault(find(k), len(order) + 1) for k in range(n)])


def jump_cut(merges: list[tuple[int, int, float]]) -> float | None:
    """The middle of the largest step between merge heights, first and last steps last; none for fewer than two merges."""
    heights = np.array(sorted(m[2] for m in merges))
    if len(heights) < 2:
        return None
    steps = np.diff(heights)
    inner = np.arange(1, len(steps) - 1)
    k = int(inner[np.argmax(steps[inner])]) if len(inner) else int(np.argmax(steps))
    return float((heights[k] + heights[k + 1]) / 2)


@dataclass(frozen=True)
class Settings:
    """Penalties and limits of a fit. cut: "tau" or "jump"; digits None leaves group matrices unrounded; least None leaves small weights."""

    l1: float = 0.1
    l2: float = 0.5
    tau: float = 0.5
    rho1: float = 0.1
    rho2: float = 0.4
    max_dc: int = 10
    max_admm: int = 20
    least: float | None = 0.01
    cut: str = "tau"
    digits: int | None = 2
    zero_diagonal: bool = False
    threshold_subjects: bool = True


@dataclass
class Fit:
    labels: np.ndarray
    subjects: np.ndarray
    groups: dict[int, np.ndarray]
    trace: list[tuple[int, int, float, float, float, float]] = field(default_factory=list)


def fit_groups(s: np.ndarray, how: Settings = Settings(), start: np.ndarray | None = None) -> Fit:
    """Group subjects by their graphs: s is (n, d, d), one second moment a subject.

    Convex rounds (a truncated fusion penalty, linearised) around consensus steps: each subject's
    matrix in turn given all others, then pair differences, then duals. A subject needs only the
    sum of what its pairs ask of it, so a step costs d^2, not n d^2; pairs are stored once.
    """
    n, d = len(s), s.shape[-1]
    if n < 2:
        raise ValueError("groups need two subjects at least")
    if how.rho2 <= 0:
        raise ValueError("rho2 must be positive")
    free, off = off_diagonal(d), ~np.eye(d, dtype=bool)
    w = np.array([lasso(x, how.l1) for x in s]) if start is None else np.where(off, start, 0.0)
    i, j = np.triu_indices(n, 1)
    norm = lambda x: np.sqrt((x * x).sum(axis=(1, 2)))

    def asked(pairs: np.ndarray) -> np.ndarray:
        out = np.zeros((n, d, d))
        np.add.at(out, i, pairs)
        np.subtract.at(out, j, pairs)
        return out

    theta_hat, u = w[i] - w[j], np.zeros((len(i), d, d))
    alpha, rho1, last, trace = np.zeros(n), how.rho1, np.inf, []
    for outer in range(how.max_dc):
        before = norm(theta_hat)
        fused = (before < how.tau) if before.max() >= 1e-12 else np.zeros(len(i), bool)
        theta, h_last = theta_hat, None
        for inner in range(how.max_admm):
            ask, total, new = asked(theta + u), w.sum(axis=0), w.copy()
            for k in range(n):
                rest = total - w[k]
                goal = penalized(s[k], how.l1, alpha[k], rho1, how.rho2, (n - 1.0, ask[k] + rest))
                bend = np.tile((np.repeat(np.diag(s[k]), d) + how.rho2 * (n - 1)), 2)
                new[k] = signed(minimize(goal, halves(np.where(off, w[k], 0.0)), free, curvature=bend), d)
                total = rest + new[k]
            gap = new[i] - new[j]
            wanted = np.nan_to_num(gap - u, nan=0.0, posinf=1e3, neginf=-1e3)
            shrink = np.where(fused, np.maximum(1 - how.l2 / how.rho2 / (norm(wanted) + 1e-12), 0.0), 1.0)
            theta_new = wanted * shrink[:, None, None]
            primal, dual = float(norm(theta_new - gap).mean()), float(norm(how.rho2 * (theta_new - theta)).mean())
            theta = theta_new
            u = u + theta - gap
            each = np.array([acyclicity(x)[0] for x in new])
            h = float(each.sum())
            h = h if np.isfinite(h) and h > 0 else 1e-8
            if h_last is not None and h > 0.25 * h_last and rho1 < 1e16:
                rho1 = min(5 * rho1, 1e16)
            alpha = alpha + rho1 * each
            trace.append((outer, inner, primal, dual, rho1, h))
            if inner >= 4 and primal < 1e-3 and dual < 1e-3 * how.rho2:
                break  # the matrices stay those of the sweep before
            w, h_last = new, h
        theta_hat = w[i] - w[j]
        now = norm(theta_hat)
        objective = sum(0.5 * float(((x - np.eye(d)) * (m @ (x - np.eye(d)))).sum()) for x, m in zip(w, s, strict=True)) + how.l1 * float(np.abs(w).sum())
        objective += float(np.where(before < how.tau, how.l2 * now, how.l2 * how.tau).sum())
        if abs(objective - last) < 5e-3:
            break
        last = objective

    return grouped(w, how, trace)


def grouped(w: np.ndarray, how: Settings, trace: list) -> Fit:
    """Groups of the fitted matrices by complete linkage, and each group's mean."""
    n, d = len(w), w.shape[-1]
    i, j = np.triu_indices(n, 1)
    dist = np.zeros((n, n))
    dist[i, j] = dist[j, i] = np.sqrt(((w[i] - w[j]) ** 2).sum(axis=(1, 2)))
    merges = complete_linkage(dist)
    cut = how.tau if how.cut == "tau" else jump_cut(merges)
    labels = np.arange(1, n + 1) if cut is None else flat_labels(n, merges, cut)
    small = lambda x: x if how.least is None else np.where(np.abs(x) < how.least, 0.0, x)
    groups = {}
    for label in range(1, labels.max() + 1):
        mean = small(w[labels == label].mean(axis=0))
        mean = mean if how.digits is None else np.round(mean, how.digits)
        groups[label] = np.where(np.eye(d, dtype=bool), 0.0, mean) if how.zero_diagonal else mean
    return Fit(labels, small(w) if how.threshold_subjects else w, groups, trace)


def fit_many(moments: np.ndarray, of: np.ndarray, hows: list[Settings]) -> list[Fit]:
    """fit_groups for many settings at once: moments is (sets, n, d, d), of[f] the set that fit f (settings hows[f]) is on.

    Every fit goes its own way through rounds and steps; the same subject's problems of all fits
    that are still going are solved together. Fits of one set and l1 share their start.
    """
    n, d = moments.shape[1:3]
    if n < 2:
        raise ValueError("groups need two subjects at least")
    if any(how.rho2 <= 0 for how in hows):
        raise ValueError("rho2 must be positive")
    if not (fits := len(hows)):
        return []
    l1, l2, tau, rho1, rho2 = (np.array([getattr(how, name) for how in hows], float) for name in ("l1", "l2", "tau", "rho1", "rho2"))
    free, off, one = off_diagonal(d), ~np.eye(d, dtype=bool), np.eye(d)
    starts, which = np.unique(np.stack([of, l1]), axis=1, return_inverse=True)
    which = which.reshape(-1)
    flat = moments[starts[0].astype(int)].reshape(-1, d, d)
    warm = minimize_many(penalized_many(flat, np.repeat(starts[1], n)), np.zeros((len(flat), 2 * d * d)), free)
    w = (warm[:, : d * d] - warm[:, d * d :]).reshape(-1, n, d, d)[which]
    i, j = np.triu_indices(n, 1)
    by_j = np.argsort(j, kind="stable")
    first_i, first_j = np.searchsorted(i, np.arange(n - 1)), np.searchsorted(j[by_j], np.arange(1, n))
    norm = lambda x: np.sqrt((x * x).sum(axis=(-2, -1)))

    def asked(pairs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(pairs), n, d, d))
        out[:, : n - 1] = np.add.reduceat(pairs, first_i, axis=1)
        out[:, 1:] -= np.add.reduceat(pairs[:, by_j], first_j, axis=1)
        return out

    theta_hat = w[:, i] - w[:, j]
    theta, u = theta_hat.copy(), np.zeros_like(theta_hat)
    alpha, last, h_last = np.zeros((fits, n)), np.full(fits, np.inf), np.full(fits, np.nan)
    outer, inner = np.zeros(fits, int), np.zeros(fits, int)
    before = norm(theta_hat)
    fused = (before < tau[:, None]) & (before.max(axis=1) >= 1e-12)[:, None]
    traces: list[list] = [[] for _ in hows]
    live = np.array([f for f, how in enumerate(hows) if how.max_dc > 0 and how.max_admm > 0], int)
    while len(live):
        own = moments[of[live]]
        ask, total, new = asked(theta[live] + u[live]), w[live].sum(axis=1), w[live].copy()
        start = np.where(off, w[live], 0.0)
        for k in range(n):
            rest = total - w[live, k]
            task = own[:, k], l1[live], alpha[live, k], rho1[live], rho2[live], n - 1.0, ask[:, k] + rest
            if d <= NEWTON_MOST:
                new[:, k] = newton_many(*task, start[:, k], off)
                total = rest + new[:, k]
                continue
            goal = penalized_many(*task)
            bend = np.tile(np.repeat(np.diagonal(own[:, k], axis1=1, axis2=2), d, axis=1) + rho2[live, None] * (n - 1), (1, 2))
            x = start[:, k].reshape(len(live), -1)
            x = minimize_many(goal, np.concatenate([np.maximum(x, 0.0), np.maximum(-x, 0.0)], axis=1), free, bend)
            new[:, k] = (x[:, : d * d] - x[:, d * d :]).reshape(-1, d, d)
            total = rest + new[:, k]
        gap = new[:, i] - new[:, j]
        wanted = np.nan_to_num(gap - u[live], nan=0.0, posinf=1e3, neginf=-1e3)
        shrink = np.where(fused[live], np.maximum(1 - (l2 / rho2)[live, None] / (norm(wanted) + 1e-12), 0.0), 1.0)
        theta_new = wanted * shrink[..., None, None]
        primal, dual = norm(theta_new - gap).mean(axis=1), norm(rho2[live, None, None, None] * (theta_new - theta[live])).mean(axis=1)
        theta[live] = theta_new
        u[live] += theta_new - gap
        short = np.clip(new, -5.0, 5.0)
        each = np.clip(np.trace(expm(short * short), axis1=2, axis2=3) - d, 0.0, 1e3)
        h = each.sum(axis=1)
        h = np.where(np.isfinite(h) & (h > 0), h, 1e-8)
        grow = (h > 0.25 * h_last[live]) & (rho1[live] < 1e16)
        rho1[live] = np.where(grow, np.minimum(5 * rho1[live], 1e16), rho1[live])
        alpha[live] += rho1[live, None] * each
        going = []
        for a, f in enumerate(live.tolist()):
            how = hows[f]
            traces[f].append((int(outer[f]), int(inner[f]), float(primal[a]), float(dual[a]), float(rho1[f]), float(h[a])))
            settled = inner[f] >= 4 and primal[a] < 1e-3 and dual[a] < 1e-3 * rho2[f]
            if not settled:  # else the matrices stay those of the sweep before
                w[f], h_last[f] = new[a], h[a]
                inner[f] += 1
                if inner[f] < how.max_admm:
                    going.append(f)
                    continue
            theta_hat[f] = w[f, i] - w[f, j]
            now, a_ = norm(theta_hat[f]), w[f] - one
            objective = 0.5 * float((a_ * (moments[of[f]] @ a_)).sum()) + l1[f] * float(np.abs(w[f]).sum()) + float(np.where(before[f] < tau[f], l2[f] * now, l2[f] * tau[f]).sum())
            outer[f] += 1
            if abs(objective - last[f]) < 5e-3 or outer[f] >= how.max_dc:
                continue
            last[f], inner[f], h_last[f], before[f], theta[f] = objective, 0, np.nan, now, theta_hat[f]
            fused[f] = (now < tau[f]) & (now.max() >= 1e-12)
            going.append(f)
        live = np.array(going, int)
    return [grouped(w[f], how, traces[f]) for f, how in enumerate(hows)]


def reconstruction(w: np.ndarray, s: np.ndarray) -> float:
    a = np.eye(len(w)) - w
    return float((a * (s @ a)).sum())


def kmeans(x: np.ndarray, k: int, starts: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Labels and inertia of the best of several starts with distance-weighted seeding."""
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            gap = ((x[:, None] - centres) ** 2).sum(-1).min(axis=1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=gap / gap.sum()) if gap.sum() else rng.integers(len(x))]])
        for _ in range(300):
            dist = ((x[:, None] - centres) ** 2).sum(-1)
            now = dist.argmin(axis=1)
            new = np.array([x[now == c].mean(axis=0) if (now == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres, atol=1e-8):
                break
            centres = new
        inertia = float(dist.min(axis=1).sum())
        if inertia < best - 1e-12:
            best, labels = inertia, now
    return labels, best


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    names = np.unique(labels)
    sums = np.zeros((len(x), len(names)))
    # Distances of some rows to all at a time.
    step = max(1, (1 << 20) // max(1, len(x)))
    for at in range(0, len(x), step):
        dist = np.sqrt(np.maximum(((x[at : at + step, None] - x) ** 2).sum(-1), 0))
        sums[at : at + step] = np.stack([dist[:, labels == c].sum(axis=1) for c in names], axis=1)
    sizes = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    other = sums / sizes
    other[rows, own] = np.inf
    b = other.min(axis=1)
    return float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).mean())
