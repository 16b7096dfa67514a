"""Simulated subjects: groups that share a graph, observations from its linear structural equations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

GRAPHS = ("ER", "SF", "BP", "UR")


def edges_of(kind: str, d: int, count: int, rng: np.random.Generator) -> np.ndarray:
    """A strictly upper-triangular 0/1 matrix."""
    out = np.zeros((d, d), int)
    if kind == "ER":
        chance = min(0.3, 2 * count / (d * (d - 1))) if d > 1 else 0.0
        return np.triu(rng.random((d, d)) < chance, 1).astype(int)
    if kind == "SF":
        each = max(1, count // d)
        for child in range(1, d):
            pull = out[:child].sum(axis=1) + 1e-8
            out[rng.choice(child, size=min(each, child), p=pull / pull.sum(), replace=False), child] = 1
        return out
    if kind == "BP":
        sources = max(1, d // 5)
        places = np.array([(a, b) for a in range(sources) for b in range(sources, d)])
    elif kind == "UR":
        places = np.stack(np.triu_indices(d, 1), axis=1)
    else:
        raise ValueError(f"unknown graph type {kind!r}")
    chosen = places[rng.choice(len(places), size=min(count, len(places)) if kind == "BP" else count, replace=False)]
    out[chosen[:, 0], chosen[:, 1]] = 1
    return out


def random_graph(kind: str, d: int, count: int, seed: int, positive=(0.2, 0.5), negative=(-0.5, -0.2), permute: bool = True) -> np.ndarray:
    """An acyclic weight matrix; weights have two digits, either sign, and are uniform in their range."""
    rng = np.random.default_rng(seed)
    graph = edges_of(kind, d, count, rng)
    if permute:
        order = rng.permutation(d)
        graph = graph[np.ix_(order, order)]
    where = np.nonzero(graph)
    n = len(where[0])
    sign = rng.choice([1, -1], size=n)
    up, down = rng.uniform(*positive, size=n), rng.uniform(*negative, size=n)
    out = np.zeros((d, d))
    out[where] = np.round(np.where(sign > 0, up, down), 2)
    return np.where(np.abs(out) <= 1e-3, 0.0, out)


def observations(m: int, w: np.ndarray, mean: float, std: float, seed: int) -> np.ndarray:
    """X = Z (I - W)^-1 with normal Z."""
    left = np.eye(len(w)) - w
    if np.linalg.det(left) == 0:
        raise ValueError("I - W is singular")
    return np.random.default_rng(seed).normal(mean, std, (m, len(w))) @ np.linalg.inv(left)


@dataclass
class Plan:
    """What each subject is drawn from: its group (from 1), its rows and its seed; and each group's graph."""

    label: list[int]
    rows: list[int]
    seed: list[int]
    centers: list[np.ndarray]


@dataclass
class Simulated:
    rows: list[np.ndarray]
    weights: list[np.ndarray]
    labels: list[int]


def plan_subjects(total: int, m: int | list[int], d: int, proportions, edges, seed: int, kind: str = "UR", permute: bool = True) -> Plan:
    """Sizes are rounded down and the rest handed out in turn; lengths go to subjects before they are shuffled."""
    lengths = [int(m)] * total if isinstance(m, (int, np.integer)) else [int(x) for x in m]
    if len(lengths) != total:
        raise ValueError(f"{len(lengths)} lengths for {total} subjects")
    if len(edges) != len(proportions):
        raise ValueError("an edge count for each group is needed")
    rng = np.random.default_rng(seed)
    sizes = [int(total * p) for p in proportions]
    for k in range(total - sum(sizes)):
        sizes[k % len(sizes)] += 1
    centers = [random_graph(kind, d, count, int(rng.integers(1e9)), permute=permute) for count in edges]
    drawn = [(k + 1, int(rng.integers(1e9))) for k, size in enumerate(sizes) for _ in range(size)]
    subjects = [(label, n, own) for (label, own), n in zip(drawn, lengths, strict=True)]
    rng.shuffle(subjects)
    return Plan([int(s[0]) for s in subjects], [int(s[1]) for s in subjects], [int(s[2]) for s in subjects], centers)


def clustered(total: int, m: int | list[int], d: int, proportions, edges, std: float, seed: int, mean: float = 0.0, kind: str = "UR") -> Simulated:
    """All in memory, for small settings and tests."""
    plan = plan_subjects(total, m, d, proportions, edges, seed, kind)
    weights = [plan.centers[k - 1] for k in plan.label]
    rows = [observations(n, w, mean, std, own) for n, w, own in zip(plan.rows, weights, plan.seed, strict=True)]
    return Simulated(rows, weights, plan.label)


def random_lengths(total: int, seed: int) -> list[int]:
    """Lengths from 50 to 300 in tens."""
    return np.random.RandomState(seed).choice(np.arange(50, 310, 10), total).tolist()


def simulate(spark: SparkSession, total: int, m: int | list[int], d: int, proportions, edges, std: float, seed: int, mean: float = 0.0, kind: str = "UR") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, subjects with labels, centers): each subject has its own seed, so tasks draw rows independently."""
    plan = plan_subjects(total, m, d, proportions, edges, seed, kind)
    subjects = spark.createDataFrame([(k, label, n, own) for k, (label, n, own) in enumerate(zip(plan.label, plan.rows, plan.seed, strict=True))], "subject_id long, label int, m int, seed long")
    centers = spark.createDataFrame([(k + 1, w.ravel().tolist()) for k, w in enumerate(plan.centers)], "label int, w array<double>")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                x = observations(row.m, plan.centers[row.label - 1], mean, std, row.seed)
                yield pd.DataFrame({"subject_id": row.subject_id, "obs_idx": np.arange(len(x), dtype=np.int32), "x": list(x)})

    return subjects.mapInPandas(draw, "subject_id long, obs_idx int, x array<double>"), subjects.select("subject_id", "label"), centers
