"""Connected components: few links in one task, more of them by alternating large-star and small-star steps in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .words import batch_of

#: Links (two numbers each) that one task labels: some 100 MB of arrays. More of them take rounds of shuffles.
ONE_TASK = 1_000_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that links name, and the smallest id that each reaches."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            return ids, ids[root]
        # Roots hang below the smallest root that a link joins them to, then all paths are cut short.
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (root != root[root]).any():
            root = root[root]


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ids, least = least_reachable(links.column("u").to_numpy(), links.column("v").to_numpy())
    yield batch_of(["id", "component"], [ids, least])


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) of all ids that (a, b) links name; component is the smallest id reachable.

    Each round is two shuffles of the links, of which at most one a node stays in the end. Rounds
    grow with the logarithm of the longest chain. A hub with very many links is summed up before
    the shuffle, and its join is one that Spark can split. Up to ONE_TASK links need no rounds. No
    links: no rows.
    """
    edges = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    if edges.count() <= ONE_TASK:
        return scratch.cut(edges.coalesce(1).mapInArrow(labelled, "id long, component long"), f"{name}-found")
    seen, k = None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).head()
        if not state[0] or state == seen:
            break
        seen = state
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        k += 1
        edges = scratch.cut(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
