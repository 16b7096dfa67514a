"""A uniform shuffle into shards of exact size, planned by a hypergeometric communication matrix.

Rows fall into buckets by a hash. How many rows of each bucket go to each shard is drawn from the
law that a uniform shuffle of all rows would give: row sums are the bucket sizes, column sums the
shard sizes, so every shard gets its exact share whatever the draw. Then each bucket permutes its
rows and deals them out by those counts, rows change place, and each shard permutes what it got.

The first permutation and the counts are worked out on a table of two hashes a row. It ends in a
few cuts for each bucket (the hashes at which one shard's share ends and the next one's begins),
which every task gets, so that a row knows its shard where it is read and changes place once.

Only DataFrame operations touch rows. The driver draws the matrix, whose size is the number of
buckets times the number of shards: a bucket for each quarter of a million rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded

#: Rows of a bucket of the first permutation, and bytes of a part of a shard in the second one.
BUCKET_ROWS, PART_BYTES = 250_000, 32 << 20
LEAST_BUCKETS = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` without replacement are good, by inversion around the mode; any size."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    spread = math.sqrt(drawn * (good / total) * (bad / total) * (total - drawn) / max(1, total - 1))
    mode = min(max(int((drawn + 1) * (good + 1) / (total + 2)), low), high)
    first, last = max(low, int(mode - 12 * spread - 12)), min(high, int(mode + 12 * spread + 12))
    x = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - x) + np.log(drawn - x) - np.log(x + 1) - np.log(bad - drawn + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def communication_matrix(bucket_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows from each bucket (outer) to each shard (inner); sums are exactly those given."""
    rng, left, out = np.random.default_rng(seed), list(shard_rows), []
    for rows in bucket_rows:
        dealt, rest = [], sum(left)
        for k, room in enumerate(left):
            rest -= room
            dealt.append(hypergeometric(rng, room, rest, rows))
            rows -= dealt[-1]
            left[k] = room - dealt[-1]
        out.append(dealt)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    """At most one apart."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffled_shards(spark: SparkSession, docs: DataFrame, shards: int = 8, seed: int = 20, buckets: int | None = None) -> DataFrame:
    """docs with shard int (0 to shards - 1) and slot long (gapless from 0 in each shard).

    Shard sizes differ by one row at most. All rows stay, whatever columns are null; rows that are
    equal in every column are interchangeable, as are those that differ only in columns of (or
    with) maps. Columns of docs named shard or slot are replaced. The draw depends on seed and on
    the rows alone, not on how they are stored. An empty table gives no rows. Rows with one hash
    at a cut (equal ones) are dealt out in a window of their own.
    """
    if shards < 1 or (buckets is not None and buckets < 1):
        raise ValueError("shards and buckets must be positive")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    known = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if c in names and "map<" not in kind] or [F.lit(0)]
    text = F.octet_length("row.text") if dict(docs.dtypes).get("text") == "string" else F.lit(0)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    packed = packed.select("row", *(F.xxhash64(F.lit(seed), F.lit(salt), *known).alias(f"h{salt}") for salt in (1, 2)))

    scratch = Scratch(spark, "sharding")
    light = scratch.cut(packed.select("h1", "h2", (F.coalesce(text, F.lit(0)) + 64).cast("long").alias("bytes")), "hashes")
    total = light.agg(F.count("*").alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).head()
    buckets = buckets or max(LEAST_BUCKETS, -(-total["rows"] // BUCKET_ROWS))
    parts = max(1, -(-total["bytes"] // (shards * PART_BYTES)))
    bucket = F.pmod("h1", F.lit(buckets)).cast("int").alias("bucket")

    sizes = {r["bucket"]: r["count"] for r in light.groupBy(bucket).count().collect()}  # one row a bucket
    matrix = communication_matrix([sizes.get(k, 0) for k in range(buckets)], shard_sizes(total["rows"], shards), seed)
    ends = [[int(x) for x in np.cumsum(dealt)][:-1] for dealt in matrix]
    wanted = spark.createDataFrame([(k, end) for k in range(buckets) for end in sorted({e for e in ends[k] if e})], "bucket int, rank long").coalesce(1)
    permuted = light.select(bucket, "h2", F.row_number().over(Window.partitionBy(bucket).orderBy("h2")).cast("long").alias("rank"))
    # shards - 1 cuts a bucket at most: the hash of the last row that goes to a shard or one before it.
    cuts = {(r["bucket"], r["rank"]): r["h2"] for r in permuted.join(F.broadcast(wanted), ["bucket", "rank"]).collect()}
    plan = spark.createDataFrame([(k, [cuts.get((k, end)) for end in ends[k]], ends[k]) for k in range(buckets)], "bucket int, cuts array<long>, ends array<long>").coalesce(1)

    def dealt_out(rows: DataFrame) -> DataFrame:
        """Rows with their shard and part. A cut of null is before the first row."""
        sent = rows.join(F.broadcast(plan), F.pmod("h1", F.lit(buckets)).cast("int") == F.col("bucket"))
        sent = sent.withColumn("shard", F.size(F.filter("cuts", lambda cut: F.coalesce(cut < F.col("h2"), F.lit(True)))))
        if tied:
            alike = Window.partitionBy("bucket", "h2").orderBy("h1")
            at = sent.join(F.broadcast(ties), ["bucket", "h2"], "left")
            mine = at.where("first is not null").withColumn("rank", F.col("first") + F.row_number().over(alike) - 1)
            mine = mine.withColumn("shard", F.size(F.filter("ends", lambda end: end < F.col("rank"))))
            sent = at.where("first is null").drop("first").unionByName(mine.drop("first", "rank"))
        return sent.withColumn("part", F.pmod(F.xxhash64("h1", "h2", F.lit(3)), F.lit(parts)).cast("int")).drop("bucket", "cuts", "ends")

    at_cuts = spark.createDataFrame([(k, h) for (k, _), h in cuts.items()], "bucket int, h2 long").distinct().coalesce(1)
    # Hashes at cuts that several rows have; at most one a cut.
    ties = permuted.join(F.broadcast(at_cuts), ["bucket", "h2"]).groupBy("bucket", "h2").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = ties.collect()
    ties = spark.createDataFrame([tuple(r) for r in tied], "bucket int, h2 long, first long").coalesce(1)

    before = dealt_out(light).groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = scratch.cut(before.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before")), "before")
    order = Window.partitionBy("shard", "part").orderBy(F.xxhash64("h1", "h2", F.lit(4)), "h1", "h2")
    placed = dealt_out(packed).withColumn("rank", F.row_number().over(order)).join(bounded(before), ["shard", "part"])
    return placed.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("rank") - 1).alias("slot"))
