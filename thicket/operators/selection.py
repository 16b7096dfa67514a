"""Tables of cross-validation results and small choices from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.written import written
from .order import quantile


def param_grid(spark: SparkSession, values: dict[str, list[float]]) -> DataFrame:
    """The product of named value lists, a row a combination; columns are named, so their order carries no meaning."""
    frames = (spark.range(1).select(F.explode(F.array(*(F.lit(float(v)) for v in given))).alias(name)) for name, given in values.items())
    return reduce(lambda a, b: a.crossJoin(b), frames)


def cv_table(errors: DataFrame, params: list[str], error: str, name: str) -> DataFrame:
    """The mean error of each combination over folds; NaN counts as absent, and a combination without errors has null."""
    return errors.groupBy(*params).agg(F.avg(F.nanvl(F.col(error), F.lit(None).cast("double"))).alias(name))


def best(table: DataFrame, params: list[str], name: str, n: int = 1) -> DataFrame:
    """The n combinations of least error; on ties the first in parameter order."""
    return table.orderBy(F.col(name).asc_nulls_last(), *params).limit(n)


def ranked(table: DataFrame, params: list[str], name: str, n: int) -> DataFrame:
    """The n combinations of least error with their place, from 1."""
    order = Window.orderBy(F.col(name).asc_nulls_last(), *params)  # n rows
    return best(table, params, name, n).withColumn("place", F.row_number().over(order))


def large_groups(frame: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least so many rows; the sizes are small and come by a semi join."""
    sizes = frame.groupBy(*keys).count().where(F.col("count") >= least)
    return frame.join(sizes, keys, "left_semi")


def weighted_mean(frame: DataFrame, value: str, weight: str, name: str) -> DataFrame:
    return frame.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(name))


def smallest_feasible(frame: DataFrame, keys: list[str], k: str, score: str, tolerance: float) -> DataFrame:
    """For each key, the smallest k whose score is at least (1 - tolerance) of the best one's."""
    top = F.max(score).over(Window.partitionBy(*keys))
    return frame.withColumn("top", top).where(F.col(score) >= (1 - tolerance) * F.col("top")).groupBy(*keys).agg(F.min(k).alias(k))


def largest_jump(heights: DataFrame, height: str = "height") -> DataFrame:
    """One row (cut): the middle of the largest step between sorted heights; first and last steps only if there is no other.

    heights: the merges of one dendrogram; nulls don't count, and fewer than two give no row. Equal
    heights are a step of 0. Distinct values are dealt out by ranges; a range takes the value before
    it from the list of ranges. Of equal steps the lowest is taken.
    """
    spark = heights.sparkSession
    values = written(heights.where(F.col(height).isNotNull()).groupBy(F.col(height).alias("h")).agg(F.count("*").alias("c")), "heights")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = sorted(set(values.approxQuantile("h", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("h"))) if starts else F.lit(0)
    dealt = values.withColumn("part", part)
    # A row a range, and one of them all.
    each = dealt.groupBy("part").agg(F.max("h").alias("last"), F.sum("c").alias("rows"), F.min_by("c", "h").alias("c_low"), F.min("h").alias("low"), F.max_by("c", "h").alias("c_high"))
    whole = each.agg(F.collect_list(F.struct("part", "last")).alias("ranges"), F.sum("rows").alias("n"), F.min("low").alias("low"), F.min_by("c_low", "low").alias("c_low"), F.max("last").alias("high"), F.max_by("c_high", "last").alias("c_high"))
    before_range = F.array_max(F.transform(F.filter("ranges", lambda r: r["part"] < F.col("part")), lambda r: r["last"]))
    rows = dealt.withColumn("before", F.lag("h").over(Window.partitionBy("part").orderBy("h"))).crossJoin(F.broadcast(whole)).withColumn("before", F.coalesce("before", before_range))

    h, c, n, before = F.col("h"), F.col("c"), F.col("n"), F.col("before")
    # The second place of all is the first step, the last place the last one.
    at_edge = ((before == F.col("low")) & (F.col("c_low") == 1)) | ((h == F.col("high")) & (F.col("c_high") == 1))
    up = rows.where("before is not null").select(((h + before) / 2).alias("cut"), (h - before).alias("step"), (at_edge & (n > 3)).alias("edge"))
    flat_edge = F.when((h == F.col("low")) & (h == F.col("high")), F.lit(False)).otherwise(((h == F.col("low")) | (h == F.col("high"))) & (c < 3))
    flat = rows.where("c > 1").select(h.alias("cut"), F.lit(0.0).alias("step"), (flat_edge & (n > 3)).alias("edge"))
    return up.unionByName(flat).orderBy("edge", F.desc("step"), "cut").limit(1).select("cut")


def silhouette(points: DataFrame) -> DataFrame:
    """(id, silhouette) with exact Euclidean distances. points: id, x array<double>, label.

    A cluster of one gets 0, and so does a point without label, which is no neighbour of others
    either. Blocks of points meet and leave a sum for each point and label.
    """
    from .blocks import label_distances

    mean = label_distances(points, "id", "x", "label").withColumn("mean", F.col("total") / F.col("n"))
    per = mean.groupBy("id").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("mean"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("mean"))).alias("b"))
    wide = F.greatest("a", "b")
    # Equal points have no distance to divide by.
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (wide == 0), 0.0).otherwise((F.col("b") - F.col("a")) / wide)
    return points.select("id").join(per, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def consensus(weights: DataFrame, d: int, least: float | None = 0.01, digits: int | None = 2, zero_diagonal: bool = False) -> DataFrame:
    """(label, w): the mean of members' matrices (label, w), then small entries to 0, then rounded; either step may be left out."""
    from ..functions import matrices as M

    means = weights.groupBy("label").agg(F.array(*(F.avg(F.get("w", F.lit(k))) for k in range(d * d))).alias("w"))
    w = F.col("w")
    w = M.threshold(w, least) if least is not None else w
    w = M.rounded(w, digits) if digits is not None else w
    return means.select("label", (M.zero_diagonal(w, d) if zero_diagonal else w).alias("w"))


def close_pairs(pairs: DataFrame, most: float) -> DataFrame:
    """Edges of the cluster plot: pairs (i, j, label_i, label_j, dist) of one label that are no farther apart."""
    return pairs.where((F.col("label_i") == F.col("label_j")) & (F.col("dist") <= most)).select("i", "j", "dist")


def heat_cells(weights: DataFrame, least: float, floor: float = 0.05) -> DataFrame:
    """Cells of the adjacency plot (keys, a, b, value) with absolute value above `least`, and the colour limit of all of them."""
    shown = written(weights.where(F.abs("value") > least), "cells")
    # No quantile is above the largest value, so the limit needs no look at that.
    limit = quantile(shown, F.abs("value"), 0.95)
    return shown.withColumn("limit", F.lit(floor if limit is None else max(limit, floor)))
