"""Sufficient statistics: one partial and final aggregation over the observations, and what follows from it.

Observations are (subject_id, obs_idx, x ARRAY<DOUBLE>). Statistics are additive: m, sum (of x) and
xtx (of outer products), so folds, pools and clusters are sums of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matrices as M
from ..sources.written import written


def additive(observations: DataFrame, d: int, *keys: str) -> DataFrame:
    """(keys, m, sum, xtx): a row a group, by map-side combined sums; only the upper triangle is summed."""
    x = [F.get("x", F.lit(a)) for a in range(d)]
    upper = {(a, b): F.sum(x[a] * x[b]) for a in range(d) for b in range(a, d)}
    cells = [upper[min(a, b), max(a, b)] for a in range(d) for b in range(d)]
    return observations.groupBy(*keys).agg(F.count("*").alias("m"), F.array(*map(F.sum, x)).alias("sum"), F.array(*cells).alias("xtx"))


def merged(stats: DataFrame, d: int, *keys: str) -> DataFrame:
    """The statistics of coarser groups: pools, clusters, training folds."""
    sums = F.array(*(F.sum(F.get("sum", F.lit(k))) for k in range(d)))
    xtx = F.array(*(F.sum(F.get("xtx", F.lit(k))) for k in range(d * d)))
    return stats.groupBy(*keys).agg(F.sum("m").alias("m"), sums.alias("sum"), xtx.alias("xtx"))


def without_fold(by_fold: DataFrame, d: int, *keys: str) -> DataFrame:
    """For each group and fold, the statistics of all other folds: the group's total less the fold's own."""
    whole = merged(by_fold, d, *keys).select(*keys, F.col("m").alias("all_m"), F.col("sum").alias("all_sum"), F.col("xtx").alias("all_xtx"))
    joined = by_fold.join(whole, list(keys))
    return joined.select(*keys, "fold", (F.col("all_m") - F.col("m")).alias("m"), M.minus(F.col("all_sum"), F.col("sum")).alias("sum"), M.minus(F.col("all_xtx"), F.col("xtx")).alias("xtx"))


def second_moment() -> Column:
    """X'X / m, uncentred."""
    return F.expr("transform(xtx, v -> v / m)")


def centred_covariance(d: int) -> Column:
    """The sample covariance (divided by m - 1); null for fewer than two rows."""
    cell = M.build(d, lambda a, b: (F.get("xtx", (a * d + b).cast("int")) - F.get("sum", a) * F.get("sum", b) / F.col("m")) / (F.col("m") - 1))
    return F.when(F.col("m") >= 2, cell)


def long_form(frame: DataFrame, column: str, d: int, *keys: str, name: str = "value") -> DataFrame:
    """(keys, a, b, name): a row a matrix entry."""
    return frame.select(*keys, F.posexplode(column).alias("k", name)).select(*keys, F.floor(F.col("k") / d).cast("int").alias("a"), (F.col("k") % d).cast("int").alias("b"), name)


def array_form(frame: DataFrame, d: int, *keys: str, name: str = "value") -> DataFrame:
    """A row a matrix, from entries (a, b, name); absent entries are 0."""
    cells = [F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col(name)).otherwise(0.0)) for a in range(d) for b in range(d)]
    return frame.groupBy(*keys).agg(F.array(*cells).alias("w"))


def with_group_values(frame: DataFrame, keys: tuple[str, ...], **values: Column) -> DataFrame:
    """frame with one value a group beside each row: partial sums and a join, so that a group may have any number of rows."""
    of = frame.groupBy(*keys).agg(*(v.alias(name) for name, v in values.items()))
    if not keys:
        return frame.crossJoin(F.broadcast(of))  # one row
    renamed = of.toDF(*(f"{k} of group" for k in keys), *values)
    same = [frame[k].eqNullSafe(renamed[f"{k} of group"]) for k in keys]
    return frame.join(renamed, same).drop(*(f"{k} of group" for k in keys))


def zscore(frame: DataFrame, columns: list[str], *keys: str, ddof: int = 1) -> DataFrame:
    """Columns less their group mean, over their group deviation (n - ddof); deviation 0 counts as 1, null and NaN become 0."""
    spread = F.stddev_samp if ddof else F.stddev_pop
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    beside = {f"{c} {what}": make(v) for c, v in known.items() for what, make in (("mean", F.avg), ("spread", spread))}
    out = {}
    for c, value in known.items():
        mean, scale = F.col(f"{c} mean"), F.col(f"{c} spread")
        out[c] = F.coalesce((value - mean) / F.when(scale == 0, 1.0).otherwise(F.coalesce(scale, F.lit(1.0))), F.lit(0.0))
    return with_group_values(frame, keys, **beside).withColumns(out).drop(*beside)


def mean_imputed(frame: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Nulls and NaN become the column's group mean."""
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    beside = {f"{c} mean": F.avg(v) for c, v in known.items()}
    return with_group_values(frame, keys, **beside).withColumns({c: F.coalesce(v, F.col(f"{c} mean")) for c, v in known.items()}).drop(*beside)


def numeric_columns(frame: DataFrame, *but: str) -> list[str]:
    """Names of the columns with numbers, in order."""
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in but]


def ranked(frame: DataFrame, subject: str, order: list[str], name: str = "obs_idx") -> DataFrame:
    """frame with each row's place within its subject, from 0, in the given order (nulls first; equal rows in any, but one, order).

    Rows are dealt to ranges of (subject, order) and written there with their place in the range, so
    that a subject may have any number of rows; counts of subjects in ranges, at most one range's
    more than there are subjects and ranges, tell where a range begins.
    """
    at, part, first, before = (f"{what} of row" for what in ("place", "range", "first", "before"))
    dealt = frame.repartitionByRange(subject, *order).sortWithinPartitions(subject, *order).withColumn(at, F.monotonically_increasing_id())
    # An id is its range's number above 33 bits for the place.
    placed = written(dealt, "ranks").withColumn(part, F.shiftright(at, 33))
    counts = placed.groupBy(F.col(subject).alias("subject of range"), F.col(part).alias("range")).agg(F.min(at).alias(first), F.count("*").alias("n"))
    earlier = Window.partitionBy("subject of range").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    joined = placed.join(starts, placed[subject].eqNullSafe(starts["subject of range"]) & (placed[part] == starts["range"]))
    return joined.select(*frame.columns, (F.col(at) - F.col(first) + F.col(before)).cast("int").alias(name))


def observations(frame: DataFrame, subject: str, columns: list[str], order: list[str] | None) -> DataFrame:
    """(subject_id, obs_idx, x): obs_idx counts from 0 in the given order; without an order there is no obs_idx."""
    names = [f"order {k}" for k in range(len(order or []))]
    rows = frame.select(F.col(subject).alias("subject_id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), *(F.col(c).alias(n) for c, n in zip(order or [], names, strict=True)))
    return rows if order is None else ranked(rows, "subject_id", names).select("subject_id", "obs_idx", "x")
