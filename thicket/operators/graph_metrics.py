"""How well estimated graphs recover true ones, over matrix entries in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("skeleton_tpr", "skeleton_fdr", "skeleton_tnr", "skeleton_shd", "dag_fdr", "dag_tpr", "dag_fpr", "dag_tnr", "dag_shd", "dag_nnz")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def graph_metrics(pairs: DataFrame, thresholds: list[float], *keys: str) -> DataFrame:
    """Ten metrics a row for each key and threshold. pairs: keys, w_true, w_est (row-major arrays of one size).

    An edge is there if its absolute weight, rounded to 3 digits, exceeds the threshold. A share
    of nothing is 0, but dag_fdr is 1 where no edge is predicted. One pass for all thresholds.
    """
    d = F.sqrt(F.size("w_true")).cast("int")
    on = lambda w, k, t: (F.abs(F.bround(F.get(w, k), 3)) > t).cast("int")
    cells = pairs.select(*keys, "w_true", "w_est", d.alias("d"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    cells = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("d") * F.col("d") - 1)))
    i, j = F.floor(F.col("k") / F.col("d")).cast("int"), (F.col("k") % F.col("d")).cast("int")
    back, t = j * F.col("d") + i, F.col("threshold")
    cells = cells.where(i != j).select(
        *keys, "threshold", (i < j).alias("upper"), on("w_true", F.col("k"), t).alias("t"), on("w_est", F.col("k"), t).alias("e"),
        F.greatest(on("w_true", F.col("k"), t), on("w_true", back, t)).alias("st"), F.greatest(on("w_est", F.col("k"), t), on("w_est", back, t)).alias("se"),
    )
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = F.col
    sums = {}
    for name, true, est, scope in (("s", "st", "se", c("upper")), ("g", "t", "e", F.lit(True))):
        for kind, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)):
            sums[f"{name}_{kind}"] = count(scope & (c(true) == a) & (c(est) == b))
    n = cells.groupBy(*keys, "threshold").agg(*(v.alias(k) for k, v in sums.items()))
    return n.select(
        *keys, "threshold",
        _share(c("s_tp"), c("s_tp") + c("s_fn")).alias("skeleton_tpr"), _share(c("s_fp"), c("s_tp") + c("s_fp")).alias("skeleton_fdr"),
        _share(c("s_tn"), c("s_tn") + c("s_fp")).alias("skeleton_tnr"), (c("s_fp") + c("s_fn")).alias("skeleton_shd"),
        (1 - _share(c("g_tp"), c("g_tp") + c("g_fp"))).alias("dag_fdr"), _share(c("g_tp"), c("g_tp") + c("g_fn")).alias("dag_tpr"),
        _share(c("g_fp"), c("g_fp") + c("g_tn")).alias("dag_fpr"), _share(c("g_tn"), c("g_tn") + c("g_fp")).alias("dag_tnr"),
        (c("g_fp") + c("g_fn")).alias("dag_shd"), (c("g_tp") + c("g_fp")).alias("dag_nnz"),
    )


def macro_average(metrics: DataFrame, *keys: str) -> DataFrame:
    """The mean of each metric over subjects."""
    return metrics.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in METRICS))
