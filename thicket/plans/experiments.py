"""Whole experiments: tune, refit, sweep thresholds, and compare with the truth.

Observations come in as additive statistics, by subject and by (subject, fold); the truth is
(subject_id, label, w). A method's result is (subject_id, label, w), so all methods are scored by
the same DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import matrices as M
from ..operators import clustering, errors, graph_metrics, moments, selection
from ..operators.blocks import pair_tiles, whole_tiles
from ..operators.order import quantile, quantile_at
from ..sources.written import written
from . import fit

PARAMS = ["lambda1", "lambda2", "tau", "rho1", "rho2"]
THRESHOLDS = [t / 100 for t in range(1, 11)]
METHODS = ("dag_dc_admm", "pooled", "individual", "oracle", "two_step")


def as_matrices(entries: DataFrame, d: int, *keys: str, digits: int | None = None) -> DataFrame:
    """(keys, w) from (keys, src, dst, weight), perhaps rounded."""
    value = F.col("weight") if digits is None else F.bround("weight", digits)
    return moments.array_form(entries.select(*keys, F.col("src").alias("a"), F.col("dst").alias("b"), value.alias("value")), d, *keys)


def with_moments(stats: DataFrame, d: int) -> DataFrame:
    return stats.select("subject_id", "m", moments.second_moment().alias("s"), moments.centred_covariance(d).alias("cov"))


def mean_error(stats: DataFrame, found: DataFrame, d: int, kind: str, name: str) -> DataFrame:
    """One row: the mean over subjects of the recon, mle or cov error of their matrices (subject_id, w).

    Subjects whose error isn't defined are left out; an error if it isn't defined for any.
    """
    rows = with_moments(stats, d).join(found.select("subject_id", "w"), "subject_id")
    value = {
        "recon": errors.reconstruction(F.col("w"), F.col("s"), d),
        "mle": errors.penalized_likelihood(F.col("w"), F.col("cov"), F.col("m"), d),
        "cov": errors.covariance_error(F.col("w"), F.col("cov"), d),
    }[kind]
    mean = rows.agg(F.avg(F.nanvl(value, F.lit(None).cast("double"))).alias("mean"))
    return mean.select(F.when(F.col("mean").isNull(), F.raise_error(F.lit(f"no subject has a {kind} error")).cast("double")).otherwise(F.col("mean")).alias(name))


def sweep(found: DataFrame, truth: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(threshold, ten metrics): how well graphs are recovered, averaged over subjects."""
    both = found.select("subject_id", F.col("w").alias("w_est")).join(truth.select("subject_id", F.col("w").alias("w_true")), "subject_id")
    return graph_metrics.macro_average(graph_metrics.graph_metrics(both, thresholds, "subject_id"), "threshold")


def evaluation(found: DataFrame, truth: DataFrame, stats: DataFrame, d: int, threshold: float = 0.01) -> DataFrame:
    """One row: graph recovery at a threshold, reconstruction errors of the true and the found matrices, agreement of the labels."""
    graphs = sweep(found, truth, [threshold])
    graphs = graphs.select(*(F.col(m).cast("double").alias(f"graph_{m}") for m in graph_metrics.METRICS))
    labels = truth.select("subject_id", F.col("label").alias("y_true")).join(found.select("subject_id", F.col("label").alias("y_pred")), "subject_id")
    one_row = [mean_error(stats, truth, d, "recon", "recon_error_true"), mean_error(stats, found, d, "recon", "recon_error_est"), clustering.agreement(labels)]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one_row, graphs)


def refit(spark: SparkSession, stats: DataFrame, d: int, table: DataFrame, criterion: str, how: K.Settings) -> tuple[DataFrame, dict]:
    """((subject_id, label, w), parameters): the fit with the combination that a criterion of the table likes best."""
    best = selection.best(table, PARAMS, f"{criterion}_mean").head()
    params = {p: float(best[p]) for p in PARAMS}
    chosen = replace(how, l1=params["lambda1"], l2=params["lambda2"], tau=params["tau"], rho1=params["rho1"], rho2=params["rho2"])
    return as_matrices(fit.fit_groups(spark, stats, d, chosen), d, "subject_id", "label"), params


def cv_means(fold_errors: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """(parameters, <criterion>_mean ...), best reconstruction first."""
    tables = [selection.cv_table(fold_errors, PARAMS, f"{c}_error", f"{c}_mean") for c in criteria]
    return reduce(lambda a, b: a.join(b, PARAMS), tables).orderBy(f"{criteria[0]}_mean", *PARAMS)


def baseline(spark: SparkSession, stats: DataFrame, by_fold: DataFrame, truth: DataFrame, d: int, mode: str, alphas: list[float], digits: int = 3) -> tuple[DataFrame, DataFrame]:
    """((subject_id, label, w), tuning table) of a baseline: one graph for all (pooled), for each subject (individual) or for each true group (oracle).

    Penalties are tuned by held-out error: one for all subjects, or one for each true group.
    """
    labels = truth.select("subject_id", "label")
    key = {"pooled": None, "individual": "subject_id", "oracle": "label"}[mode]
    folded = by_fold.join(labels, "subject_id") if mode == "oracle" else by_fold
    tuned = fit.tune_notears(spark, folded, d, alphas, key).persist()
    best = fit.best_alpha(tuned, shared=mode != "oracle")
    if mode == "oracle":
        keyed = moments.merged(stats.join(labels, "subject_id"), d, "label").join(best.withColumnRenamed("of", "label"), "label")
        found = labels.join(as_matrices(fit.notears_each(keyed, d, "label"), d, "label", digits=digits), "label")
    else:
        beta = float(best.head()["alpha"])
        solve = fit.notears_pooled if mode == "pooled" else fit.notears_individual
        own = as_matrices(solve(stats, d, beta), d, "subject_id", digits=digits)
        # A pooled graph makes one group, graphs of their own one group each.
        found = own.withColumn("label", F.lit(1) if mode == "pooled" else F.col("subject_id") + 1)
    return found.select("subject_id", "label", "w"), tuned


@dataclass
class Outcome:
    """scores: (method, criterion, parameters as JSON, evaluation); sweeps: (method, criterion, threshold, metrics); cv: the table of the grid; groups: (method, criterion, subject_id, label, w)."""

    scores: DataFrame
    sweeps: DataFrame
    groups: DataFrame
    cv: DataFrame | None = None
    tuned: dict[str, DataFrame] = field(default_factory=dict)


def run(spark: SparkSession, stats: DataFrame, by_fold: DataFrame, truth: DataFrame, d: int, grid: DataFrame, alphas: list[float], methods: tuple[str, ...] = METHODS, criteria: tuple[str, ...] = ("recon",), how: K.Settings = K.Settings(max_dc=10, max_admm=15), two_step_tau: float = 0.7) -> Outcome:
    """The chosen methods on one data set. Of the grouped fit, one refit for each criterion."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods {sorted(unknown)}; there are {', '.join(METHODS)}")
    found: list[tuple[str, str, dict, DataFrame]] = []
    cv, tuned = None, {}
    if "dag_dc_admm" in methods:
        cv = cv_means(fit.cross_validate(spark, by_fold, d, grid, how, criteria), criteria).persist()
        for criterion in criteria:
            groups, params = refit(spark, stats, d, cv, criterion, how)
            found.append(("dag_dc_admm", criterion, params, groups.persist()))
    for mode in ("pooled", "individual", "oracle"):
        if mode in methods or (mode == "individual" and "two_step" in methods):
            groups, tuned[mode] = baseline(spark, stats, by_fold, truth, d, mode, alphas)
            groups = groups.persist()
            if mode in methods:
                found.append((mode, "recon", {}, groups))
            if mode == "individual" and "two_step" in methods:
                found.append(("two_step", "recon", {"tau": two_step_tau}, fit.grouped_by_linkage(groups, two_step_tau, d).persist()))

    def named(frame: DataFrame, method: str, criterion: str) -> DataFrame:
        return frame.select(F.lit(method).alias("method"), F.lit(criterion).alias("criterion"), "*")

    union = lambda frames: reduce(DataFrame.unionByName, frames)
    scores = union(named(evaluation(g, truth, stats, d).withColumn("params", F.to_json(F.create_map(*(F.lit(x) for kv in p.items() for x in kv))) if p else F.lit("{}")), m, c) for m, c, p, g in found)
    sweeps = union(named(sweep(g, truth), m, c) for m, c, _, g in found)
    return Outcome(scores, sweeps, union(named(g, m, c) for m, c, _, g in found), cv, tuned)


def top(cv: DataFrame, criteria: tuple[str, ...], n: int = 5) -> DataFrame:
    """(criterion, place, parameters, error): the best combinations by each criterion."""
    return reduce(DataFrame.unionByName, (selection.ranked(cv, PARAMS, f"{c}_mean", n).select(F.lit(c).alias("criterion"), "place", *PARAMS, F.col(f"{c}_mean").alias("error")) for c in criteria))


def fusion_diagnostics(pair_norms: DataFrame, tau: float, gamma: float) -> DataFrame:
    """One row from (previous, difference) norms of pairs: share of fused pairs, share of those that are thresholded to 0, and both medians.

    No pair is fused where all previous norms are 0.
    """
    rows = written(pair_norms, "pair-norms")
    of = lambda c: F.lit(quantile(rows, F.col(c), 0.5) or 0.0)
    near = F.col("previous") < tau
    fused = rows.agg(F.max("previous").alias("largest"), F.count("*").alias("n"), F.count(F.when(near, 1)).alias("near"), F.count(F.when(near & (F.col("difference") <= gamma), 1)).alias("zero"))
    held = F.when(F.col("largest") >= 1e-12, F.col("near")).otherwise(0)
    share = lambda part, whole: F.when(whole > 0, part / whole)
    return fused.select(share(held, F.col("n")).alias("frac_fused"), F.coalesce(share(F.when(held > 0, F.col("zero")).otherwise(0), held), F.lit(0.0)).alias("frac_zero"), of("previous").alias("median_previous"), of("difference").alias("median_difference"))


#: Bins that a norm's pairs are counted in before the median's own bin is looked at.
BINS = 1 << 15


def pair_diagnostics(frame: DataFrame, key: str, columns: list[str], norms: Callable, widest: list[float], tau: float, gamma: float, whole: bool = False) -> DataFrame:
    """fusion_diagnostics of all pairs of frame without a row a pair: norms(first, second) gives both norms of a tile's pairs.

    whole: of each row of one side to each of the other, from the sides themselves.

    Counts in bins up to the widest distances tell the medians' places; only pairs in the medians' bins are written. Runs jobs.
    """
    scale = [BINS / w if 0 < w < float("inf") else 0.0 for w in widest]
    bins = lambda v, q: np.minimum(np.nan_to_num(v * scale[q], nan=BINS), BINS - 1).astype(np.int64)

    def values(tiles):
        if not whole:
            yield from (norms(first, second) for _, _, first, second in tiles)
            return
        for wanted, first, second in tiles:
            yield [v[wanted] for v in norms(first, second)]

    pairs_of = partial(whole_tiles, at_once=1 << 17) if whole else pair_tiles

    def counted(tiles):
        counts, largest, near, zero = np.zeros((2, BINS), np.int64), 0.0, 0, 0
        for both in values(tiles):
            for q, v in enumerate(both):
                counts[q] += np.bincount(bins(v, q), minlength=BINS)
            held = both[0] < tau
            largest, near, zero = max(largest, both[0].max(initial=0.0)), near + int(held.sum()), zero + int((held & (both[1] <= gamma)).sum())
        q, at = np.nonzero(counts)
        yield pd.DataFrame({"q": np.append(q, [2, 3, 4]), "bin": np.append(at, [0, 0, 0]), "n": np.append(counts[q, at], [near, zero, 0]), "largest": largest})

    # A row a bin comes back, however many pairs there are.
    found = pairs_of(frame, key, columns, counted, "q long, bin long, n long, largest double").groupBy("q", "bin").agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).toPandas()
    counts = np.zeros((5, BINS), np.int64)
    counts[found["q"].to_numpy(int), found["bin"].to_numpy(int)] = found["n"]
    n, near, zero, largest = int(counts[0].sum()), int(counts[2, 0]), int(counts[3, 0]), float(found["largest"].max()) if len(found) else 0.0
    near, zero = (near, zero) if largest >= 1e-12 else (0, 0)
    places = (n - 1) // 2, n // 2
    ends = [[int(np.searchsorted(np.cumsum(counts[q]), place, "right")) for place in places] for q in (0, 1)] if n else [[0, -1]] * 2

    def chosen(tiles):
        for both in values(tiles):
            for q, v in enumerate(both):
                at = bins(v, q)
                v = v[(at >= ends[q][0]) & (at <= ends[q][1])]
                yield pd.DataFrame({"q": np.full(len(v), q), "v": v})

    medians = [0.0, 0.0]
    if n:
        rows = written(pairs_of(frame, key, columns, chosen, "q long, v double"), "median-bins")
        for q in (0, 1):
            medians[q] = quantile_at(rows.where(F.col("q") == q).select("v"), [place - int(counts[q, : ends[q][0]].sum()) for place in places])
    row = (near / n if n else None, zero / near if near else 0.0, *map(float, medians))
    return frame.sparkSession.createDataFrame([row], "frac_fused double, frac_zero double, median_previous double, median_difference double")


def artifacts(found: DataFrame, d: int, params: dict, digits: int | None = 3, version: str = "thicket-1") -> DataFrame:
    """One row to store a fit: matrices and labels by subject, groups with members and graph, sizes, parameters.

    It has n d^2 numbers, as the fit itself had in one task.
    """
    w = M.rounded(F.col("w"), digits) if digits is not None else F.col("w")
    rows = found.select("subject_id", "label", w.alias("w"))
    groups = rows.groupBy("label").agg(F.sort_array(F.collect_list("subject_id")).alias("members"), F.first("w").alias("w"))
    groups = groups.agg(F.sort_array(F.collect_list(F.struct("label", "members", "w"))).alias("groups"), F.count("*").alias("k"))
    subjects = rows.agg(F.sort_array(F.collect_list(F.struct("subject_id", "label", "w"))).alias("subjects"), F.count("*").alias("n"))
    meta = F.struct(F.col("n"), F.lit(d).alias("d"), F.col("k"), F.lit(digits).alias("round_decimals"), F.lit(version).alias("version"))
    given = F.create_map(*(F.lit(x) for kv in params.items() for x in (kv[0], float(kv[1])))) if params else F.create_map().cast("map<string,double>")
    return groups.crossJoin(F.broadcast(subjects)).select("groups", "subjects", meta.alias("meta"), given.alias("params"))
