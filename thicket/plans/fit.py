"""Fits as Spark jobs: one task a fit, tasks over groups, grids, folds and seeds.

Statistics are additive rows (subject_id, m, sum, xtx); a fit sees n d^2 numbers, never the
observations. A grouped fit holds all pairs of its subjects, so their number is bounded and checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import moments
from ..operators.linkage import complete
from ..sources.written import written
from . import large_fit

#: Numbers that one task may hold: a grouped fit's pairs take n^2 d^2 / 2 in each of a few arrays, linkage n^2.
MOST_NUMBERS = 64_000_000
EDGES = "src int, dst int, weight double"


def matrices(frame: pd.DataFrame, d: int) -> np.ndarray:
    """Second moments of rows with m and xtx."""
    return np.stack([np.asarray(x, float).reshape(d, d) / m for x, m in zip(frame["xtx"], frame["m"], strict=True)])


def edge_rows(w: np.ndarray, **keys) -> pd.DataFrame:
    d = len(w)
    return pd.DataFrame({**keys, "src": np.repeat(np.arange(d), d), "dst": np.tile(np.arange(d), d), "weight": w.ravel()})


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """frame dealt out by keys to a few tasks a core. Rows are few and small but dear, so their number of tasks must not follow their bytes."""
    return frame.repartition(4 * frame.sparkSession.sparkContext.defaultParallelism, *keys)


def most_subjects(d: int) -> int:
    return int((2 * MOST_NUMBERS) ** 0.5 / d)


def bounded_subjects(subjects: DataFrame, d: int) -> int:
    """How many there are; an error if one task can't hold their pairs."""
    most = most_subjects(d)
    n = subjects.limit(most + 1).count()
    if n > most:
        raise ValueError(f"one task takes {most} subjects of {d} variables at most; fit parts of them, or raise MOST_NUMBERS with the memory of a task")
    return n


def in_one_task(stats: DataFrame, d: int) -> DataFrame:
    return stats.select("subject_id", "m", "xtx").groupBy(F.lit(0).alias("all"))


def is_large(subjects: DataFrame, d: int) -> bool:
    """Whether there are more than one task can hold the pairs of."""
    return subjects.limit(most_subjects(d) + 1).count() > most_subjects(d)


def grouped_matrices(own: DataFrame, d: int, how: K.Settings) -> DataFrame:
    """(subject_id, label, w) from fitted (subject_id, w): groups by complete linkage, and each group's mean."""
    from ..operators import selection

    own = written(own, "matrices")
    labels = written(complete(own, "subject_id", "w", how.tau if how.cut == "tau" else None).withColumnRenamed("id", "subject_id"), "labels")
    return labels.join(selection.consensus(own.join(labels, "subject_id"), d, how.least, how.digits, how.zero_diagonal), "label").select("subject_id", "label", "w")


def fit_groups(spark: SparkSession, stats: DataFrame, d: int, how: K.Settings = K.Settings()) -> DataFrame:
    """(subject_id, label, src, dst, weight): each subject's group and the group's graph, every entry."""
    if is_large(stats.select("subject_id"), d):
        found = grouped_matrices(large_fit.fitted(stats, d, how)[0], d, how).select("subject_id", "label", F.posexplode("w").alias("at", "weight"))
        return found.select("subject_id", "label", F.expr(f"at div {d}").cast("int").alias("src"), (F.col("at") % d).alias("dst"), "weight")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("subject_id")
        fit = K.fit_many(matrices(frame, d)[None], np.array([0]), [how])[0]
        return pd.concat([edge_rows(fit.groups[label], subject_id=s, label=label) for s, label in zip(frame["subject_id"], fit.labels.tolist(), strict=True)])

    return in_one_task(stats, d).applyInPandas(run, f"subject_id long, label int, {EDGES}")


def fit_trace(spark: SparkSession, stats: DataFrame, d: int, how: K.Settings = K.Settings()) -> DataFrame:
    """(dc_iter, admm_iter, primal, dual, rho1, sum_h): how a grouped fit converged."""
    if is_large(stats.select("subject_id"), d):
        return spark.createDataFrame(large_fit.fitted(stats, d, how)[1], "dc_iter int, admm_iter int, primal double, dual double, rho1 double, sum_h double")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fit = K.fit_many(matrices(frame.sort_values("subject_id"), d)[None], np.array([0]), [how])[0]
        return pd.DataFrame(fit.trace, columns=["dc_iter", "admm_iter", "primal", "dual", "rho1", "sum_h"])

    return in_one_task(stats, d).applyInPandas(run, "dc_iter int, admm_iter int, primal double, dual double, rho1 double, sum_h double")


#: Problems that a task solves together.
TOGETHER = 512


def per_group(stats: DataFrame, d: int, key: str, solve: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
    """(key, src, dst, weight): one matrix for each row of statistics; a task's rows are solved some hundreds at a time."""
    kind = dict(stats.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.iloc[at : at + TOGETHER]
                yield pd.concat([edge_rows(w, **{key: k}) for k, w in zip(some[key], solve(matrices(some, d), some), strict=True)])

    return spread(stats, key).mapInPandas(run, f"{key} {kind}, {EDGES}")


def warm_start(stats: DataFrame, d: int, l1: float) -> DataFrame:
    return per_group(stats.select("subject_id", "m", "xtx"), d, "subject_id", lambda s, _: np.stack([K.lasso(one, l1) for one in s]))


def notears_individual(stats: DataFrame, d: int, beta: float, least: float = 0.0) -> DataFrame:
    return per_group(stats.select("subject_id", "m", "xtx"), d, "subject_id", lambda s, _: K.notears_many(s, beta, least=least))


def notears_cluster(stats: DataFrame, d: int, beta: float, least: float = 0.0) -> DataFrame:
    """stats with label: one graph for each label from the pooled moments of its subjects."""
    return per_group(moments.merged(stats, d, "label").select("label", "m", "xtx"), d, "label", lambda s, _: K.notears_many(s, beta, least=least))


def notears_each(keyed: DataFrame, d: int, key: str) -> DataFrame:
    """(key, src, dst, weight) from (key, m, xtx, alpha): every row has a penalty of its own."""
    return per_group(keyed.select(key, "m", "xtx", "alpha"), d, key, lambda s, rows: K.notears_many(s, rows["alpha"].to_numpy(float)))


def notears_constrained(stats: DataFrame, d: int, beta: float, constraints: DataFrame, least: float = 0.0) -> DataFrame:
    """(subject_id, src, dst, weight) without forbidden edges. constraints: (src, dst), of which a null stands for any variable."""
    rows = [tuple(r) for r in constraints.select("src", "dst").distinct().limit(d * d + 2 * d + 1).collect()]
    if any(v is not None and not 0 <= v < d for r in rows for v in r):
        raise ValueError(f"a constraint names a variable that isn't one of {d}")
    mask = K.edge_mask(d, [r for r in rows if None not in r], [a for a, b in rows if b is None and a is not None], [b for a, b in rows if a is None and b is not None])
    return per_group(stats.select("subject_id", "m", "xtx"), d, "subject_id", lambda s, _: K.notears_many(s, beta, mask, least=least))


def notears_pooled(stats: DataFrame, d: int, beta: float, least: float = 0.0) -> DataFrame:
    """(subject_id, src, dst, weight): one graph from all moments, for every subject."""
    one = per_group(moments.merged(stats.withColumn("pool", F.lit(0)), d, "pool").select("pool", "m", "xtx"), d, "pool", lambda s, _: K.notears_many(s, beta, least=least))
    return stats.select("subject_id").crossJoin(F.broadcast(one.drop("pool")))  # d^2 rows


def notears_rows(obs: DataFrame, d: int, l1: float, kind: str, least: float = 0.3) -> DataFrame:
    """(subject_id, src, dst, weight) for losses on rows: a subject's own rows meet in a task, equal ones as one row and their number."""
    counted = obs.groupBy("subject_id", "x").agg(F.count("*").alias("n"))
    return counted.groupBy("subject_id").applyInPandas(lambda frame: edge_rows(K.notears_rows(np.stack(frame["x"]).astype(float), l1, kind, least=least, counts=frame["n"].to_numpy(float)), subject_id=frame["subject_id"].iloc[0]), f"subject_id long, {EDGES}")


def linkage(pairs: DataFrame, cut: float | None, ids: DataFrame) -> DataFrame:
    """(id, label) from pairs (i, j, dist): complete linkage cut at a height (inclusive), or at the largest jump.

    ids: one column, everyone to group, those without a pair too; their number is checked.
    """
    bounded_subjects(ids, 1)
    kind = pairs.schema["i"].dataType.simpleString()
    alone = ids.toDF("i").select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, flat = np.unique(np.concatenate([frame["i"], frame["j"]]), return_inverse=True)
        n = len(ids)
        dist = np.zeros((n, n))
        i, j = flat[: len(frame)], flat[len(frame) :]
        dist[i, j] = dist[j, i] = frame["dist"]
        merges = K.complete_linkage(dist)
        at = K.jump_cut(merges) if cut is None else cut
        return pd.DataFrame({"id": ids, "label": np.arange(1, n + 1) if at is None else K.flat_labels(n, merges, at)})

    return pairs.select("i", "j", "dist").union(alone).groupBy(F.lit(0).alias("all")).applyInPandas(run, f"id {kind}, label int")


def training_sets(table: pd.DataFrame, d: int) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(subject ids, {fold: which subjects have other rows}, {fold: their second moments without the fold}) from (subject_id, fold, m, xtx)."""
    ids, row = np.unique(table["subject_id"], return_inverse=True)
    names, fold = np.unique(table["fold"], return_inverse=True)
    m, xtx = np.zeros((len(names), len(ids))), np.zeros((len(names), len(ids), d, d))
    np.add.at(m, (fold, row), table["m"].to_numpy(float))
    np.add.at(xtx, (fold, row), np.stack(table["xtx"].to_list()).astype(float).reshape(-1, d, d))
    rest, rest_xtx = m.sum(axis=0) - m, xtx.sum(axis=0) - xtx
    return ids, {f: rest[k] > 0 for k, f in enumerate(names.tolist())}, {f: rest_xtx[k][rest[k] > 0] / rest[k][rest[k] > 0][:, None, None] for k, f in enumerate(names.tolist())}


def cross_validate(spark: SparkSession, by_fold: DataFrame, d: int, grid: DataFrame, how: K.Settings = K.Settings(), criteria: tuple[str, ...] = ("recon",)) -> DataFrame:
    """(lambda1, lambda2, tau, rho1, rho2, fold, recon_error[, mle_error, cov_error]), a row a combination and fold.

    Fits are dealt out to tasks, and a task solves all of its own together. A task needs the
    statistics of all subjects and folds (n k d^2 numbers, checked), which are shuffled to it beside
    its fits; the training moments of a fold are the total less its own. A subject without rows
    outside a fold isn't fitted there. Errors are those of each subject's group matrix on its
    held-out moments; undefined ones are left out of the mean.
    """
    if is_large(by_fold.select("subject_id").distinct(), d):
        return cross_validate_large(spark, by_fold, d, grid, how, criteria)
    subjects = by_fold.select("subject_id").distinct().count()
    names = ["lambda1", "lambda2", "tau", "rho1", "rho2"]
    folds = by_fold.select(F.col("fold").cast("int").alias("fold")).distinct()
    # A fold is one of a handful.
    jobs = grid.select(*names).crossJoin(F.broadcast(folds))
    fits = grid.count() * max(1, folds.count())
    # A task's time hardly grows with its fits as long as they are some dozens.
    parts = max(1, min(spark.sparkContext.defaultParallelism, fits))
    # The dearest fits have the smallest penalties: neighbours in this order go to different tasks.
    place = F.row_number().over(Window.orderBy(*names, "fold"))
    jobs = jobs.withColumn("part", (place % parts).cast("int"))
    beside = by_fold.select("subject_id", F.col("fold").cast("int").alias("fold"), "m", "sum", "xtx").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    together = max(1, MOST_NUMBERS // (8 * max(1, subjects * (subjects - 1) // 2) * d * d))

    def run(mine: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        ids, there, train = training_sets(table, d)
        tests = {f: {row.subject_id: row for row in rows.itertuples()} for f, rows in table.groupby("fold")}
        out = []
        # Folds with the same subjects are fitted together.
        for who in {tuple(there[f]) for f in mine["fold"]}:
            sets = [f for f in sorted(there) if tuple(there[f]) == who]
            own = [job for job in mine.itertuples(index=False) if job.fold in sets]
            for at in range(0, len(own), together):
                chunk = own[at : at + together]
                hows = [replace(how, l1=job.lambda1, l2=job.lambda2, tau=job.tau, rho1=job.rho1, rho2=job.rho2) for job in chunk]
                found = K.fit_many(np.stack([train[f] for f in sets]), np.array([sets.index(job.fold) for job in chunk]), hows)
                for job, fit in zip(chunk, found, strict=True):
                    held = [(fit.groups[label], tests[job.fold][s]) for s, label in zip(ids[list(who)].tolist(), fit.labels.tolist(), strict=True) if s in tests[job.fold]]
                    row = {n: getattr(job, n) for n in [*names, "fold"]}
                    row["recon_error"] = float(np.mean([K.reconstruction(w, np.asarray(r.xtx, float).reshape(d, d) / r.m) for w, r in held]))
                    for c in criteria:
                        if c != "recon":
                            values = [criterion(c, w, r, d) for w, r in held]
                            row[f"{c}_error"] = float(np.mean([v for v in values if v is not None] or [np.nan]))
                    out.append(row)
        return pd.DataFrame(out)

    extra = "".join(f", {c}_error double" for c in criteria if c != "recon")
    schema = f"lambda1 double, lambda2 double, tau double, rho1 double, rho2 double, fold int, recon_error double{extra}"
    # As many partitions as parts, so that no two parts wait for each other where parts are few.
    return jobs.repartition(parts, "part").groupBy("part").cogroup(beside.repartition(parts, "part").groupBy("part")).applyInPandas(lambda mine, table: run(mine, table) if len(mine) else pd.DataFrame(columns=[n.split()[0] for n in schema.split(", ")]), schema)


def cross_validate_large(spark: SparkSession, by_fold: DataFrame, d: int, grid: DataFrame, how: K.Settings, criteria: tuple[str, ...]) -> DataFrame:
    """cross_validate for more subjects than one task can hold the pairs of: one fit after the other, each spread over all tasks."""
    names, more = ["lambda1", "lambda2", "tau", "rho1", "rho2"], [c for c in criteria if c != "recon"]
    kept = written(by_fold.select("subject_id", F.col("fold").cast("int").alias("fold"), "m", "sum", "xtx"), "folds")
    combinations = grid.select(*names).orderBy(*names).collect()
    out = []

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [(np.asarray(r.w, float).reshape(d, d), r) for r in batch.itertuples()]
            yield pd.DataFrame({"recon": [K.reconstruction(w, np.asarray(r.xtx, float).reshape(d, d) / r.m) for w, r in held], **{c: pd.Series([criterion(c, w, r, d) for w, r in held], dtype=float) for c in more}})

    for fold in sorted(r.fold for r in kept.select("fold").distinct().collect()):  # a handful
        train = written(moments.merged(kept.where(F.col("fold") != fold), d, "subject_id"), "train")
        for one in combinations:
            found, _ = large_fit.fitted(train, d, replace(how, l1=one.lambda1, **{k: one[v] for k, v in (("l2", "lambda2"), ("tau", "tau"), ("rho1", "rho1"), ("rho2", "rho2"))}))
            groups = grouped_matrices(found, d, replace(how, tau=one.tau))
            held = groups.join(kept.where(F.col("fold") == fold), "subject_id").select("w", "m", "sum", "xtx")
            of = held.mapInPandas(errors, ", ".join(f"{c} double" for c in ["recon", *more]))
            row = of.agg(*(F.avg(F.nanvl(c, F.lit(None).cast("double")) if c != "recon" else F.col(c)).alias(c) for c in ["recon", *more])).head()
            out.append((*one, fold, *(float("nan") if v is None else v for v in row)))
    return spark.createDataFrame(out, f"{', '.join(f'{n} double' for n in names)}, fold int, recon_error double{''.join(f', {c}_error double' for c in more)}")


def criterion(kind: str, w: np.ndarray, row, d: int) -> float | None:
    """mle or cov of one subject's held-out statistics; None where it isn't defined."""
    m, total, xtx = row.m, np.asarray(row.sum, float), np.asarray(row.xtx, float).reshape(d, d)
    if m < 2:
        return None
    cov, a = (xtx - np.outer(total, total) / m) / (m - 1), np.eye(d) - w
    if kind == "cov":
        inverse = np.linalg.pinv(a)
        return float(np.linalg.norm(inverse @ inverse.T - cov))
    t = float((a * (a @ cov)).sum())
    return m * d / 2 * np.log(t) + np.log(m) / 2 * np.count_nonzero(w) if t > 0 else None


def tune_notears(spark: SparkSession, by_fold: DataFrame, d: int, alphas: list[float], key: str | None = None) -> DataFrame:
    """(key, alpha, position, error): the mean held-out error of NOTEARS for each alpha.

    by_fold: statistics of (subject_id, fold), with the key's column if one is named. No key: one
    graph from all subjects; "subject_id": one a subject; "label": one a label. Statistics are
    summed by (key, fold), so a task gets k rows for a key.
    """
    keyed = by_fold.withColumn("of", F.lit(0).cast("long") if key is None else F.col(key))
    kind = keyed.schema["of"].dataType.simpleString()
    sums = moments.merged(keyed, d, "of", "fold")
    grid = spark.createDataFrame(list(enumerate(map(float, alphas))), "position int, alpha double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some, train, test, betas, of = batch.iloc[at : at + TOGETHER], [], [], [], []
                for row, (rows, alpha) in enumerate(zip(some["rows"], some["alpha"], strict=True)):
                    if len(rows) < 2:
                        raise ValueError("a key needs rows in two folds at least")
                    m, xtx = np.array([r["m"] for r in rows], float), np.array([r["xtx"] for r in rows], float).reshape(-1, d, d)
                    for fold in range(len(rows)):
                        rest = np.arange(len(rows)) != fold
                        train.append(xtx[rest].sum(axis=0) / m[rest].sum())
                        test.append(xtx[fold] / m[fold])
                    betas += [alpha] * len(rows)
                    of += [row] * len(rows)
                found = K.notears_many(np.stack(train), np.array(betas, float))
                errors = np.array([K.reconstruction(w, s) for w, s in zip(found, test, strict=True)])
                yield some[["of", "alpha", "position"]].assign(error=np.bincount(of, errors) / np.bincount(of))

    # A key's folds are a handful, and so are alphas.
    held = sums.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("fold", "m", "xtx"))).alias("rows"))
    return spread(held.crossJoin(F.broadcast(grid)), "of", "position").mapInPandas(run, f"of {kind}, alpha double, position int, error double")


def best_alpha(tuned: DataFrame, shared: bool) -> DataFrame:
    """The alpha of least mean error, the first of the grid on ties: one for all (shared), or one for each key."""
    if shared:
        return tuned.groupBy("alpha", "position").agg(F.avg("error").alias("error")).orderBy("error", "position").limit(1)
    return tuned.groupBy("of").agg(F.min_by(F.struct("alpha", "error"), F.struct("error", "position")).alias("best")).select("of", "best.*")


def grouped_by_linkage(own: DataFrame, cut: float | None, d: int) -> DataFrame:
    """(subject_id, label, w) from (subject_id, w): subjects grouped by complete linkage, each with its group's mean matrix."""
    from ..operators import selection

    own = written(own.select("subject_id", "w"), "matrices")
    labels = complete(own, "subject_id", "w", cut).withColumnRenamed("id", "subject_id")
    labelled = own.select("subject_id", "w").join(labels, "subject_id")
    return labels.join(selection.consensus(labelled, d, None, None), "label").select("subject_id", "label", "w")


def two_step(spark: SparkSession, stats: DataFrame, d: int, beta: float, tau: float) -> tuple[DataFrame, DataFrame]:
    """((subject_id, label), (label, w)): graphs of single subjects, rounded to 3 digits, grouped by complete linkage; group means as they are."""
    from ..operators import selection

    entries = notears_individual(stats, d, beta).select("subject_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.bround("weight", 3).alias("value"))
    own = written(moments.array_form(entries, d, "subject_id"), "matrices")
    labels = complete(own, "subject_id", "w", tau).withColumnRenamed("id", "subject_id")
    return labels, selection.consensus(own.join(labels, "subject_id"), d, None, None)
