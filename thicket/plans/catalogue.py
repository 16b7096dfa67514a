"""The registered queries of the library's own operators, and their SQL for DuckDB.

Subjects are suppliers; a subject's observations are its z-scored lineitem measures. Weight
matrices for the operators that need no fit are W[a, b] = S[a, b] / S[a, a] above the diagonal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..functions import kernels as K
from ..operators import blocks, clustering, errors, folds, graph_metrics, linkage, moments, pairs, selection
from ..sources import simulate
from ..sources.written import written
from . import experiments, fit, preclusters

D = 4
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
FOLDS = 3
RATIO = 0.7
L1, L2, TAU, RHO2 = 0.01, 0.05, 0.15, 0.4
THRESHOLDS = [t / 100 for t in range(1, 11)]
SHRINKS = [0.25, 0.5, 0.75, 1.0]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str, ranked: bool = True) -> DataFrame:
    """(subject_id, obs_idx, x); places are worked out only where a query needs them."""
    lines = load(spark, sf, "lineitem").select("l_suppkey", *dict.fromkeys(ORDER + MEASURES))
    scored = moments.zscore(lines.withColumn("price", F.col("l_extendedprice")), MEASURES, "l_suppkey")
    return moments.observations(scored, "l_suppkey", MEASURES, ["l_orderkey", "l_linenumber", "l_partkey", "price"] if ranked else None)


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return moments.additive(obs(spark, sf, ranked=False), D, "subject_id")


def upper_weights() -> Column:
    """W from the moments s."""
    cell = lambda a, b: F.when(a < b, M.at(F.col("s"), a, b, D) / M.at(F.col("s"), a, a, D)).otherwise(0.0)
    return M.build(D, cell)


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """(subject_id, m, s, cov, w)."""
    rows = stats(spark, sf).select("subject_id", "m", moments.second_moment().alias("s"), moments.centred_covariance(D).alias("cov"))
    return rows.withColumn("w", upper_weights())


def regions(spark: SparkSession, sf: str) -> DataFrame:
    supplier = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"), "s_nationkey", "s_acctbal")
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").cast("int").alias("label"))
    return supplier.join(F.broadcast(nation), "s_nationkey").select("subject_id", "label", "s_acctbal")  # 25 nations


def cells(frame: DataFrame, column: str, *keys: str, d: int = D) -> DataFrame:
    out = moments.long_form(frame, column, d, *keys)
    return out.select(*keys, "a", "b", r6("value").alias("value"))


# The base views in SQL.
_z = ", ".join(f"({c}::DOUBLE - avg({c}) OVER g) / stddev_samp({c}) OVER g AS x{k}" for k, c in enumerate(MEASURES))
BASE = f"""z AS (SELECT l_suppkey AS subject_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, {_z} FROM lineitem WINDOW g AS (PARTITION BY l_suppkey)),
obs AS (SELECT subject_id, (row_number() OVER (PARTITION BY subject_id ORDER BY l_orderkey, l_linenumber, l_partkey, price) - 1)::INT AS obs_idx, count(*) OVER (PARTITION BY subject_id) AS m, [x0, x1, x2, x3] AS x FROM z),
ix AS (SELECT unnest(range(1, {D + 1}))::INT AS i), ab AS (SELECT p.i - 1 AS a, q.i - 1 AS b FROM ix p, ix q),
mom AS (SELECT subject_id, a, b, count(*) AS m, sum(x[a + 1]) AS sa, sum(x[b + 1]) AS sb, sum(x[a + 1] * x[b + 1]) AS q FROM obs, ab GROUP BY ALL),
s AS (SELECT subject_id, a, b, m, q / m AS s, (q - sa * sb / m) / (m - 1) AS c FROM mom),
w AS (SELECT p.subject_id, p.a, p.b, p.m, CASE WHEN p.a < p.b THEN p.s / q.s ELSE 0.0 END AS w FROM s p JOIN s q ON q.subject_id = p.subject_id AND q.a = p.a AND q.b = p.a),
r AS (SELECT subject_id, a, b, m, (CASE WHEN a = b THEN 1.0 ELSE 0.0 END) - w AS r FROM w)"""
REGION = "reg AS (SELECT s_suppkey AS subject_id, n_regionkey::INT AS label, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def base_sql(rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{', ' if rest.lstrip()[:6].upper() != 'SELECT' else ' '}{rest}"


def _out(columns: str) -> str:
    """`a b sum(x):value` in short: names as they are, others rounded."""
    return ", ".join(c if ":" not in c else f"round({c.split(':')[0]}, 6) + 0.0 AS {c.split(':')[1]}" for c in columns.split(";"))


@query(base_sql(f"SELECT {_out('subject_id;a;b;s:value')} FROM s"))
def second_moment(spark, sf):
    return cells(stats(spark, sf).withColumn("s", moments.second_moment()), "s", "subject_id")


@query(base_sql(f"SELECT {_out('subject_id;obs_idx;x[1]:x0;x[2]:x1;x[3]:x2;x[4]:x3')} FROM obs"))
def group_zscore(spark, sf):
    return obs(spark, sf).select("subject_id", "obs_idx", *(r6(F.get("x", F.lit(k))).alias(f"x{k}") for k in range(D)))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round(coalesce(({c} - avg({c}) OVER g) / nullif(stddev_pop({c}) OVER g, 0), 0), 6) + 0.0 AS z{k}" for k, c in enumerate(MEASURES)) + " FROM lineitem WINDOW g AS (PARTITION BY l_suppkey)")
def standardize_pop(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_suppkey", *dict.fromkeys(ORDER[:3] + MEASURES))
    scored = moments.zscore(moments.mean_imputed(lines, MEASURES, "l_suppkey"), MEASURES, "l_suppkey", ddof=0)
    return scored.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", *(r6(c).alias(f"z{k}") for k, c in enumerate(MEASURES)))


@query(base_sql(f"SELECT {_out('subject_id;a;b;c:value')} FROM s"))
def centered_cov(spark, sf):
    return cells(weights(spark, sf), "cov", "subject_id")


@query(base_sql(f"SELECT {_out('a;b;sum(q) / sum(m):value')} FROM mom GROUP BY a, b"))
def pooled_moment(spark, sf):
    return cells(moments.merged(stats(spark, sf), D).withColumn("s", moments.second_moment()), "s")


@query(base_sql(f"{REGION} SELECT {_out('label;a;b;sum(q) / sum(m):value')} FROM mom JOIN reg USING (subject_id) GROUP BY label, a, b"))
def cluster_moment(spark, sf):
    joined = stats(spark, sf).join(regions(spark, sf), "subject_id")
    return cells(moments.merged(joined, D, "label").withColumn("s", moments.second_moment()), "s", "label")


FOLD_SQL = f"f AS (SELECT *, (CASE WHEN obs_idx < (m % {FOLDS}) * (m // {FOLDS} + 1) THEN obs_idx // (m // {FOLDS} + 1) ELSE m % {FOLDS} + (obs_idx - (m % {FOLDS}) * (m // {FOLDS} + 1)) // (m // {FOLDS}) END)::INT AS fold FROM obs)"
FM_SQL = f"{FOLD_SQL}, fm AS (SELECT subject_id, fold, a, b, count(*) AS m, sum(x[a + 1] * x[b + 1]) AS q FROM f, ab GROUP BY ALL)"


@query(base_sql(f"{FOLD_SQL} SELECT subject_id, obs_idx, fold FROM f"))
def kfold_contiguous(spark, sf):
    return folds.with_contiguous_folds(obs(spark, sf), FOLDS).select("subject_id", "obs_idx", "fold")


@query(base_sql(f"SELECT subject_id, obs_idx, CASE WHEN obs_idx < greatest(1, least(floor(m * {RATIO}), m - 1)) THEN 'train' ELSE 'test' END AS part FROM obs"))
def train_test_split(spark, sf):
    return folds.split(obs(spark, sf), RATIO).select("subject_id", "obs_idx", "part")


def by_fold(spark, sf):
    return moments.additive(folds.with_contiguous_folds(obs(spark, sf), FOLDS), D, "subject_id", "fold")


@query(base_sql(f"{FM_SQL} SELECT {_out('subject_id;fold;a;b;q / m:value')} FROM fm"))
def fold_moments(spark, sf):
    return cells(by_fold(spark, sf).withColumn("s", moments.second_moment()), "s", "subject_id", "fold")


@query(base_sql(f"{FM_SQL} SELECT {_out('t.subject_id;t.fold;t.a;t.b;sum(o.q) / sum(o.m):value')} FROM fm t JOIN fm o ON t.subject_id = o.subject_id AND t.a = o.a AND t.b = o.b AND t.fold <> o.fold GROUP BY t.subject_id, t.fold, t.a, t.b"))
def train_moments(spark, sf):
    rest = moments.without_fold(by_fold(spark, sf), D, "subject_id").withColumn("s", moments.second_moment())
    return cells(rest, "s", "subject_id", "fold")


RECON_SQL = "rec AS (SELECT x.subject_id, sum(x.r * s.s * y.r) AS e FROM r x JOIN s ON s.subject_id = x.subject_id AND s.a = x.a JOIN r y ON y.subject_id = x.subject_id AND y.a = s.b AND y.b = x.b GROUP BY x.subject_id)"


@query(base_sql(f"{RECON_SQL} SELECT {_out('subject_id;e:recon_error')} FROM rec"))
def recon_error(spark, sf):
    return weights(spark, sf).select("subject_id", r6(errors.reconstruction(F.col("w"), F.col("s"), D)).alias("recon_error"))


@query(base_sql(f"{RECON_SQL} SELECT {_out('avg(e):recon_error')} FROM rec"))
def recon_error_total(spark, sf):
    return weights(spark, sf).agg(r6(F.avg(errors.reconstruction(F.col("w"), F.col("s"), D))).alias("recon_error"))


@query(base_sql(f"{RECON_SQL} SELECT {_out('subject_id;e / 2:loss')} FROM rec"))
def sem_loss(spark, sf):
    return weights(spark, sf).select("subject_id", r6(errors.sem_loss(F.col("w"), F.col("s"), D)).alias("loss"))


MLE_SQL = """t AS (SELECT x.subject_id, sum(x.r * y.r * c.c) AS t FROM r x JOIN r y ON y.subject_id = x.subject_id AND y.a = x.a JOIN s c ON c.subject_id = x.subject_id AND c.a = y.b AND c.b = x.b GROUP BY x.subject_id),
nz AS (SELECT subject_id, m, count(*) FILTER (WHERE w <> 0) AS nz FROM w GROUP BY subject_id, m)"""


@query(base_sql(f"{MLE_SQL} SELECT {_out(f'subject_id;m * {D} / 2.0 * ln(t) + 0.5 * ln(m) * nz:penalized_error')} FROM t JOIN nz USING (subject_id)"))
def penalized_mle(spark, sf):
    return weights(spark, sf).select("subject_id", r6(errors.penalized_likelihood(F.col("w"), F.col("cov"), F.col("m"), D)).alias("penalized_error"))


COV_SQL = """e AS (SELECT subject_id, a, b, (CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS p, 0 AS k FROM w),
p1 AS (SELECT w.subject_id, w.a, w.b, w.w AS p FROM w), p2 AS (SELECT x.subject_id, x.a, y.b, sum(x.p * y.w) AS p FROM p1 x JOIN w y ON x.subject_id = y.subject_id AND x.b = y.a GROUP BY ALL),
p3 AS (SELECT x.subject_id, x.a, y.b, sum(x.p * y.w) AS p FROM p2 x JOIN w y ON x.subject_id = y.subject_id AND x.b = y.a GROUP BY ALL),
inv AS (SELECT subject_id, a, b, sum(p) AS p FROM (SELECT subject_id, a, b, p FROM e UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY ALL),
mc AS (SELECT x.subject_id, x.a, y.a AS b, sum(x.p * y.p) AS v FROM inv x JOIN inv y ON x.subject_id = y.subject_id AND x.b = y.b GROUP BY ALL)"""


@query(base_sql(f"{COV_SQL} SELECT {_out('subject_id;sqrt(sum((v - c) * (v - c))):cov_error')} FROM mc JOIN s USING (subject_id, a, b) GROUP BY subject_id"))
def covariance_error(spark, sf):
    return weights(spark, sf).select("subject_id", r6(errors.covariance_error(F.col("w"), F.col("cov"), D)).alias("cov_error"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.x, b.x), 6) + 0.0 AS dist FROM e a JOIN e b ON a.vec_id < b.vec_id")
def pair_distance(spark, sf):
    vectors = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return blocks.pair_distances(vectors, "vec_id", "x").select("i", "j", r6("dist").alias("dist"))


def written_weights(spark, sf):
    """weights, written: both sides of the pairs read them, and the pairs' blocks count them."""
    return written(weights(spark, sf), "weights")


def subject_pairs(known, run, schema):
    """run over tiles (i, j, prev, u, diff) of written weights' pairs: W_i - W_j, a dual of a tenth of S_i - S_j, and W_i - W_j - u, a row a pair."""

    def differences(tiles):
        for i, j, first, second in tiles:
            prev, u = first["w"] - second["w"], 0.1 * (first["s"] - second["s"])
            yield i, j, prev, u, prev - u

    return blocks.pair_tiles(known, "subject_id", ["w", "s"], lambda tiles: run(differences(tiles)), schema)


def pair_cells(known, value):
    """(i, j, a, b, value) of value(prev, u, diff), to six digits as the SQL rounds."""

    def run(tiles):
        for i, j, *of in tiles:
            yield pairs.array_rows(i, j, pairs.rounded(value(*of), 6))

    rows = subject_pairs(known, run, "i long, j long, v array<double>")
    return moments.long_form(rows, "v", D, "i", "j")


PAIR_SQL = """pr AS (SELECT x.subject_id AS i, y.subject_id AS j, x.a, x.b, x.w - y.w AS prev, 0.1 * (sx.s - sy.s) AS u FROM w x JOIN w y ON x.subject_id < y.subject_id AND x.a = y.a AND x.b = y.b
  JOIN s sx ON sx.subject_id = x.subject_id AND sx.a = x.a AND sx.b = x.b JOIN s sy ON sy.subject_id = y.subject_id AND sy.a = x.a AND sy.b = x.b),
nm AS (SELECT i, j, sqrt(sum(prev * prev)) AS np, sqrt(sum((prev - u) * (prev - u))) AS nd FROM pr GROUP BY i, j)"""
THETA_SQL = f"""{PAIR_SQL}, th AS (SELECT i, j, a, b, prev, u, np, (CASE WHEN np < {TAU} AND (SELECT max(np) FROM nm) >= 1e-12 THEN greatest(0.0, 1 - {L2} / {RHO2} / (nd + 1e-12)) ELSE 1.0 END) * (prev - u) AS theta FROM pr JOIN nm USING (i, j))"""


@query(base_sql(f"{PAIR_SQL} SELECT {_out(f'i;j;a;b;greatest(0.0, 1 - 0.1 / (nd + 1e-12)) * (prev - u):value')} FROM pr JOIN nm USING (i, j)"))
def soft_threshold(spark, sf):
    return pair_cells(written_weights(spark, sf), lambda prev, u, diff: pairs.drawn(diff, 0.1))


def theta_of(known):
    """theta(prev, diff) of all pairs of written weights."""
    any_apart = pairs.any_apart(known, "subject_id", "w", D * D)
    return lambda prev, diff: pairs.thetas(diff, pairs.norms(prev), any_apart, L2, RHO2, TAU)


@query(base_sql(f"{THETA_SQL} SELECT {_out('i;j;a;b;theta:value')} FROM th"))
def theta_update(spark, sf):
    known = written_weights(spark, sf)
    theta = theta_of(known)
    return pair_cells(known, lambda prev, u, diff: theta(prev, diff))


@query(base_sql(f"{THETA_SQL} SELECT {_out('i;j;a;b;u + theta - prev:value')} FROM th"))
def dual_update(spark, sf):
    known = written_weights(spark, sf)
    theta = theta_of(known)
    return pair_cells(known, lambda prev, u, diff: u + theta(prev, diff) - prev)


@query(base_sql(f"{THETA_SQL}, n AS (SELECT i, j, sqrt(sum((theta - prev) * (theta - prev))) AS r FROM th GROUP BY i, j) SELECT {_out(f'avg(r):primal;avg({RHO2} * r):dual')} FROM n"))
def primal_dual_residual(spark, sf):
    known = written_weights(spark, sf)
    any_apart = pairs.any_apart(known, "subject_id", "w", D * D)

    def run(tiles):
        total, n = 0.0, 0
        for wanted, a, b in tiles:
            gap = pairs.gaps((a["w"], b["w"]), (0.1 * a["s"], 0.1 * b["s"]), any_apart, L2, RHO2, TAU)
            total, n = total + gap[wanted].sum(), n + int(wanted.sum())
        yield pd.DataFrame({"total": [total], "n": [n]})

    gap = blocks.whole_tiles(known, "subject_id", ["w", "s"], run, "total double, n long").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return gap.select(r6(mean).alias("primal"), r6(mean * RHO2).alias("dual"))


@query(base_sql(f"{RECON_SQL}, {PAIR_SQL} SELECT round((SELECT sum(e / 2) FROM rec) + (SELECT {L1} * sum(abs(w)) FROM w) + (SELECT sum(CASE WHEN np < {TAU} THEN {L2} * np ELSE {L2 * TAU} END) FROM nm), 6) + 0.0 AS objective"))
def dc_objective(spark, sf):
    known = written_weights(spark, sf)
    own = known.agg(F.sum(errors.sem_loss(F.col("w"), F.col("s"), D) + F.aggregate("w", F.lit(0.0), lambda acc, x: acc + F.abs(x)) * L1).alias("own"))

    def run(tiles):
        total = 0.0
        for _, _, first, second in tiles:
            norm = pairs.norms(first["w"] - second["w"])
            total += np.where(norm < TAU, L2 * norm, L2 * TAU).sum()
        yield pd.DataFrame({"total": [total]})

    fused = blocks.pair_tiles(known, "subject_id", ["w"], run, "total double").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("fused"))
    return own.crossJoin(fused).select(r6(F.col("own") + F.col("fused")).alias("objective"))


@query(base_sql(f"""o AS (SELECT subject_id, a, b, CASE WHEN a = b THEN 0.0 ELSE s * s END AS v FROM s),
g AS (SELECT subject_id, list(v ORDER BY a, b) AS v FROM o GROUP BY subject_id),
k(subject_id, n, p) AS (SELECT subject_id, 0, [CASE WHEN i // {D} = i % {D} THEN 1.0::DOUBLE ELSE 0.0 END FOR i IN range({D * D})] FROM g
  UNION ALL SELECT k.subject_id, n + 1, [(p[i // {D} * {D} + 1] * v[i % {D} + 1] + p[i // {D} * {D} + 2] * v[i % {D} + {D + 1}] + p[i // {D} * {D} + 3] * v[i % {D} + {2 * D + 1}] + p[i // {D} * {D} + 4] * v[i % {D} + {3 * D + 1}]) / (n + 1) FOR i IN range({D * D})]
  FROM k JOIN g ON g.subject_id = k.subject_id WHERE n < 20)
SELECT subject_id, round(sum(p[1] + p[6] + p[11] + p[16]), 6) + 0.0 AS h FROM k WHERE n > 0 GROUP BY subject_id""", True))
def acyclicity_h(spark, sf):
    return weights(spark, sf).select("subject_id", r6(M.acyclicity(M.zero_diagonal(F.col("s"), D), D)).alias("h"))


def labelled(spark, sf):
    return weights(spark, sf).join(regions(spark, sf), "subject_id")


@query(base_sql(f"{REGION}, av AS (SELECT label, a, b, avg(w) AS v FROM w JOIN reg USING (subject_id) GROUP BY ALL) SELECT label, a, b, round_even(CASE WHEN abs(v) < 0.01 THEN 0.0 ELSE v END, 2) + 0.0 AS value FROM av"))
def consensus_dag(spark, sf):
    return cells(selection.consensus(labelled(spark, sf), D), "w", "label")


@query(base_sql(f"SELECT {_out('subject_id;a;b;CASE WHEN abs(w) < 0.05 THEN 0.0 ELSE w END:value')} FROM w"))
def threshold_weights(spark, sf):
    return cells(weights(spark, sf).withColumn("t", M.threshold(F.col("w"), 0.05)), "t", "subject_id")


@query(base_sql("SELECT subject_id, a, b, (CASE WHEN abs(round_even(w, 3)) <= 0.05 THEN 0.0 ELSE round_even(w, 3) END) + 0.0 AS value FROM w"))
def threshold_rounded(spark, sf):
    return cells(weights(spark, sf).withColumn("t", M.threshold_rounded(F.col("w"), 0.05)), "t", "subject_id")


@query(base_sql(f"SELECT {_out('subject_id;a;b;CASE WHEN a = b THEN 0.0 ELSE s END:value')} FROM s"))
def zero_diag(spark, sf):
    return cells(weights(spark, sf).withColumn("t", M.zero_diagonal(F.col("s"), D)), "t", "subject_id")


@query(base_sql(f"{REGION}, {PAIR_SQL} SELECT {_out('i;j;np:dist')} FROM nm JOIN reg x ON x.subject_id = i JOIN reg y ON y.subject_id = j AND x.label = y.label WHERE np <= 0.12"))
def plot_edges(spark, sf):
    near = blocks.pair_distances(written(labelled(spark, sf).select("subject_id", "w", "label"), "labelled"), "subject_id", "w", most=0.12, within="label")
    return near.select("i", "j", r6("dist").alias("dist"))


@query(base_sql(f"c AS (SELECT * FROM w WHERE abs(w) > 0.04) SELECT {_out('subject_id;a;b;w:value;greatest(least((SELECT max(abs(w)) FROM c), (SELECT quantile_cont(abs(w), 0.95) FROM c)), 0.05):limit')} FROM c".replace(" AS limit", ' AS "limit"')))
def plot_cells(spark, sf):
    long = moments.long_form(weights(spark, sf), "w", D, "subject_id")
    return selection.heat_cells(long, 0.04).select("subject_id", "a", "b", r6("value").alias("value"), r6("limit").alias("limit"))


def graph_pairs(spark, sf):
    """(subject_id, w_true, w_est): the consensus of the subject's region, and its own matrix."""
    own = labelled(spark, sf)
    truth = selection.consensus(own, D, None, None).withColumnRenamed("w", "w_true")
    return own.select("subject_id", "label", F.col("w").alias("w_est")).join(truth, "label").drop("label")


def _graph_sql(thresholds: list[float], keys: str, average: bool) -> str:
    share = lambda part, whole: f"(CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / ({whole}) ELSE 0.0 END)"
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    kinds = ", ".join(f"count(*) FILTER (WHERE {scope} AND {t} = {x} AND {e} = {y}) AS {name}_{kind}" for name, t, e, scope in (("s", "st", "se", "a < b"), ("g", "t", "e", "true")) for kind, x, y in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    metrics = {
        "skeleton_tpr": share("s_tp", "s_tp + s_fn"), "skeleton_fdr": share("s_fp", "s_tp + s_fp"), "skeleton_tnr": share("s_tn", "s_tn + s_fp"), "skeleton_shd": "s_fp + s_fn",
        "dag_fdr": f"1 - {share('g_tp', 'g_tp + g_fp')}", "dag_tpr": share("g_tp", "g_tp + g_fn"), "dag_fpr": share("g_fp", "g_fp + g_tn"), "dag_tnr": share("g_tn", "g_tn + g_fp"), "dag_shd": "g_fp + g_fn", "dag_nnz": "g_tp + g_fp",
    }
    final = ", ".join(f"round({f'avg({v})' if average else v}, 6) + 0.0 AS {k}" for k, v in metrics.items())
    return base_sql(f"""{REGION}, tv AS (SELECT label, a, b, avg(w) AS v FROM w JOIN reg USING (subject_id) GROUP BY ALL), th(threshold) AS (VALUES {values}),
c AS (SELECT w.subject_id, threshold, w.a, w.b, (abs(round_even(v, 3)) > threshold)::INT AS t, (abs(round_even(w, 3)) > threshold)::INT AS e FROM w JOIN reg USING (subject_id) JOIN tv ON tv.label = reg.label AND tv.a = w.a AND tv.b = w.b, th),
k AS (SELECT x.subject_id, x.threshold, x.a, x.b, x.t, x.e, greatest(x.t, y.t) AS st, greatest(x.e, y.e) AS se FROM c x JOIN c y ON x.subject_id = y.subject_id AND x.threshold = y.threshold AND x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
n AS (SELECT subject_id, threshold, {kinds} FROM k GROUP BY ALL) SELECT {keys}, {final} FROM n {'GROUP BY ' + keys if average else ''}""")


def _rounded_metrics(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.select(*keys, *(r6(F.col(m).cast("double")).alias(m) for m in graph_metrics.METRICS))


@query(_graph_sql([0.01], "subject_id, threshold", False))
def graph_recovery(spark, sf):
    return _rounded_metrics(graph_metrics.graph_metrics(graph_pairs(spark, sf), [0.01], "subject_id"), "subject_id", "threshold")


@query(_graph_sql([0.01], "threshold", True))
def graph_recovery_avg(spark, sf):
    return _rounded_metrics(graph_metrics.macro_average(graph_metrics.graph_metrics(graph_pairs(spark, sf), [0.01], "subject_id"), "threshold"), "threshold")


@query(_graph_sql(THRESHOLDS, "threshold", True))
def threshold_sweep(spark, sf):
    return _rounded_metrics(graph_metrics.macro_average(graph_metrics.graph_metrics(graph_pairs(spark, sf), THRESHOLDS, "subject_id"), "threshold"), "threshold")


LABELS_SQL = "WITH l AS (SELECT n_regionkey::INT AS y_true, floor(s_acctbal / 2500)::INT AS y_pred FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def two_labels(spark, sf):
    return regions(spark, sf).select(F.col("label").alias("y_true"), F.floor(F.col("s_acctbal") / 2500).cast("int").alias("y_pred"))


@query(f"{LABELS_SQL} SELECT y_true, y_pred, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def contingency(spark, sf):
    return clustering.contingency(two_labels(spark, sf))


AGREE_SQL = f"""{LABELS_SQL}, c AS (SELECT y_true, y_pred, count(*)::DOUBLE AS k FROM l GROUP BY ALL), t AS (SELECT y_true, sum(k) AS a FROM c GROUP BY 1), p AS (SELECT y_pred, sum(k) AS b FROM c GROUP BY 1),
n AS (SELECT sum(k) AS n, sum(k * (k - 1) / 2) AS k2 FROM c), e AS (SELECT (SELECT sum(a * (a - 1) / 2) FROM t) AS ta, (SELECT sum(b * (b - 1) / 2) FROM p) AS pb),
h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM t, n) AS ht, (SELECT -sum(b / n * ln(b / n)) FROM p, n) AS hp, (SELECT sum(k / n * ln(n * k / (a * b))) FROM c JOIN t USING (y_true) JOIN p USING (y_pred), n) AS mi),
x AS (SELECT a, b, n, unnest(range(greatest(1, a + b - n)::BIGINT, least(a, b)::BIGINT + 1))::DOUBLE AS k FROM t, p, n),
m AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM x)"""


@query(f"{AGREE_SQL} SELECT round((k2 - ta * pb / (n * (n - 1) / 2)) / ((ta + pb) / 2 - ta * pb / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM n, e")
def ari(spark, sf):
    return clustering.agreement(two_labels(spark, sf)).select(r6("ari").alias("ari"))


@query(f"{AGREE_SQL} SELECT round((mi - emi) / ((ht + hp) / 2 - emi), 6) + 0.0 AS ami FROM h, m")
def ami(spark, sf):
    return clustering.agreement(two_labels(spark, sf)).select(r6("ami").alias("ami"))


@query(f"{AGREE_SQL} SELECT round(mi / ht, 6) + 0.0 AS homogeneity, round(mi / hp, 6) + 0.0 AS completeness, round(2 * mi / (ht + hp), 6) + 0.0 AS v_measure, (SELECT count(*) FROM t)::BIGINT AS n_true, (SELECT count(*) FROM p)::BIGINT AS n_pred FROM h")
def homogeneity_completeness_v(spark, sf):
    return clustering.agreement(two_labels(spark, sf)).select(r6("homogeneity").alias("homogeneity"), r6("completeness").alias("completeness"), r6("v_measure").alias("v_measure"), "n_true", "n_pred")


GRID = {"lambda1": [1e-4, 1e-3, 0.01, 0.1], "lambda2": [0.01, 1e-3, 1e-4, 1e-5], "tau": [0.05, 0.1, 0.4, 0.7], "rho1": [0.1], "rho2": [0.05]}


@query("SELECT lambda1, lambda2, tau, 0.1::DOUBLE AS rho1, 0.05::DOUBLE AS rho2 FROM (SELECT unnest([0.0001, 0.001, 0.01, 0.1]::DOUBLE[]) AS lambda1), (SELECT unnest([0.01, 0.001, 0.0001, 0.00001]::DOUBLE[]) AS lambda2), (SELECT unnest([0.05, 0.1, 0.4, 0.7]::DOUBLE[]) AS tau)")
def param_grid(spark, sf):
    return selection.param_grid(spark, GRID)


def shrunk_errors(spark, sf):
    """(shrink, cut, fold, error): held-out errors of shrunk and cut training matrices, averaged over subjects."""
    folded = by_fold(spark, sf)
    train = moments.without_fold(folded, D, "subject_id").withColumn("s", moments.second_moment()).select("subject_id", "fold", upper_weights().alias("w"))
    test = folded.select("subject_id", "fold", moments.second_moment().alias("s"))
    grid = selection.param_grid(spark, {"shrink": SHRINKS, "cut": [0.0, 0.02, 0.05]})
    # The grid has a row a combination, twelve of them.
    rows = train.join(test, ["subject_id", "fold"]).crossJoin(F.broadcast(grid))
    w = F.transform(F.transform("w", lambda x: x * F.col("shrink")), lambda x: F.when(F.abs(x) < F.col("cut"), 0.0).otherwise(x))
    return rows.groupBy("shrink", "cut", "fold").agg(F.avg(errors.reconstruction(w, F.col("s"), D)).alias("error"))


CV_SQL = f"""{FM_SQL}, tr AS (SELECT t.subject_id, t.fold, t.a, t.b, sum(o.q) / sum(o.m) AS s FROM fm t JOIN fm o ON t.subject_id = o.subject_id AND t.a = o.a AND t.b = o.b AND t.fold <> o.fold GROUP BY ALL),
tw AS (SELECT p.subject_id, p.fold, p.a, p.b, CASE WHEN p.a < p.b THEN p.s / q.s ELSE 0.0 END AS w FROM tr p JOIN tr q ON q.subject_id = p.subject_id AND q.fold = p.fold AND q.a = p.a AND q.b = p.a),
gr AS (SELECT shrink, cut FROM (SELECT unnest({SHRINKS}::DOUBLE[]) AS shrink), (SELECT unnest([0.0, 0.02, 0.05]::DOUBLE[]) AS cut)),
gw AS (SELECT shrink, cut, subject_id, fold, a, b, (CASE WHEN a = b THEN 1.0 ELSE 0.0 END) - CASE WHEN abs(w * shrink) < cut THEN 0.0 ELSE w * shrink END AS r FROM tw, gr),
er AS (SELECT x.shrink, x.cut, x.fold, x.subject_id, sum(x.r * v.q / v.m * y.r) AS e FROM gw x JOIN fm v ON v.subject_id = x.subject_id AND v.fold = x.fold AND v.a = x.a JOIN gw y ON y.subject_id = x.subject_id AND y.fold = x.fold AND y.shrink = x.shrink AND y.cut = x.cut AND y.a = v.b AND y.b = x.b GROUP BY ALL),
cv AS (SELECT shrink, cut, avg(f) AS recon_mean FROM (SELECT shrink, cut, fold, avg(e) AS f FROM er GROUP BY ALL) GROUP BY ALL)"""
PARAMS = ["shrink", "cut"]


def cv(spark, sf):
    return selection.cv_table(shrunk_errors(spark, sf), PARAMS, "error", "recon_mean").withColumn("recon_mean", F.round("recon_mean", 9))


@query(base_sql(f"{CV_SQL} SELECT {_out('shrink;cut;recon_mean:recon_mean')} FROM cv"))
def cv_table(spark, sf):
    return cv(spark, sf).select(*PARAMS, r6("recon_mean").alias("recon_mean"))


@query(base_sql(f"{CV_SQL} SELECT {_out('shrink;cut;recon_mean:recon_mean')} FROM cv ORDER BY round(cv.recon_mean, 9), shrink, cut LIMIT 1"))
def best_combo(spark, sf):
    return selection.best(cv(spark, sf), PARAMS, "recon_mean").select(*PARAMS, r6("recon_mean").alias("recon_mean"))


@query(base_sql(f"{CV_SQL} SELECT {_out('shrink;cut;recon_mean:recon_mean')} FROM cv ORDER BY round(cv.recon_mean, 9), shrink, cut LIMIT 5"))
def top5(spark, sf):
    return selection.best(cv(spark, sf), PARAMS, "recon_mean", 5).select(*PARAMS, r6("recon_mean").alias("recon_mean"))


@query(base_sql(f"{CV_SQL} SELECT {_out('shrink;cut;recon_mean:recon_mean')} FROM cv ORDER BY round(cv.recon_mean, 9), shrink, cut LIMIT 10"))
def cv_table_head(spark, sf):
    """The ten best combinations, as the case study shows its table."""
    return selection.best(cv(spark, sf), PARAMS, "recon_mean", 10).select(*PARAMS, r6("recon_mean").alias("recon_mean"))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer GROUP BY ALL HAVING count(*) >= 12)")
def small_group_filter(spark, sf):
    return selection.large_groups(load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], 12)


@query(base_sql(f"{RECON_SQL}, k AS (SELECT DISTINCT subject_id, m FROM mom) SELECT round(sum(e * m) / sum(m), 6) + 0.0 AS mean FROM rec JOIN k USING (subject_id)"))
def weighted_mean(spark, sf):
    rows = weights(spark, sf).withColumn("e", errors.reconstruction(F.col("w"), F.col("s"), D))
    return selection.weighted_mean(rows, "e", "m", "mean").select(r6("mean").alias("mean"))


@query(f"WITH {REGION} SELECT label, count(*)::BIGINT AS n, round(sum(s_acctbal), 2) + 0.0 AS total, string_agg(subject_id, ',' ORDER BY subject_id) AS members FROM reg GROUP BY label")
def cluster_summary(spark, sf):
    members = F.array_join(F.transform(F.sort_array(F.collect_list("subject_id")), lambda x: x.cast("string")), ",")
    return regions(spark, sf).groupBy("label").agg(F.count("*").alias("n"), (F.round(F.sum("s_acctbal"), 2) + F.lit(0.0)).alias("total"), members.alias("members"))


SCORES_SQL = "SELECT c_mktsegment AS stimulus, c_nationkey::INT AS k, avg(c_acctbal) AS score FROM customer GROUP BY ALL"


@query(f"SELECT stimulus, min(k) AS k FROM (SELECT *, max(score) OVER (PARTITION BY stimulus) AS top FROM ({SCORES_SQL})) WHERE score >= (1 - 0.1) * top GROUP BY stimulus")
def smallest_feasible_k(spark, sf):
    scores = load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("stimulus"), F.col("c_nationkey").cast("int").alias("k")).agg(F.avg("c_acctbal").alias("score"))
    return selection.smallest_feasible(scores, ["stimulus"], "k", "score", 0.1)


@query("WITH h AS (SELECT s_acctbal::DOUBLE AS h, lag(s_acctbal::DOUBLE) OVER (ORDER BY s_acctbal) AS p, row_number() OVER (ORDER BY s_acctbal) AS r, count(*) OVER () AS n FROM supplier) SELECT round((h + p) / 2, 6) + 0.0 AS cut FROM h WHERE p IS NOT NULL ORDER BY (r = 2 OR r = n) AND n > 3, h - p DESC, r LIMIT 1")
def largest_jump(spark, sf):
    return selection.largest_jump(load(spark, sf, "supplier").select(F.col("s_acctbal").cast("double").alias("height"))).select(r6("cut").alias("cut"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, avg(list_distance(a.x, b.x)) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
v AS (SELECT id, max(CASE WHEN own = other THEN m END) AS a, min(CASE WHEN own <> other THEN m END) AS b FROM d GROUP BY id)
SELECT vec_id AS id, round(coalesce((b - a) / greatest(a, b), 0.0), 6) + 0.0 AS silhouette FROM e LEFT JOIN v ON v.id = vec_id""")
def silhouette_exact(spark, sf):
    points = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    return selection.silhouette(points).select("id", r6("silhouette").alias("silhouette"))


# What fits: no SQL, so the tests hold these against optimality conditions and known graphs.
FIT = K.Settings(l1=0.01, l2=0.001, tau=0.1, rho1=0.1, rho2=0.05, max_dc=10, max_admm=15)
BETA = 0.01


@query()
def warm_start_lasso(spark, sf):
    return fit.warm_start(stats(spark, sf), D, BETA)


@query()
def notears_pooled(spark, sf):
    return fit.notears_pooled(stats(spark, sf), D, BETA)


@query()
def notears_individual(spark, sf):
    return fit.notears_individual(stats(spark, sf), D, BETA)


@query()
def notears_cluster(spark, sf):
    return fit.notears_cluster(stats(spark, sf).join(regions(spark, sf), "subject_id"), D, BETA)


@query()
def notears_logistic(spark, sf):
    signs = obs(spark, sf, ranked=False).withColumn("x", F.transform("x", lambda v: F.when(v > 0, 1.0).otherwise(0.0)))
    return fit.notears_rows(signs, D, 0.01, "logistic")


@query()
def tune_population(spark, sf):
    return fit.tune_notears(spark, by_fold(spark, sf), D, [1e-4, 1e-3, 0.01, 0.1])


@query()
def tune_individual(spark, sf):
    return fit.best_alpha(fit.tune_notears(spark, by_fold(spark, sf), D, [1e-4, 1e-3, 0.01, 0.1], "subject_id"), shared=True)


@query()
def tune_oracle(spark, sf):
    keyed = by_fold(spark, sf).join(regions(spark, sf).select("subject_id", "label"), "subject_id")
    return fit.best_alpha(fit.tune_notears(spark, keyed, D, [1e-4, 1e-3, 0.01, 0.1], "label"), shared=False)


@query()
def complete_linkage(spark, sf):
    return linkage.complete(weights(spark, sf), "subject_id", "w", TAU)


@query()
def complete_linkage_jump(spark, sf):
    return linkage.complete(weights(spark, sf), "subject_id", "w", None)


@query()
def two_step(spark, sf):
    return fit.two_step(spark, stats(spark, sf), D, BETA, TAU)[0]


@query()
def dc_admm_fit(spark, sf):
    return fit.fit_groups(spark, stats(spark, sf), D, FIT)


@query()
def dc_admm_trace(spark, sf):
    return fit.fit_trace(spark, stats(spark, sf), D, FIT)


@query()
def cv_grid_dc_admm(spark, sf):
    """All three criteria over the grid of the published experiment."""
    grid = selection.param_grid(spark, {"lambda1": [1e-4, 1e-3, 0.01, 0.1], "lambda2": [0.01, 1e-3, 1e-4, 1e-5], "tau": [0.05, 0.1, 0.4, 0.7], "rho1": [0.1], "rho2": [0.05]})
    how = K.Settings(max_dc=10, max_admm=15)
    return fit.cross_validate(spark, by_fold(spark, sf), D, grid, how, ("recon", "mle", "cov"))


@query()
def simulated_moments(spark, sf):
    drawn, truth, _ = simulate.simulate(spark, 50, 300, 5, (0.6, 0.4), (5, 5), 1.0, 0)
    rows = moments.additive(drawn, 5, "subject_id").withColumn("s", moments.second_moment()).join(truth, "subject_id")
    return cells(rows, "s", "subject_id", "label", d=5)


@query()
def precluster_silhouettes(spark, sf):
    points = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("stimulus"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_custkey").cast("double").alias("key"))
    return preclusters.silhouettes(points, ["balance", "nation", "key"], list(range(2, 11)), starts=50)


# Checks of fits that SQL can state: it has the rows, the query what holds of them.
def optimal(spark, sf):
    """(subject_id, optimal): whether no entry of the warm start can move to lessen its objective (to 1e-3)."""
    rows = stats(spark, sf).select("subject_id", moments.second_moment().alias("s"))
    found = experiments.as_matrices(fit.warm_start(stats(spark, sf), D, BETA), D, "subject_id")
    both = rows.join(found, "subject_id")
    slope = M.matmul(F.col("s"), M.times(M.residual(F.col("w"), D), -1.0), D)
    apart = F.zip_with("w", "slope", lambda w, g: F.when(w > 0, F.abs(g + BETA)).when(w < 0, F.abs(g - BETA)).otherwise(F.greatest(F.abs(g) - BETA, F.lit(0.0))))
    worst = F.array_max(M.zero_diagonal(F.col("apart"), D))
    return both.withColumn("slope", slope).withColumn("apart", apart).select("subject_id", (worst < 1e-3).alias("optimal"))


@query("SELECT DISTINCT l_suppkey AS subject_id, true AS optimal FROM lineitem")
def lasso_is_optimal(spark, sf):
    return optimal(spark, sf)


@query("SELECT DISTINCT l_suppkey AS subject_id, true AS acyclic FROM lineitem")
def notears_is_acyclic(spark, sf):
    found = experiments.as_matrices(fit.notears_individual(stats(spark, sf), D, BETA), D, "subject_id")
    return found.select("subject_id", (M.acyclicity(F.col("w"), D) < 1e-7).alias("acyclic"))


@query("SELECT DISTINCT l_suppkey AS subject_id, true AS acyclic, true AS allowed FROM lineitem")
def notears_constrained(spark, sf):
    """No edge from the first variable to the second, none into the last."""
    banned = spark.createDataFrame([(0, 1), (None, D - 1)], "src int, dst int")
    found = experiments.as_matrices(fit.notears_constrained(stats(spark, sf), D, BETA, banned), D, "subject_id")
    into_last = [F.get("w", F.lit(a * D + D - 1)) for a in range(D)]
    allowed = F.get("w", F.lit(1)) == 0
    for w in into_last:
        allowed = allowed & (w == 0)
    return found.select("subject_id", (M.acyclicity(F.col("w"), D) < 1e-7).alias("acyclic"), allowed.alias("allowed"))


@query("SELECT count(DISTINCT l_suppkey)::BIGINT AS n, true AS within, true AS apart FROM lineitem")
def linkage_is_complete(spark, sf):
    """Members of a group are within the cut, and of any two groups some members aren't."""
    own = written_weights(spark, sf)
    found = written(linkage.complete(own, "subject_id", "w", TAU), "labels")
    members = own.where(linkage.is_sound("w")).join(found, own["subject_id"] == found["id"]).select(F.col("label").cast("long").alias("key"), F.col("w").alias("x"))
    within = linkage.widths(members).agg(F.coalesce(F.bool_and(F.col("width") <= TAU), F.lit(True)).alias("within"))
    apart = linkage.nearest(members).agg(F.coalesce(F.bool_and(F.col("dist") > TAU), F.lit(True)).alias("apart"))
    held = within.crossJoin(F.broadcast(apart))  # one row
    return found.agg(F.count("*").alias("n")).crossJoin(F.broadcast(held))  # one row


KINDS = ("ER", "SF", "BP", "UR")


@query(f"SELECT kind, seed::INT AS seed, true AS acyclic, true AS weighted, CASE WHEN kind = 'UR' THEN 5::BIGINT ELSE -1::BIGINT END AS edges FROM (SELECT unnest({list(KINDS)}) AS kind), range(20) r(seed)")
def random_graphs(spark, sf):
    """Graphs of each kind: no cycle, weights of 0.2 to 0.5 either way, and of one kind a fixed number of edges."""
    rows = [(kind, seed, simulate.random_graph(kind, 5, 5, seed).ravel().tolist()) for kind in KINDS for seed in range(20)]
    graphs = spark.createDataFrame(rows, "kind string, seed int, w array<double>")
    edges = F.filter("w", lambda x: x != 0)
    return graphs.select("kind", "seed", (M.acyclicity(F.col("w"), 5) == 0).alias("acyclic"), F.forall(edges, lambda x: F.abs(x).between(0.2, 0.5)).alias("weighted"), F.when(F.col("kind") == "UR", F.size(edges).cast("long")).otherwise(F.lit(-1).cast("long")).alias("edges"))


SHUFFLE_SEED = 7


def _shuffled_sql() -> str:
    """The rounds of the permutation in turn, one after the other over (subject_id, obs_idx, m, x)."""
    draw = np.random.RandomState(SHUFFLE_SEED)
    key, a, b, c = ([int(v) for v in draw.randint(1, folds.PRIME, folds.ROUNDS)] for _ in range(4))
    values = ", ".join(f"({r}::INT, {key[r]}::BIGINT, {a[r]}::BIGINT, {b[r]}::BIGINT, {c[r]}::BIGINT)" for r in range(folds.ROUNDS))
    return f"""rounds(n, k, a, b, c) AS (VALUES {values}),
walk(subject_id, obs_idx, m, n, x) AS (SELECT subject_id, obs_idx, m, 0, obs_idx::BIGINT FROM obs UNION ALL
  SELECT subject_id, obs_idx, m, n + 1, CASE WHEN (l * l + c * l) % {folds.PRIME} % 2 = 1 THEN y ELSE x END FROM (
    SELECT subject_id, obs_idx, m, w.n, x, c, ((k - x) % m + m) % m AS y, (greatest(x, ((k - x) % m + m) % m) * a + b) % {folds.PRIME} AS l FROM walk w JOIN rounds r ON r.n = w.n)),
f AS (SELECT subject_id, obs_idx, m, x FROM walk WHERE n = {folds.ROUNDS})"""


@query(base_sql(f"{_shuffled_sql()} SELECT subject_id, obs_idx, (CASE WHEN x < (m % {FOLDS}) * (m // {FOLDS} + 1) THEN x // (m // {FOLDS} + 1) ELSE m % {FOLDS} + (x - (m % {FOLDS}) * (m // {FOLDS} + 1)) // (m // {FOLDS}) END)::INT AS fold FROM f", True))
def kfold_shuffled(spark, sf):
    """The fold of every row."""
    return folds.with_shuffled_folds(obs(spark, sf), FOLDS, SHUFFLE_SEED).select("subject_id", "obs_idx", "fold")


@query(base_sql(f"{CV_SQL} SELECT shrink AS alpha, round(avg(round(recon_mean, 9)), 6) + 0.0 AS error FROM cv GROUP BY shrink ORDER BY avg(round(recon_mean, 9)), shrink LIMIT 1"))
def best_alpha(spark, sf):
    """The choice of a penalty from a table of errors."""
    table = cv(spark, sf).select(F.col("shrink").alias("alpha"), (F.col("shrink") * 4).cast("int").alias("position"), F.col("recon_mean").alias("error"))
    return fit.best_alpha(table, shared=True).select("alpha", r6("error").alias("error"))


@query(base_sql(f"{MLE_SQL} SELECT round(avg(m * {D} / 2.0 * ln(t) + 0.5 * ln(m) * nz), 6) + 0.0 AS penalized_error FROM t JOIN nz USING (subject_id) WHERE t > 0 AND m >= 2"))
def mean_penalized_mle(spark, sf):
    return experiments.mean_error(stats(spark, sf), weights(spark, sf), D, "mle", "penalized_error").select(r6("penalized_error").alias("penalized_error"))


@query(base_sql(f"{COV_SQL} SELECT round(avg(e), 6) + 0.0 AS cov_error FROM (SELECT subject_id, sqrt(sum((v - c) * (v - c))) AS e FROM mc JOIN s USING (subject_id, a, b) GROUP BY subject_id)"))
def mean_covariance_error(spark, sf):
    return experiments.mean_error(stats(spark, sf), weights(spark, sf), D, "cov", "cov_error").select(r6("cov_error").alias("cov_error"))


@query(base_sql(f"""{PAIR_SQL}, x AS (SELECT np, nd, np < {TAU} AND (SELECT max(np) FROM nm) >= 1e-12 AS fused FROM nm)
SELECT round(avg(fused::INT), 6) + 0.0 AS frac_fused, round(coalesce(avg((nd <= {L2 / RHO2})::INT) FILTER (WHERE fused), 0.0), 6) + 0.0 AS frac_zero, round(median(np), 6) + 0.0 AS median_previous, round(median(nd), 6) + 0.0 AS median_difference FROM x"""))
def fusion_diagnostics(spark, sf):
    known = written_weights(spark, sf)

    def norms(first, second):
        return pairs.apart(first["w"], second["w"]), pairs.apart(first["w"] - 0.1 * first["s"], second["w"] - 0.1 * second["s"])

    widest = [pairs.reach(known, "w", D * D), pairs.reach(known.select(M.minus(F.col("w"), M.times(F.col("s"), 0.1)).alias("v")), "v", D * D)]
    out = experiments.pair_diagnostics(known, "subject_id", ["w", "s"], norms, widest, TAU, L2 / RHO2, whole=True)
    return out.select(*(r6(c).alias(c) for c in out.columns))


_graph_part = ", ".join(f"{m} AS graph_{m}" for m in graph_metrics.METRICS)
_labels_part = AGREE_SQL.replace("FROM supplier JOIN nation ON s_nationkey = n_nationkey", "FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")


@query(f"""SELECT * FROM (SELECT {_graph_part} FROM ({_graph_sql([0.01], 'threshold', True)})),
({base_sql(f'''{REGION}, tv AS (SELECT label, a, b, avg(w) AS v FROM w JOIN reg USING (subject_id) GROUP BY ALL), q AS (SELECT subject_id, reg.label, tv.a, tv.b, (CASE WHEN tv.a = tv.b THEN 1.0 ELSE 0.0 END) - v AS r FROM reg JOIN tv USING (label)),
e AS (SELECT x.subject_id, sum(x.r * s.s * y.r) AS e FROM q x JOIN s ON s.subject_id = x.subject_id AND s.a = x.a JOIN q y ON y.subject_id = x.subject_id AND y.a = s.b AND y.b = x.b GROUP BY x.subject_id) SELECT round(avg(e), 6) + 0.0 AS recon_error_true FROM e''')}),
({ORACLES['recon_error_total'].replace('AS recon_error FROM', 'AS recon_error_est FROM')}),
({_labels_part} SELECT round((k2 - ta * pb / (n * (n - 1) / 2)) / ((ta + pb) / 2 - ta * pb / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM n, e),
({_labels_part} SELECT round((mi - emi) / ((ht + hp) / 2 - emi), 6) + 0.0 AS ami, round(mi / ht, 6) + 0.0 AS homogeneity, round(mi / hp, 6) + 0.0 AS completeness, round(2 * mi / (ht + hp), 6) + 0.0 AS v_measure, (SELECT count(*) FROM t)::BIGINT AS n_true, (SELECT count(*) FROM p)::BIGINT AS n_pred FROM h, m)""")
def evaluation(spark, sf):
    """All scores of a result in one row: regions' mean matrices as the truth, own matrices and balance classes as the result."""
    own = labelled(spark, sf)
    truth = own.select("subject_id", "label").join(selection.consensus(own, D, None, None), "label")
    found = own.select("subject_id", F.floor(F.col("s_acctbal") / 2500).cast("int").alias("label"), "w")
    out = experiments.evaluation(found, truth, stats(spark, sf), D)
    whole = ("n_true", "n_pred")
    return out.select(*(F.col(c) if c in whole else r6(c).alias(c) for c in out.columns))


def simulated(spark: SparkSession, shares: tuple[float, ...], shuffled: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stats, by fold, truth) of the published simulation: 50 subjects, 300 rows, 5 variables, seed 0."""
    drawn, labels, centers = simulate.simulate(spark, 50, 300, 5, shares, (5,) * len(shares), 1.0, 0)
    folded = folds.with_shuffled_folds(drawn, FOLDS, 0) if shuffled else folds.with_contiguous_folds(drawn, FOLDS)
    return moments.additive(drawn, 5, "subject_id"), moments.additive(folded, 5, "subject_id", "fold"), labels.join(centers, "label")


EXAMPLE_GRID = {"lambda1": [0.01, 0.1], "lambda2": [0.001, 0.0001], "tau": [0.4, 0.7], "rho1": [0.1], "rho2": [0.05]}


def experiment_scores(spark, sf):
    """Every method on the published example, its grid of eight combinations: a row a method."""
    own, by_fold_, truth = simulated(spark, (0.6, 0.4), True)
    return experiments.run(spark, own, by_fold_, truth, 5, selection.param_grid(spark, EXAMPLE_GRID), [1e-4, 1e-3, 0.01, 0.1]).scores


def experiment_by_criterion(spark, sf):
    """Three groups, three criteria: the threshold sweep of each criterion's refit."""
    own, by_fold_, truth = simulated(spark, (0.4, 0.4, 0.2), False)
    return experiments.run(spark, own, by_fold_, truth, 5, selection.param_grid(spark, EXAMPLE_GRID), [], ("dag_dc_admm",), ("recon", "mle", "cov")).sweeps


@query()
def cv_grid_jump_cut(spark, sf):
    """The case study's variant: trees cut at the largest jump, group means as they are."""
    how = K.Settings(max_dc=10, max_admm=15, cut="jump", digits=None, zero_diagonal=True, threshold_subjects=False)
    grid = selection.param_grid(spark, {"lambda1": [0.1], "lambda2": [1e-4, 1e-3], "tau": [0.1, 3.5], "rho1": [0.1], "rho2": [0.05]})
    return selection.cv_table(fit.cross_validate(spark, by_fold(spark, sf), D, grid, how), experiments.PARAMS, "recon_error", "recon_mean")


@query()
def preclusters_assigned(spark, sf):
    """Cells with their precluster, of those with 20 cells or more."""
    points = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("stimulus"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.col("c_custkey").cast("double").alias("key"))
    return preclusters.preclusters(points, ["balance", "nation", "key"], ks=[2, 3, 4, 5], starts=10)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """One graph for each group of subjects: (subject_id, label, src, dst, weight)."""
    return fit.fit_groups(spark, stats(spark, sf), D, FIT)
