"""Operators against DuckDB on the small tables, and their edge cases."""

import json
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from thicket.functions import matrices as M
from thicket.operators import clustering, folds, graph_metrics, moments, pairs, selection
from thicket.plans import catalogue, fit, preclusters
from thicket.sources import files, simulate

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: None if pd.isna(v) else f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, (float, np.floating)) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert len(got) > 0 or name in ("small_group_filter", "plot_edges")
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_matrix_functions(spark):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((3, 3)), rng.standard_normal((3, 3))
    w = np.triu(a, 1)
    row = one(spark, a=a.ravel().tolist(), b=b.ravel().tolist(), w=w.ravel().tolist(), odd=[float("nan"), float("inf"), float("-inf")]).select(
        M.matmul(F.col("a"), F.col("b"), 3).alias("ab"), M.transpose(F.col("a"), 3).alias("t"), M.trace(F.col("a"), 3).alias("tr"), M.frobenius(F.col("a")).alias("f"),
        M.inverse_of_residual(F.col("w"), 3).alias("inv"), M.acyclicity(F.col("w"), 3).alias("h"), M.soft_threshold(F.col("a"), 0.5).alias("soft"), M.finite(F.col("odd")).alias("odd"), M.clipped(F.col("a"), -0.1, 0.1).alias("clip"),
    ).head()
    assert np.allclose(np.reshape(row.ab, (3, 3)), a @ b)
    assert np.allclose(np.reshape(row.t, (3, 3)), a.T)
    assert math.isclose(row.tr, np.trace(a)) and math.isclose(row.f, np.linalg.norm(a))
    assert np.allclose(np.reshape(row.inv, (3, 3)), np.linalg.inv(np.eye(3) - w))
    assert row.h == 0
    assert math.isclose(np.linalg.norm(row.soft), np.linalg.norm(a) - 0.5, rel_tol=1e-9)
    assert row.odd == [0.0, 1e3, -1e3] and max(row.clip) <= 0.1


def test_zscore_handles_nulls_and_constants(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (1, None, 5.0), (1, 3.0, 5.0), (2, float("nan"), 1.0)], "g int, x double, c double")
    got = {tuple(r) for r in moments.zscore(rows, ["x", "c"], "g").select("g", F.round("x", 4), "c").collect()}
    assert got == {(1, -0.7071, 0.0), (1, 0.0, 0.0), (1, 0.7071, 0.0), (2, 0.0, 0.0)}
    filled = sorted(r.x for r in moments.mean_imputed(rows.where("g = 1"), ["x"], "g").collect())
    assert filled == [1.0, 2.0, 3.0]


def test_folds(spark):
    obs = spark.createDataFrame([(s, k, [0.0]) for s, n in ((1, 7), (2, 4)) for k in range(n)], "subject_id long, obs_idx int, x array<double>")
    sizes = {(r.subject_id, r.fold): r["count"] for r in folds.with_contiguous_folds(obs, 3).groupBy("subject_id", "fold").count().collect()}
    assert sizes == {(1, 0): 3, (1, 1): 2, (1, 2): 2, (2, 0): 2, (2, 1): 1, (2, 2): 1}
    shuffled = folds.with_shuffled_folds(obs, 3, 0).toPandas()
    assert len(shuffled) == 11 and shuffled.groupby(["subject_id", "fold"]).size().max() == 3
    with pytest.raises(Exception, match="2 rows are too few for 3 folds"):
        folds.with_shuffled_folds(obs.where("obs_idx < 2"), 3, 0).collect()
    parts = folds.split(obs, 0.99).where("part = 'test'").groupBy("subject_id").count().collect()
    assert {r.subject_id: r["count"] for r in parts} == {1: 1, 2: 1}
    # 90 * 0.7 is less than 63 in doubles.
    many = spark.range(90).selectExpr("1L as subject_id", "cast(id as int) as obs_idx", "array(0D) as x")
    assert folds.split(many, 0.7).where("part = 'train'").count() == 63


def plain_places(m: int, seed: int) -> list[int]:
    draw = np.random.RandomState(seed)
    rounds = list(zip(*([int(v) for v in draw.randint(1, folds.PRIME, folds.ROUNDS)] for _ in range(4)), strict=True))
    out = []
    for x in range(m):
        for k, a, b, c in rounds:
            y = (k - x) % m
            v = (max(x, y) * a + b) % folds.PRIME
            if (v * v + c * v) % folds.PRIME % 2:
                x = y
        out.append(x)
    return out


def test_shuffled_folds_are_permutations_of_each_subject(spark):
    lengths = {1: 3, 2: 8, 3: 101, 4: 101, 5: 5000}
    obs = spark.createDataFrame([(s, k) for s, n in lengths.items() for k in range(n)], "subject_id long, obs_idx int")
    m = F.count("*").over(Window.partitionBy("subject_id"))
    for seed in (0, 7):
        places, found = {}, {}
        for r in obs.withColumn("place", folds.permuted(F.col("obs_idx"), m, seed)).orderBy("obs_idx").collect():
            places.setdefault(r.subject_id, []).append(r.place)
        for r in folds.with_shuffled_folds(obs, 3, seed).orderBy("obs_idx").collect():
            found.setdefault(r.subject_id, []).append(r.fold)
        assert {s: sorted(p) for s, p in places.items()} == {s: list(range(n)) for s, n in lengths.items()}
        assert all(places[s] == plain_places(n, seed) for s, n in lengths.items())
        assert {s: [f.count(k) for k in range(3)] for s, f in found.items()} == {s: [n // 3 + (k < n % 3) for k in range(3)] for s, n in lengths.items()}
        assert found[3] == found[4] and found[5] != sorted(found[5])


def test_shuffled_places_are_uniform_over_seeds():
    seeds, m = 3000, 6
    rows = np.array([plain_places(m, seed) for seed in range(seeds)])
    counts = np.array([[(rows[:, x] == y).sum() for y in range(m)] for x in range(m)])
    # 25 degrees of freedom: above 60 in one case of ten thousand.
    assert ((counts - seeds / m) ** 2 / (seeds / m)).sum() < 60
    pairs_at = np.bincount(rows[:, 0] * m + rows[:, 1], minlength=m * m).reshape(m, m)
    apart = pairs_at[~np.eye(m, dtype=bool)]
    assert (np.diag(pairs_at) == 0).all() and ((apart - seeds / 30) ** 2 / (seeds / 30)).sum() < 70


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_equal_row_numbers_however_rows_are_dealt(spark, parts):
    # One subject holds most rows, so that it lies in several ranges.
    rng = np.random.default_rng(3)
    rows = [(None if s == 4 else int(s), None if v < 3 else int(v), k) for k, (s, v) in enumerate(zip(np.where(rng.random(900) < 0.8, 0, rng.integers(0, 6, 900)), rng.integers(0, 500, 900), strict=True))]
    frame = spark.createDataFrame(rows, "subject_id long, v long, k long").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = moments.ranked(frame, "subject_id", ["v", "k"])
        want = frame.withColumn("obs_idx", F.row_number().over(Window.partitionBy("subject_id").orderBy("v", "k")) - 1)
        assert dealt.columns == want.columns and dealt.schema["obs_idx"].dataType == want.schema["obs_idx"].dataType
        assert {tuple(r) for r in dealt.collect()} == {tuple(r) for r in want.collect()} and dealt.count() == 900
        # Equal rows: each place once.
        ties = moments.ranked(frame.withColumn("v", F.lit(1)), "subject_id", ["v"]).groupBy("subject_id").agg(F.count("*").alias("n"), F.countDistinct("obs_idx").alias("places"), F.min("obs_idx").alias("low"), F.max("obs_idx").alias("high"))
        assert all(r.n == r.places == r.high + 1 and r.low == 0 for r in ties.collect())
        assert moments.ranked(frame.limit(0), "subject_id", ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_graph_metrics_edge_cases(spark):
    zero, edge, back = [0.0] * 4, [0.0, 0.5, 0.0, 0.0], [0.0, 0.0, 0.5, 0.0]
    at = [0.0, 0.01, 0.0, 0.0]
    rows = spark.createDataFrame([(1, edge, zero), (2, zero, edge), (3, edge, back), (4, edge, edge), (5, at, at)], "subject_id long, w_true array<double>, w_est array<double>")
    got = {r.subject_id: r for r in graph_metrics.graph_metrics(rows, [0.01], "subject_id").collect()}
    assert got[1].dag_fdr == 1 and got[1].skeleton_fdr == 0 and got[1].dag_tpr == 0
    assert got[2].dag_tpr == 0 and got[2].dag_shd == 1
    assert got[3].dag_shd == 2 and got[3].skeleton_shd == 0
    assert got[4].dag_fdr == 0 and got[4].dag_tpr == 1 and got[4].dag_tnr == 1
    assert got[5].dag_nnz == 0


def test_agreement_edge_cases(spark):
    def of(true, pred):
        return clustering.agreement(spark.createDataFrame(list(zip(true, pred, strict=True)), "y_true int, y_pred int")).head()

    same = of([1, 1, 2, 2], [5, 5, 3, 3])
    assert math.isclose(same.ari, 1) and math.isclose(same.ami, 1) and math.isclose(same.v_measure, 1)
    single = of([1, 1, 2, 2], [1, 1, 1, 1])
    assert math.isclose(single.ari, 0, abs_tol=1e-12) and single.completeness == 1 and math.isclose(single.homogeneity, 0, abs_tol=1e-12)
    assert of([1, 1, 2, 2], [1, 2, 3, 4]).n_pred == 4


def test_theta_special_cases(spark):
    row = one(spark, d=[0.3, 0.4], n=0.0, top=0.0).select(pairs.theta(F.col("d"), F.col("n"), F.col("top"), 0.1, 1.0, 1.0).alias("t")).head()
    assert row.t == [0.3, 0.4]
    row = one(spark, d=[0.3, 0.4], n=0.5, top=0.5).select(pairs.theta(F.col("d"), F.col("n"), F.col("top"), 0.1, 1.0, 1.0).alias("t")).head()
    assert np.allclose(row.t, [0.24, 0.32])
    with pytest.raises(ValueError):
        pairs.theta(F.col("d"), F.col("n"), F.col("top"), 0.1, 0.0, 1.0)


def test_cv_table_ignores_nan_and_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(0.1, 1.0), (0.1, float("nan")), (0.2, 1.0), (0.3, float("nan"))], "p double, e double")
    table = selection.cv_table(rows, ["p"], "e", "m")
    assert {r.p: r.m for r in table.collect()} == {0.1: 1.0, 0.2: 1.0, 0.3: None}
    assert selection.best(table, ["p"], "m").head().p == 0.1


def test_pairs_meet_once(spark):
    ids = spark.range(40).select(F.col("id"), F.col("id").alias("v"))
    got = pairs.pair_rows(ids, "id", "v").select("i", "j").collect()
    assert len(got) == 780 and len({(r.i, r.j) for r in got}) == 780


def test_grouped_fit_and_baselines_find_simulated_groups(spark):
    obs, truth, _ = simulate.simulate(spark, 8, 200, 3, (0.5, 0.5), (2, 3), 0.5, 4)
    stats = moments.additive(obs, 3, "subject_id").persist()
    got = fit.fit_groups(spark, stats, 3, fit.K.Settings(l1=0.01, l2=0.01, tau=0.4, rho2=0.05, max_dc=3)).select("subject_id", "label").distinct()
    both = got.withColumnRenamed("label", "y_pred").join(truth.withColumnRenamed("label", "y_true"), "subject_id")
    assert clustering.agreement(both).head().ari > 0.5
    assert fit.notears_individual(stats, 3, 0.01).count() == 72
    assert fit.notears_pooled(stats, 3, 0.01).count() == 72
    assert fit.notears_cluster(stats.join(truth, "subject_id"), 3, 0.01).count() == 18
    labels, means = fit.two_step(spark, stats, 3, 0.01, 0.4)
    assert labels.count() == 8 and means.count() == labels.select("label").distinct().count()
    by_fold = moments.additive(folds.with_shuffled_folds(obs, 2, 0), 3, "subject_id", "fold").persist()
    grid = selection.param_grid(spark, {"lambda1": [0.01], "lambda2": [0.01], "tau": [0.4], "rho1": [0.1], "rho2": [0.05]})
    errors = fit.cross_validate(spark, by_fold, 3, grid, fit.K.Settings(max_dc=1, max_admm=3), ("recon", "mle", "cov")).toPandas()
    assert len(errors) == 2 and errors.notna().all().all()
    assert fit.best_alpha(fit.tune_notears(spark, by_fold, 3, [0.01, 0.5], "subject_id"), True).head().alpha == 0.01


def test_files_and_preclusters(spark, tmp_path):
    rng = np.random.default_rng(0)
    for k in range(2):
        rows = np.concatenate([rng.normal(c, 0.3, (40, 11)) for c in (0, 4)])
        text = "﻿" + ",".join(files.COLUMNS) + "\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n"
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8")
    cells = files.load_perturbations(spark, [f"{tmp_path}/{k}.csv" for k in range(2)])
    assert cells.columns == [*files.COLUMNS.values(), "stimulus"] and cells.count() == 160
    got = preclusters.preclusters(cells, list(files.COLUMNS.values()), ks=[2, 3], starts=2)
    assert {(r.stimulus, r["count"]) for r in got.groupBy("stimulus", "cluster").count().collect()} == {("stimulus1", 40), ("stimulus2", 40)}
    files.write_csv(spark.range(3), f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 3
    files.write_summary(spark, f"{tmp_path}/summary", {"a": np.float64(1.5), "b": [np.arange(2), {3}]})
    assert json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/summary").collect())) == {"a": 1.5, "b": [[0, 1], [3]]}


def test_perturbation_columns_go_by_name(spark, tmp_path):
    names = list(files.COLUMNS)
    turned = names[::-1]
    (tmp_path / "a.csv").write_text("\ufeff" + ",".join(turned) + "\n" + ",".join(str(names.index(c) + 0.5) for c in turned) + "\n", encoding="utf-8")
    row = files.load_perturbations(spark, [f"{tmp_path}/a.csv"]).head()
    assert [row[c] for c in files.COLUMNS.values()] == [k + 0.5 for k in range(len(names))]
    (tmp_path / "b.csv").write_text(",".join(names[1:]) + "\n" + ",".join(["1"] * 10) + "\n")
    with pytest.raises(ValueError, match=names[0]):
        files.load_perturbations(spark, [f"{tmp_path}/b.csv"])


def test_entry_runs_without_the_llm_parts(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/thicket", tmp_path / "thicket", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ask = "import __spark_entry__ as e; assert 'second_moment' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
