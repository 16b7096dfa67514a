"""Whole experiments on small simulations, sinks, and fits with constraints."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import kernels as K
from thicket.operators import folds, moments, pairs, selection
from thicket.plans import experiments, fit
from thicket.sources import files, simulate


@pytest.fixture(scope="module")
def small(spark):
    obs, labels, centers = simulate.simulate(spark, 6, 40, 3, (0.5, 0.5), (2, 2), 0.5, 0)
    folded = folds.with_shuffled_folds(obs, 2, 0)
    return moments.additive(obs, 3, "subject_id").persist(), moments.additive(folded, 3, "subject_id", "fold").persist(), labels.join(centers, "label").persist()


def test_an_experiment_scores_every_method(spark, small, tmp_path):
    stats, by_fold, truth = small
    grid = selection.param_grid(spark, {"lambda1": [0.01], "lambda2": [0.001], "tau": [0.4], "rho1": [0.1], "rho2": [0.05]})
    out = experiments.run(spark, stats, by_fold, truth, 3, grid, [0.001, 0.1], criteria=("recon", "mle"), how=K.Settings(max_dc=2, max_admm=3))
    rows = {(r.method, r.criterion): r for r in out.scores.collect()}
    assert set(rows) == {("dag_dc_admm", "recon"), ("dag_dc_admm", "mle"), *((m, "recon") for m in experiments.METHODS[1:])}
    assert rows["pooled", "recon"].n_pred == 1 and rows["individual", "recon"].n_pred == 6 and rows["oracle", "recon"].ari == 1
    assert len({round(r.recon_error_true, 9) for r in rows.values()}) == 1
    assert json.loads(rows["dag_dc_admm", "mle"].params)["tau"] == 0.4
    groups = out.groups.where("method = 'oracle'")
    assert groups.count() == 6 and groups.select("w").distinct().count() == 2
    assert [r.place for r in experiments.top(out.cv, ("recon", "mle")).where("criterion = 'mle'").collect()] == [1]
    stored = experiments.artifacts(groups, 3, {"tau": 0.7}).collect()[0]
    assert (stored.meta.n, stored.meta.d, stored.meta.k) == (6, 3, 2) and stored.params == {"tau": 0.7}
    assert sorted(s for g in stored.groups for s in g.members) == [s.subject_id for s in stored.subjects] == list(range(6))
    files.write_summary(spark, str(tmp_path / "s"), {"a": np.float64(1.5), "b": [np.int64(2)]})
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "s")).collect())) == {"a": 1.5, "b": [2]}
    with pytest.raises(ValueError, match="unknown methods"):
        experiments.run(spark, stats, by_fold, truth, 3, grid, [0.1], ("nothing",))


def test_errors_of_no_subject_are_an_error(spark, small):
    stats, _, truth = small
    assert np.isfinite(experiments.mean_error(stats, truth, 3, "cov", "e").head().e)
    with pytest.raises(Exception, match="no subject has a mle error"):
        experiments.mean_error(stats.withColumn("m", F.lit(1).cast("long")), truth, 3, "mle", "e").collect()


def test_constraints_hold(spark, small):
    stats, _, _ = small
    w = experiments.as_matrices(fit.notears_constrained(stats, 3, 0.001, spark.createDataFrame([(0, 1), (2, None)], "src int, dst int")), 3, "subject_id").collect()
    assert len(w) == 6 and all(r.w[1] == 0 and r.w[6] == r.w[7] == r.w[8] == 0 for r in w)
    with pytest.raises(ValueError, match="isn't one of 3"):
        fit.notears_constrained(stats, 3, 0.001, spark.createDataFrame([(0, 7)], "src int, dst int"))


def test_linkage_keeps_single_subjects_and_any_key(spark):
    one = spark.createDataFrame([("a", [1.0, 2.0])], "k string, w array<double>")
    apart = pairs.pair_rows(one, "k", "w").select("i", "j", pairs.distance(F.col("w_i"), F.col("w_j")).alias("dist"))
    assert [tuple(r) for r in fit.linkage(apart, 1.0, one.select("k")).collect()] == [("a", 1)]


def test_pairs_meet_once_in_any_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 3)
    frame = spark.range(40).selectExpr("id * 7 % 41 AS k", "id AS v")
    got = sorted(tuple(r) for r in pairs.pair_rows(frame, "k", "v").collect())
    value = {r.k: r.v for r in frame.collect()}
    assert got == sorted((a, b, value[a], value[b]) for a in value for b in value if a < b)


def test_group_values_keep_null_groups_and_numeric_columns(spark):
    frame = spark.createDataFrame([(None, 1.0, "x"), (None, 3.0, "y"), ("a", None, "z"), ("a", 5.0, "z")], "g string, v double, t string")
    got = moments.mean_imputed(frame, ["v"], "g").orderBy("v").collect()
    assert [r.v for r in got] == [1.0, 3.0, 5.0, 5.0]
    scores = sorted(r.v for r in moments.zscore(frame, ["v"], "g").collect())
    assert np.allclose(scores, [-(0.5**0.5), 0, 0, 0.5**0.5])
    assert moments.numeric_columns(frame) == ["v"]


def test_fusion_diagnostics(spark):
    norms = spark.createDataFrame([(0.0, 0.0), (0.2, 0.05), (0.5, 0.4), (0.05, 0.3)], "previous double, difference double")
    row = experiments.fusion_diagnostics(norms, 0.1, 0.1).head()
    assert (row.frac_fused, row.frac_zero, row.median_previous) == (0.5, 0.5, 0.125)
    assert experiments.fusion_diagnostics(norms.limit(0), 0.1, 0.1).count() == 1
