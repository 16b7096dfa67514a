import numpy as np
import pytest
from pyspark.sql import functions as F
from thicket.functions import kernels as K
from thicket.operators import blocks, selection
from thicket.plans import fit


@pytest.fixture(scope="module")
def stats(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(9):
        x = rng.normal(size=(80, 3))
        x[:, 1] += (0.9 if i % 2 else 0.1) * x[:, 0]
        x[:, 2] += 0.5 * x[:, 1]
        rows.append((i, 80, x.sum(axis=0).tolist(), (x.T @ x).ravel().tolist()))
    return spark.createDataFrame(rows, "subject_id long, m long, sum array<double>, xtx array<double>").persist()


@pytest.mark.parametrize("how", [K.Settings(l1=0.01, l2=0.02, tau=0.4, rho2=0.05, max_dc=1, max_admm=6), K.Settings(l1=0.01, l2=0.3, tau=0.6, rho2=0.4, max_dc=2, max_admm=2, cut="jump", digits=None)])
def test_fits_beyond_one_task_are_those_of_one_task(spark, monkeypatch, stats, how):
    few = fit.fit_groups(spark, stats, 3, how).orderBy("subject_id", "src", "dst").toPandas()
    trace = fit.fit_trace(spark, stats, 3, how).toPandas()
    monkeypatch.setattr(fit, "MOST_NUMBERS", 18)  # two subjects
    monkeypatch.setattr(blocks, "LEAST_BLOCKS", 2)
    many = fit.fit_groups(spark, stats, 3, how).orderBy("subject_id", "src", "dst").toPandas()
    assert many[["subject_id", "label", "src", "dst"]].equals(few[["subject_id", "label", "src", "dst"]])
    assert np.allclose(many["weight"], few["weight"], atol=1e-6)
    if how.cut == "jump":
        assert np.allclose(fit.fit_trace(spark, stats, 3, how).toPandas(), trace, rtol=1e-4, atol=1e-6)


def test_grid_beyond_one_task_has_the_errors_of_one_task(spark, monkeypatch, stats):
    by_fold = stats.select("subject_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), "m", "sum", F.transform("xtx", lambda v: v * (1 + F.col("subject_id") / 50)).alias("xtx"))
    grid = selection.param_grid(spark, {"lambda1": [0.01], "lambda2": [0.02], "tau": [0.4], "rho1": [0.1], "rho2": [0.05]})
    ask = lambda: fit.cross_validate(spark, by_fold, 3, grid, K.Settings(max_dc=1, max_admm=1), ("recon", "mle", "cov")).orderBy("fold").toPandas()
    few = ask()
    monkeypatch.setattr(fit, "MOST_NUMBERS", 18)
    monkeypatch.setattr(blocks, "LEAST_BLOCKS", 2)
    many = ask()
    assert list(many.columns) == list(few.columns) and len(many) == 2
    assert np.allclose(many, few, atol=1e-5)
