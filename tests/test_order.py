"""Order statistics, steps and chance overlaps against plain versions, at sizes that take every branch."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import clustering, order, pairs, selection
from thicket.plans import experiments


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_quantile_equals_percentile(spark, share):
    rng = np.random.default_rng(1)
    mixed = [*rng.standard_cauchy(1500), *[0.5] * 900, *[0.75] * 700, -math.inf, math.inf, *rng.normal(0, 1e-9, 500)]
    rows = column(spark, [*map(float, mixed), None, None])
    ordered, place = sorted(map(float, mixed)), (len(mixed) - 1) * share
    low, high, part = ordered[math.floor(place)], ordered[math.ceil(place)], place % 1
    want = low if low == high else (1 - part) * low + part * high
    assert order.quantile(rows, F.col("v"), share, few=40) == pytest.approx(want, rel=1e-12)


def test_quantile_of_ties_nan_and_nothing(spark):
    halves = column(spark, [1.0] * 300 + [2.0] * 300)
    assert order.quantile(halves, F.col("v"), 0.5, few=10) == 1.5
    assert order.quantile(halves, F.col("v"), 0.49, few=10) == 1.0
    assert order.quantile(column(spark, [3.0] * 100), F.col("v"), 0.9, few=5) == 3.0
    assert order.quantile(column(spark, [None]), F.col("v"), 0.5) is None
    with_nan = column(spark, [1.0, 2.0, math.nan])
    assert order.quantile(with_nan, F.col("v"), 0.5) == 2.0 and math.isnan(order.quantile(with_nan, F.col("v"), 1.0))
    with pytest.raises(ValueError):
        order.quantile(halves, F.col("v"), 1.5)


def plain_cut(heights):
    h = sorted(heights)
    steps = [(len(h) > 3 and r in (1, len(h) - 1), -(h[r] - h[r - 1]), r) for r in range(1, len(h))]
    return [(h[r] + h[r - 1]) / 2 for _, _, r in sorted(steps)[:1]]


def test_largest_jump_equals_the_sorted_scan(spark):
    rng = np.random.default_rng(5)
    cases = [[], [1.0], [1.0, 4.0], [2.0, 2.0], [1.0, 2.0, 9.0], [2.0] * 3, [2.0] * 5, [1.0, 2.0, 2.0, 2.0, 3.0], [1.0, 1.0, 5.0, 5.0], [1.0, 1.0, 1.0, 7.0], [0.0, 3.0, 3.0, 9.0], [9.0, 0.0, 1.0, 4.0, 4.5]]
    cases += [[float(x) for x in rng.integers(0, 60, int(rng.integers(4, 30)))] for _ in range(4)] + [[float(x) for x in np.cumsum(rng.exponential(1, 400))]]
    for heights in cases:
        got = selection.largest_jump(spark.createDataFrame([(x,) for x in [*heights, None]], "height double"))
        assert [r.cut for r in got.collect()] == pytest.approx(plain_cut(heights)), heights


def test_chance_of_overlaps_is_exact(spark):
    def exact(a, b, n, k):
        return float(Fraction(math.comb(a, k) * math.comb(n - a, b - k), math.comb(n, b)))

    cases = [(a, b, n, k) for a, b, n in ((1, 1, 2), (3, 5, 9), (9, 9, 9), (40, 17, 60), (700, 900, 2500)) for k in {max(0, a + b - n), min(a, b), (a * b) // n}]
    rows = spark.createDataFrame(cases, "a long, b long, n long, k long")
    for r in rows.withColumn("p", clustering.chance_of(*(F.col(c) for c in "abnk"))).collect():
        assert r.p == pytest.approx(exact(r.a, r.b, r.n, r.k), rel=1e-11)


def test_chance_holds_for_clusters_of_ten_million(spark):
    sizes = spark.createDataFrame([(10**7, 2 * 10**7, 5 * 10**7), (10**7, 10**7, 10**12)], "a long, b long, n long")
    rows = clustering.overlaps(sizes).withColumn("p", clustering.chance_of(*(F.col(c) for c in "abnk")))
    got = {r.n: r for r in rows.groupBy("n").agg(F.sum("p").alias("all"), F.sum(F.col("p") * F.col("k")).alias("mean"), F.count("*").alias("rows")).collect()}
    for r, mean in ((got[5 * 10**7], 4e6), (got[10**12], 100.0)):
        assert r["all"] == pytest.approx(1, abs=1e-10) and r["mean"] == pytest.approx(mean, rel=1e-10) and r["rows"] < 40_000


def test_agreement_of_large_independent_clusters(spark):
    cells = spark.createDataFrame([(t, p, n) for t, p, n in ((0, 0, 6 * 10**6), (0, 1, 4 * 10**6), (1, 0, 12 * 10**6), (1, 1, 8 * 10**6))], "y_true int, y_pred int, n long")
    row = clustering.agreement_of(cells).head()
    # Independent labels share nothing, and chance gives about (rows - 1) (columns - 1) / 2n.
    entropy = (-sum(x * math.log(x) for x in (1 / 3, 2 / 3)) - sum(x * math.log(x) for x in (0.6, 0.4))) / 2
    assert row.ami == pytest.approx(-1 / 6e7 / entropy, rel=1e-4)
    assert row.ari == pytest.approx(0, abs=1e-6)


def test_any_apart(spark):
    def of(*rows):
        return pairs.any_apart(spark.createDataFrame(list(enumerate(rows)), "k int, w array<double>"), "k", "w", 2)

    assert of([0.0, 1.0], [0.0, 2.0]) and of([0.0, 0.0], [0.0, 1.5e-12]) and of([0.0, math.nan], [0.0, 1.0])
    assert not of([1.0, 1.0], [1.0, 1.0]) and not of([0.0, 0.0], [0.0, 0.9e-12]) and not of([0.0, 5.0])
    assert of([0.0, 0.0], [0.9e-12, 0.9e-12])
    assert not pairs.any_apart(spark.createDataFrame([], "k int, w array<double>"), "k", "w", 2)


def test_fusion_diagnostics(spark):
    rows = [(0.1, 0.05), (0.2, 0.5), (0.9, 0.01), (0.8, 0.7)]
    got = experiments.fusion_diagnostics(spark.createDataFrame(rows, "previous double, difference double"), 0.5, 0.1).head()
    assert (got.frac_fused, got.frac_zero, got.median_previous) == (0.5, 0.5, 0.5) and got.median_difference == pytest.approx(0.275)
    same = experiments.fusion_diagnostics(spark.createDataFrame([(0.0, 0.0)] * 2, "previous double, difference double"), 0.5, 0.1).head()
    assert (same.frac_fused, same.frac_zero) == (0, 0)
    none = experiments.fusion_diagnostics(spark.createDataFrame([], "previous double, difference double"), 0.5, 0.1).head()
    assert none.frac_fused is None and none.frac_zero == 0 and none.median_previous == 0
