"""Agreement of two labellings, from their contingency counts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(labels: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) from rows with y_true and y_pred."""
    return labels.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def _margins(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (cells.groupBy("y_true").agg(F.sum("n").alias("a")), cells.groupBy("y_pred").agg(F.sum("n").alias("b")))


def log_factorial(k: Column) -> Column:
    """ln k!, to about 14 digits: Stirling's series eight places on, where it is that good for any k."""
    z = k.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - reduce(lambda a, b: a + b, (F.log(z - m) for m in range(1, 9)))


def _beyond_powers(x: Column) -> Column:
    """ln x! - x ln x + x, which stays small: from a series where that is good, else from ln x!."""
    z = F.greatest(x.cast("double"), F.lit(16.0))
    series = 0.5 * F.log(2 * math.pi * z) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return F.when(x == 0, 0.0).when(x < 16, log_factorial(x) - x * F.log(x.cast("double")) + x).otherwise(series)


def chance_of(a: Column, b: Column, n: Column, k: Column) -> Column:
    """The probability of k common members of two random sets of a and b out of n.

    The powers of the nine factorials make the divergence of the four cells from their expectations,
    so no numbers of the size of ln n! are subtracted and digits hold for any n.
    """
    n_ = n.cast("double")
    off = k - a * b.cast("double") / n_
    cells = [(k, a, b, 1), (a - k, a, n - b, -1), (b - k, n - a, b, -1), (n - a - b + k, n - a, n - b, 1)]

    def apart(cell: Column, row: Column, col: Column, sign: int) -> Column:
        expected = row * col.cast("double") / n_
        return F.when(expected == 0, 0.0).when(cell == 0, expected).otherwise(cell * F.log1p(sign * off / expected) - sign * off)

    total = lambda terms: reduce(lambda x, y: x + y, terms)
    return F.exp(total(map(_beyond_powers, (a, b, n - a, n - b))) - _beyond_powers(n) - total(_beyond_powers(c[0]) + apart(*c) for c in cells))


#: Overlaps of a row of work. Beyond sqrt(30 min(a, b)) from the mean, Hoeffding's bound leaves less than exp(-60) of the chance.
OVERLAPS, TAIL = 4096, 30


def overlaps(sizes: DataFrame) -> DataFrame:
    """sizes (a, b, n and more), a row for each overlap k > 0 that chance could give, but for tails that don't count.

    Stretches of overlaps are shuffled before they are written out, so large clusters are many tasks' work.
    """
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    mean, reach = a * b.cast("double") / n, F.sqrt(F.least(a, b).cast("double") * TAIL) + 1
    low = F.greatest(F.lit(1).cast("long"), a + b - n, F.floor(mean - reach))
    high = F.least(a, b, F.ceil(mean + reach))
    pieces = sizes.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("start", F.explode(F.sequence("low", "high", F.lit(OVERLAPS).cast("long"))))
    spread = pieces.repartition(F.col("a"), F.col("b"), F.col("start"))
    return spread.withColumn("k", F.explode(F.sequence("start", F.least(F.col("high"), F.col("start") + OVERLAPS - 1)))).drop("low", "high", "start")


def agreement(labels: DataFrame) -> DataFrame:
    """agreement_of the labels' contingency table, for rows with y_true and y_pred."""
    return agreement_of(contingency(labels))


def agreement_of(cells: DataFrame) -> DataFrame:
    """One row: ari, ami (arithmetic mean of entropies), homogeneity, completeness, v_measure, n_true, n_pred.

    cells: (y_true, y_pred, n). The expected mutual information sums, for each pair of cluster sizes, over
    the overlaps that chance could give; equal pairs of sizes are summed once.
    """
    true, pred = _margins(cells)
    pick = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    whole = cells.agg(F.sum("n").alias("n"), F.sum(pick("n")).alias("both"))
    t = true.agg(F.sum(pick("a")).alias("ta"), F.count("*").alias("n_true"))
    p = pred.agg(F.sum(pick("b")).alias("pb"), F.count("*").alias("n_pred"))
    one = whole.crossJoin(t).crossJoin(p)

    entropy = lambda frame, c, name: frame.crossJoin(whole.select("n")).agg((-F.sum(F.col(c) / F.col("n") * F.log(F.col(c) / F.col("n")))).alias(name))
    joint = cells.withColumnRenamed("n", "k").join(true, "y_true").join(pred, "y_pred").crossJoin(whole.select("n"))
    information = joint.agg(F.sum(F.col("k") / F.col("n") * F.log(F.col("n").cast("double") * F.col("k") / (F.col("a").cast("double") * F.col("b")))).alias("mi"))

    sizes = true.groupBy("a").agg(F.count("*").alias("ca")).crossJoin(pred.groupBy("b").agg(F.count("*").alias("cb"))).crossJoin(whole.select("n"))
    a, b, n, k = F.col("a"), F.col("b"), F.col("n"), F.col("k")
    term = F.col("ca") * F.col("cb") * k / n * F.log(n.cast("double") * k / (a.cast("double") * b)) * chance_of(a, b, n, k)
    expected = overlaps(sizes).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("emi"))

    row = one.crossJoin(entropy(true, "a", "ht")).crossJoin(entropy(pred, "b", "hp")).crossJoin(information).crossJoin(expected)
    c = F.col
    by_chance = c("ta") * c("pb") / (c("n").cast("double") * (c("n") - 1) / 2)
    span = (c("ta") + c("pb")) / 2 - by_chance
    middle = (c("ht") + c("hp")) / 2 - c("emi")
    row = row.withColumn("homogeneity", F.when(c("ht") > 0, c("mi") / c("ht")).otherwise(1.0)).withColumn("completeness", F.when(c("hp") > 0, c("mi") / c("hp")).otherwise(1.0))
    v = F.when(c("homogeneity") + c("completeness") > 0, 2 * c("homogeneity") * c("completeness") / (c("homogeneity") + c("completeness"))).otherwise(0.0)
    return row.select(F.when(span == 0, 1.0).otherwise((c("both") - by_chance) / span).alias("ari"), F.when(F.abs(middle) < 1e-15, 1.0).otherwise((c("mi") - c("emi")) / middle).alias("ami"), "homogeneity", "completeness", v.alias("v_measure"), "n_true", "n_pred")
