"""Order statistics of a column of any length: no task holds it, or its distinct values, whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are few enough to sort in one place; error of the rank sketches that narrow a column down to them.
FEW_ROWS, SKETCH_ERROR = 10_000, 0.001


def _smallest(rows: DataFrame, n: int, k: int, few: int) -> float:
    """The k-th smallest (from 0) of the n numbers v in rows.

    A sketch gives two values around the place; counts tell whether one of them stands there, else what lies
    strictly between them, a small share of the rows whatever their ties, is narrowed down again.
    """
    while n > few:
        at, e = k / n, SKETCH_ERROR
        low, high = rows.approxQuantile("v", [max(0.0, at - 2 * e), min(1.0, at + 2 * e)], e)
        count = lambda test: F.count(F.when(test, 1))
        v = F.col("v")
        below, to_low, below_high, to_high = rows.agg(count(v < low), count(v <= low), count(v < high), count(v <= high)).head()
        if k < below or k >= to_high:
            raise ArithmeticError("the sketch's values don't enclose the place")
        if k < to_low:
            return low
        if k >= below_high:
            return high
        rows, n, k = rows.where((v > low) & (v < high)), below_high - to_low, k - to_low
    return sorted(r["v"] for r in rows.collect())[k]


def quantile_at(rows: DataFrame, places: list[int], few: int = FEW_ROWS) -> float:
    """The mean of the exact numbers v at places (from 0) in order. Runs jobs: rows should be cheap to read again."""
    numbers = rows.where(~F.isnan("v"))
    n = numbers.count()
    # NaN counts as the largest.
    return math.nan if max(places) >= n else sum(_smallest(numbers, n, place, few) for place in places) / len(places)


def quantile(frame: DataFrame, column: Column, share: float, few: int = FEW_ROWS) -> float | None:
    """The exact quantile, between two rows in proportion, as `percentile` has it; None without values.

    Nulls don't count, NaN counts as the largest. Runs jobs: give a frame that is cheap to read again.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"a share lies between 0 and 1, not at {share}")
    rows = frame.select(column.cast("double").alias("v")).where("v is not null")
    numbers = rows.where(~F.isnan("v"))
    n, known = rows.agg(F.count("*"), F.count(F.when(~F.isnan("v"), 1))).head()
    if n == 0:
        return None
    place = (n - 1) * share
    first = math.floor(place)
    if math.ceil(place) >= known:
        return math.nan if first >= known or place > first else _smallest(numbers, known, first, few)
    low = _smallest(numbers, known, first, few)
    if place == first:
        return low
    reached, after = numbers.agg(F.count(F.when(F.col("v") <= low, 1)), F.min(F.when(F.col("v") > low, F.col("v")))).head()
    high = low if reached > first + 1 else after
    return low if low == high else (first + 1 - place) * low + (place - first) * high
