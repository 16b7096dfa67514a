"""Square matrices as row-major ARRAY<DOUBLE> columns, in built-in array functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: what a lambda captures would be computed again at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entries(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def total(n: int, term: Callable[[Column], Column]) -> Column:
    """The sum of term(k) for k from 0 to n - 1."""
    return F.aggregate(entries(n), F.lit(0.0), lambda acc, k: acc + term(k))


def at(m: Column, row: Column, col: Column, d: int) -> Column:
    return F.get(m, (row * d + col).cast("int"))


def row_of(k: Column, d: int) -> Column:
    return F.floor(k / d).cast("int")


def build(d: int, cell: Callable[[Column, Column], Column]) -> Column:
    """The matrix with cell(row, col)."""
    return F.transform(entries(d * d), lambda k: cell(row_of(k, d), k % d))


def identity(d: int) -> Column:
    return build(d, lambda i, j: F.when(i == j, 1.0).otherwise(0.0))


def matmul(a: Column, b: Column, d: int) -> Column:
    def product(x: Column, y: Column) -> Column:
        return build(d, lambda i, j: F.aggregate(entries(d), F.lit(0.0), lambda acc, k: acc + at(x, i, k, d) * at(y, k, j, d)))

    return let(a, lambda x: let(b, lambda y: product(x, y)))


def transpose(a: Column, d: int) -> Column:
    return let(a, lambda x: build(d, lambda i, j: at(x, j, i, d)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def inner(a: Column, b: Column) -> Column:
    """The sum of products of entries."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def frobenius(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def trace(a: Column, d: int) -> Column:
    return let(a, lambda x: total(d, lambda k: at(x, k, k, d)))


def residual(w: Column, d: int) -> Column:
    """I - W."""
    return minus(identity(d), w)


def threshold(w: Column, least: float) -> Column:
    """Entries below the least absolute value are 0 (strictly below)."""
    return F.transform(w, lambda x: F.when(F.abs(x) < least, 0.0).otherwise(x))


def threshold_rounded(w: Column, least: float) -> Column:
    """Entries that are not above the least absolute value after rounding to 3 digits are 0."""
    return F.transform(w, lambda x: F.when(F.abs(F.bround(x, 3)) <= least, 0.0).otherwise(F.bround(x, 3)))


def rounded(w: Column, digits: int) -> Column:
    """Half to even, as numpy does."""
    return F.transform(w, lambda x: F.bround(x, digits))


def zero_diagonal(w: Column, d: int) -> Column:
    return F.transform(w, lambda x, k: F.when(k % (d + 1) == 0, 0.0).otherwise(x))


def clipped(w: Column, low: float, high: float) -> Column:
    return F.transform(w, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def finite(w: Column, most: float = 1e3) -> Column:
    """NaN is 0, infinities are plus or minus `most`."""
    return F.transform(w, lambda x: F.when(F.isnan(x), 0.0).when(x == float("inf"), most).when(x == float("-inf"), -most).otherwise(x))


def soft_threshold(a: Column, gamma: Column | float) -> Column:
    """The whole matrix drawn towards 0 by gamma in Frobenius norm, 0 if it isn't that far."""
    factor = lambda x: F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(gamma) / (frobenius(x) + 1e-12))
    return let(a, lambda x: let(factor(x), lambda f: times(x, f)))


def inverse_of_residual(w: Column, d: int) -> Column:
    """(I - W)^-1 of an acyclic W: I + W + W^2 + ... ends after d - 1 powers."""
    return let(w, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(max(1, d - 1))), identity(d), lambda acc, _: plus(identity(d), matmul(x, acc, d))))


def acyclicity(w: Column, d: int, terms: int = 20) -> Column:
    """tr(exp(W o W)) - d by its series, with W clipped to 5 and the result to [0, 1000]."""
    squared = F.transform(clipped(w, -5.0, 5.0), lambda x: x * x)
    start = F.struct(identity(d).alias("p"), F.lit(0.0).alias("h"))

    def step(acc: Column, k: Column, x: Column) -> Column:
        return let(times(matmul(acc["p"], x, d), F.lit(1.0) / k), lambda p: F.struct(p.alias("p"), (acc["h"] + trace(p, d)).alias("h")))

    h = let(squared, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda acc, k: step(acc, k, x), lambda acc: acc["h"]))
    return F.least(F.greatest(h, F.lit(0.0)), F.lit(1e3))
