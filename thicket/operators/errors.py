"""Losses of weight matrices against second moments; no observation is read again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import matrices as M


def reconstruction(w: Column, s: Column, d: int) -> Column:
    """||X - XW||^2 / m = tr((I - W)' S (I - W))."""
    return M.let(M.residual(w, d), lambda a: M.inner(a, M.matmul(s, a, d)))


def sem_loss(w: Column, s: Column, d: int) -> Column:
    return reconstruction(w, s, d) / 2


def penalized_likelihood(w: Column, covariance: Column, m: Column, d: int) -> Column:
    """m d / 2 ln T + ln(m) / 2 nonzeros, T = tr((I - W)'(I - W) C); null where T is not positive or m < 2.

    T takes the orientation that the published results were computed with, which is the transpose
    of the reconstruction error's.
    """
    t = M.let(M.residual(w, d), lambda a: M.inner(a, M.matmul(a, covariance, d)))
    nonzero = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + F.when(x != 0, 1.0).otherwise(0.0))
    return F.when((m >= 2) & (t > 0), m * d / 2 * F.log(t) + F.log(m) / 2 * nonzero)


def covariance_error(w: Column, covariance: Column, d: int) -> Column:
    """||(I - W)^-1 (I - W)^-T - C||_F for an acyclic W and noise of variance one."""
    model = M.let(M.inverse_of_residual(w, d), lambda inverse: M.matmul(inverse, M.transpose(inverse, d), d))
    return M.frobenius(M.minus(model, covariance))
