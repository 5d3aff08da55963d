"""Exact tests, an Arrow batch at a time: they need log-factorials, which Spark SQL lacks.

A batch's distinct arguments are worked out once, all their terms as one numpy array.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of sums that are held at once.
TERMS = 1 << 20


def _ln_factorials(n: int) -> np.ndarray:
    return np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]


def _summed(first: np.ndarray, last: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the sum of term(row, i) over i from first to last (none: 0)."""
    size = np.maximum(0, last - first + 1)
    out = np.zeros(len(size))
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TERMS, side="right")))
        row = np.repeat(np.arange(at, stop), size[at:stop])
        i = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(size[at:stop])[:-1]], size[at:stop]) + first[row]
        out[at:stop] = np.bincount(row - at, term(row, i), minlength=stop - at)
        at = stop
    return out


def _binomial(n: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Probability of `first` to `last` successes."""
    ln = _ln_factorials(int(n.max(initial=0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        hit, miss = np.log(p), np.log1p(-p)

        def term(r, i):
            of = ln[n[r]] - ln[i] - ln[n[r] - i]
            return np.exp(of + np.where(i > 0, i * hit[r], 0.0) + np.where(n[r] > i, (n[r] - i) * miss[r], 0.0))

        return np.minimum(1.0, _summed(np.maximum(first, 0), np.minimum(last, n), term))


def _at_least(n, k, p):
    return np.where(k <= 0, 1.0, _binomial(n, p, k, n))


def _at_most(n, k, p):
    return np.where(k >= n, 1.0, _binomial(n, p, np.zeros_like(n), k))


def _two_sided(n, k, p):
    return np.minimum(1.0, 2 * np.minimum(_binomial(n, p, np.zeros_like(n), k), _at_least(n, k, p)))


def _min_count(n, p, alpha):
    ln, out = _ln_factorials(int(n.max(initial=0))), np.zeros(len(n), np.int64)
    for row, (m, q, a) in enumerate(zip(n.tolist(), p.tolist(), alpha.tolist())):
        i = np.arange(m + 1)
        pmf = np.exp(ln[m] - ln[i] - ln[m - i] + (i * math.log(q) if q > 0 else np.where(i > 0, -np.inf, 0.0)) + ((m - i) * math.log1p(-q) if q < 1 else np.where(i < m, -np.inf, 0.0)))
        out[row] = int((np.cumsum(pmf[::-1])[::-1] > a).sum())
    return out


def _fisher(a, b, c, d, side: int):
    """side 0: all tables no likelier than the given one; 1: as many or more in the first cell; -1: as many or fewer."""
    n, r, k = a + b + c + d, a + b, a + c
    ln = _ln_factorials(int(n.max(initial=0)))
    choose = lambda m, j: ln[m] - ln[j] - ln[m - j]
    lnp = lambda row, i: choose(r[row], i) + choose(n[row] - r[row], k[row] - i) - choose(n[row], k[row])
    every = np.arange(len(a))
    seen = lnp(every, a)
    low, high = np.maximum(0, k - (n - r)), np.minimum(r, k)
    if side == 0:
        return np.minimum(1.0, _summed(low, high, lambda row, i: np.where(lnp(row, i) <= seen[row] + 1e-7, np.exp(lnp(row, i)), 0.0)))
    return np.minimum(1.0, _summed(a if side > 0 else low, high if side > 0 else a, lambda row, i: np.exp(lnp(row, i))))


def _column(f, counts: int, reals: int, kind: str = "double"):
    """f over the distinct rows of its arguments: first counts, then real numbers. A null argument gives a null."""

    def run(*args):
        valid = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in args])
        table = np.stack([x.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for x in args], axis=1)
        rows, back = np.unique(table, axis=0, return_inverse=True)
        got = f(*(rows[:, i].astype(np.int64) for i in range(counts)), *(rows[:, counts + i] for i in range(reals)))
        return pa.array(got[back.ravel()], mask=~valid)

    if counts + reals == 1:
        return F.arrow_udf(lambda a: run(a), kind)
    if counts + reals == 3:
        return F.arrow_udf(lambda a, b, c: run(a, b, c), kind)
    return F.arrow_udf(lambda a, b, c, d: run(a, b, c, d), kind)


def binom_at_least(n: Column, k: Column, p: Column) -> Column:
    return _column(_at_least, 2, 1)(n, k, p)


def binom_at_most(n: Column, k: Column, p: Column) -> Column:
    return _column(_at_most, 2, 1)(n, k, p)


def binom_two_sided(n: Column, k: Column, p: Column) -> Column:
    """Twice the smaller tail, 1 at most."""
    return _column(_two_sided, 2, 1)(n, k, p)


def min_count(n: Column, p: Column, alpha: Column) -> Column:
    """The smallest count whose upper tail is alpha or less; n + 1 if there is none."""
    return _column(_min_count, 1, 2, "long")(n, p, alpha)


def fisher_exact(a: Column, b: Column, c: Column, d: Column, side: int = 0) -> Column:
    """Two-sided, or of as many and more (1) or as many and fewer (-1) in the first cell."""
    return _column(lambda *x: _fisher(*x, side), 4, 0)(a, b, c, d)


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Statistic of a 2x2 table, 0 where a margin is empty; over 3.841 rejects independence at 0.05."""
    n = a + b + c + d
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(below > 0, n * F.pow((a * d - b * c).cast("double"), 2) / below).otherwise(F.lit(0.0))


def chi_square_p(statistic: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return _column(lambda x: np.array([math.erfc(math.sqrt(max(v, 0.0) / 2)) for v in x]), 0, 1)(statistic)


def likelihood_ratio_p(ln_null: Column, ln_alternative: Column) -> Column:
    """p value of a nested model with one parameter fewer."""
    return chi_square_p(2 * (ln_alternative - ln_null))
