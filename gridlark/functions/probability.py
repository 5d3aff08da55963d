"""Probabilities, qualities and test statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the lowest decimal exponent of a double, below which qualities stop growing.
MIN_EXPONENT10 = -307


def rounded(x: Column) -> Column:
    """Half up, the same in every engine."""
    return F.floor(x + 0.5).cast("int")


def safe_frac(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def phred(p: Column) -> Column:
    """Error probability to quality; 0 gives the largest quality."""
    return F.when(p > 0, -10 * F.greatest(F.lit(float(MIN_EXPONENT10)), F.log10(p))).otherwise(F.lit(-10.0 * MIN_EXPONENT10))


def int_phred(p: Column) -> Column:
    return rounded(phred(p))


def ln_phred(ln_p: Column) -> Column:
    """Natural log of an error probability to quality."""
    return -10 * F.greatest(F.lit(float(MIN_EXPONENT10)), ln_p / math.log(10))


def error_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def mapq_adjusted(q: Column, mapq: Column) -> Column:
    """Base quality under a mapping quality: a wrong mapping gives a wrong base three times in four. Mapping quality counts as 5 at least, and not at all over 80."""
    be, me = error_prob(q), error_prob(F.greatest(mapq, F.lit(5)))
    return F.when(mapq > 80, q).otherwise(int_phred((1 - me) * be + 0.75 * me))


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once: within a lambda an outer expression would be evaluated for every element."""
    return F.transform(F.array(value), f)[0]


def log_sum_exp(xs: Column) -> Column:
    """ln of the sum of exp over an array in one pass, without overflow; null for an empty array."""

    def step(acc: Column, x: Column) -> Column:
        top = F.greatest(acc["top"], x)
        return F.struct(top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(x - top)).alias("sum"))

    start = F.struct(F.lit(-1e300).alias("top"), F.lit(0.0).alias("sum"))
    return F.aggregate(xs, start, step, lambda acc: acc["top"] + F.ln(acc["sum"]))


def normalised(ln_xs: Column) -> Column:
    """Array of log weights to probabilities."""
    both = F.struct(ln_xs.alias("xs"), log_sum_exp(ln_xs).alias("total"))
    return let(both, lambda s: F.transform(s["xs"], lambda x: F.exp(x - s["total"])))


#: Fixed value: probabilities closer than this, relative to the larger one, are equal. Sums of logs differ by the order of their terms, some 1e-14.
EQUAL = 1e-9


def first_best(ps: Column) -> Column:
    """Place, from 0, of the largest probability; of equal ones the first, in whatever order their logs were added up."""
    both = F.struct(ps.alias("ps"), F.array_max(ps).alias("top"))
    return let(both, lambda s: F.array_position(F.transform(s["ps"], lambda p: p >= s["top"] * (1 - EQUAL)), F.lit(True)).cast("int") - 1)


def complement_of_best(ps: Column) -> Column:
    """Sum of all but the largest probability, which keeps small values that 1 - p loses. Of equal largest ones one is left out."""

    def step(acc: Column, p: Column) -> Column:
        return F.struct(F.greatest(acc["top"], p).alias("top"), (acc["rest"] + F.least(acc["top"], p)).alias("rest"))

    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("rest"))
    return F.aggregate(ps, start, step, lambda acc: acc["rest"])


def rank_sum_z(n1: Column, n2: Column, w1: Column, w2: Column) -> Column:
    """Mann-Whitney Z of the group with the smaller rank sum; 0 without variance."""

    def z(n_a: Column, n_b: Column, w: Column) -> Column:
        mean = n_a * (n_a + n_b + 1) / 2.0
        sd = F.sqrt(n_b * mean / 6.0)
        return F.when(F.abs(sd) < 0.0001, F.lit(0.0)).otherwise((w - mean) / sd)

    return F.when(w1 > w2, z(n2, n1, w2)).otherwise(z(n1, n2, w1))


def poisson_quality(alt: Column, depth: Column, expected_q: int = 20, cap: int = 100, terms: int = 400) -> Column:
    """Quality of seeing `alt` or more of `depth` by errors of a given quality: the upper Poisson tail, summed term by term from `alt` on."""
    lam = depth * (10 ** (-expected_q / 10))
    # each term from the one before: t_(i+1) = t_i * lam / (i + 1); the first in logs
    ln_first = -lam + alt * F.ln(lam) - F.aggregate(F.sequence(F.lit(1), F.greatest(alt, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.ln(i))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, lambda acc, i: F.struct((acc["t"] * lam / (alt + i)).alias("t"), (acc["s"] + acc["t"] * lam / (alt + i)).alias("s")), lambda acc: acc["s"])
    ln_p = ln_first + F.ln(tail)
    return F.when((alt == 0) | (depth == 0), F.lit(0)).otherwise(F.least(F.lit(cap), rounded(ln_phred(ln_p))))


def strand_bias(fwd_alt: Column, rev_alt: Column, fwd_other: Column, rev_other: Column, error: float = 0.005) -> Column:
    """How much better one strand alone explains the alternate counts than both; binomial coefficients cancel in the difference."""
    fwd, rev = fwd_alt + fwd_other, rev_alt + rev_other

    def lnp(k: Column, n: Column, p: Column) -> Column:
        hit = F.when(k > 0, F.when(p > 0, k * F.ln(p)).otherwise(F.lit(float("-inf")))).otherwise(F.lit(0.0))
        miss = F.when(n - k > 0, F.when(p < 1, (n - k) * F.ln(1 - p)).otherwise(F.lit(float("-inf")))).otherwise(F.lit(0.0))
        return hit + miss

    err = F.lit(error)
    own_fwd, own_rev, both = safe_frac(fwd_alt, fwd), safe_frac(rev_alt, rev), safe_frac(fwd_alt + rev_alt, fwd + rev)
    one = lnp(fwd_alt, fwd, own_fwd) + lnp(rev_alt, rev, err)
    other = lnp(fwd_alt, fwd, err) + lnp(rev_alt, rev, own_rev)
    return F.when(fwd + rev == 0, F.lit(0.0)).otherwise(F.greatest(one, other) - lnp(fwd_alt, fwd, both) - lnp(rev_alt, rev, both))


def log_odds(a: Column, b: Column, c: Column, d: Column, pseudo: float = 0.5) -> Column:
    """ln((a d) / (b c)) with pseudo counts."""
    return F.ln((a + pseudo) * (d + pseudo) / ((b + pseudo) * (c + pseudo)))


def symmetric_strand_odds(a: Column, b: Column, c: Column, d: Column, pseudo: float = 0.5) -> Column:
    """ln(r + 1/r) of the odds ratio of a 2x2 table with pseudo counts."""
    r = (a + pseudo) * (d + pseudo) / ((b + pseudo) * (c + pseudo))
    return F.ln(r + 1 / r)


def scaled(x: Column, lo: float, hi: float) -> Column:
    """Linear from lo (0) to hi (1), clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def log_compressed(n: Column, bits: int = 3) -> Column:
    """Keeps the top bits of a count; the rest alternate 1010..., which puts the value near the middle of those it stands for."""
    low = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int") + 1 - bits)
    scale = F.pow(F.lit(2.0), low)
    suffix = F.floor(scale * 2 / 3).cast("long")
    return F.when(low == 0, n).otherwise((F.floor(n / scale) * scale).cast("long") + suffix)


def soft_max(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """A real number to the range from lo to hi, by the branch that cannot overflow."""
    return F.when(x <= 0, F.exp(x) / (1 + F.exp(x))).otherwise(1 / (1 + F.exp(-x))) * (hi - lo) + lo


def soft_max_inverse(p: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    at = (p - lo) / (hi - lo)
    return F.ln(at / (1 - at))


def soft_max_range(xs: Column) -> Column:
    """n real numbers to n probabilities whose rest, the n + 1st, is implied: exp(x) / (1 + sum of exp)."""
    both = F.struct(xs.alias("xs"), F.aggregate(xs, F.lit(1.0), lambda acc, x: acc + F.exp(x)).alias("total"))
    return let(both, lambda s: F.transform(s["xs"], lambda x: F.exp(x) / s["total"]))


def soft_max_range_inverse(ps: Column) -> Column:
    rest = F.struct(ps.alias("ps"), (1 - F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + p)).alias("rest"))
    return let(rest, lambda s: F.transform(s["ps"], lambda p: F.ln(p / s["rest"])))


def pl_probabilities(pl: Column) -> Column:
    return F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10))


def rectified_pl(pl: Column) -> Column:
    """PL of a haploid call (two values) as a diploid one: the second value belongs to the homozygous alternate, and a heterozygote is as good as impossible."""
    return F.when(F.size(pl) == 2, F.array(pl[0], F.lit(10_000).cast("long"), pl[1])).otherwise(pl)
