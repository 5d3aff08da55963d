"""Published values of the formulas, and brute force."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from gridlark.functions import exact_tests as X
from gridlark.functions import probability as P
from gridlark.functions import sequence as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize("table,value", [((0, 62, 190, 8), 116.9888344), ((379, 0, 4940, 5601), 251.724361), ((8, 0, 8, 15), 6.536161), ((7, 7, 8, 8), -26.764472)])
def test_strand_bias(spark, table, value):
    assert one(spark, P.strand_bias(*lits(*table)))[0] == pytest.approx(value, abs=1e-4)


@pytest.mark.parametrize("depth,alt,q", [(100, 0, 0), (100, 1, 2), (100, 5, 24), (200, 10, 43), (500, 25, 98)])
def test_poisson_quality(spark, depth, alt, q):
    assert one(spark, P.poisson_quality(F.lit(alt), F.lit(depth)))[0] == q


@pytest.mark.parametrize("table,value", [((10, 0, 20, 0), 0.902019), ((15, 0, 0, 15), 6.867975)])
def test_strand_odds(spark, table, value):
    assert one(spark, P.symmetric_strand_odds(*lits(*table)))[0] == pytest.approx(value, abs=1e-5)


def test_binomials(spark):
    rows = [(n, k, p) for n in (0, 1, 7, 30) for k in range(-1, n + 2) for p in (0.0, 0.05, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "n long, k long, p double").select("*", X.binom_at_least(F.col("n"), F.col("k"), F.col("p")).alias("up"), X.binom_at_most(F.col("n"), F.col("k"), F.col("p")).alias("down"))
    for r in df.collect():
        pmf = [math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.n + 1)]
        assert r.up == pytest.approx(sum(pmf[max(0, r.k) :]), abs=1e-12) and r.down == pytest.approx(sum(pmf[: max(0, r.k + 1)]), abs=1e-12)
    assert one(spark, X.min_count(F.lit(10000), F.lit(1e-4), F.lit(1e-9)), X.binom_at_least(F.lit(None).cast("long"), F.lit(1), F.lit(0.5)))[:] == (12, None)


def test_fisher_brute_force(spark):
    rows = list(itertools.product(range(4), repeat=4))
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    for r in df.select("*", *[X.fisher_exact(*map(F.col, "abcd"), side=s).alias(n) for s, n in ((0, "both"), (1, "up"), (-1, "down"))]).collect():
        a, b, c, d = r[:4]
        n, m, k = a + b + c + d, a + b, a + c
        p = {i: math.comb(m, i) * math.comb(n - m, k - i) / math.comb(n, k) for i in range(max(0, k - n + m), min(m, k) + 1)}
        assert r.both == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))
        assert r.up == pytest.approx(sum(v for i, v in p.items() if i >= a)) and r.down == pytest.approx(sum(v for i, v in p.items() if i <= a))


def test_chi_square_p(spark):
    assert one(spark, X.chi_square_p(F.lit(3.841459)), X.likelihood_ratio_p(F.lit(-3.0), F.lit(-1.0)))[:] == pytest.approx((0.05, 0.0455003), abs=1e-6)


def test_log_sums(spark):
    r = one(spark, P.log_sum_exp(F.array(*lits(-1000.0, -1000.0))), P.complement_of_best(F.array(*lits(0.5, 0.5))), P.safe_frac(F.lit(1), F.lit(0)))
    assert r[0] == pytest.approx(-1000 + math.log(2)) and r[1] == 0.5 and r[2] == 0


def test_sequences(spark):
    p = S.cigar(F.lit("5M0I2D3S"))
    assert one(spark, S.cigar_text(p), S.cigar_length(p, "MIS=X"), S.cigar_length(p, "MDN=X"))[:] == ("5M2D3S", 8, 7)
    u = one(spark, S.repeat_unit(F.lit("ATATAT")))[0]
    assert (u.unit, u["count"]) == ("AT", 3)
    a = one(spark, S.trimmed_allele(F.lit(10), F.lit("CAAT"), F.lit("CAT")))[0]
    assert (a.pos, a.del_len, a.ins_seq) == (11, 1, "")
    assert one(spark, S.genotype_index(F.lit(2), F.lit(1)))[0] == 4
    assert one(spark, S.variant_class(F.lit("A"), F.lit("<DEL>")), S.variant_class(F.lit("A"), F.lit("AT")))[:] == ("symbolic", "indel")
    assert one(spark, S.reverse_complement(F.lit("AACG")))[0] == "CGTT"
