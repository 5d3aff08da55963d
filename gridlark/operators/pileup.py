"""Evidence by position: counts, filters, depth and tests over base observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import probability as P
from gridlark.functions.exact_tests import chi_square

#: Default thresholds of the germline caller.
MIN_BASE_QUALITY, MIN_MAPQ, LOW_DEPTH = 17, 20, 3


def count_if(c: Column) -> Column:
    return F.count_if(c)


def counts(obs: DataFrame, ref: DataFrame, alleles: tuple[str, ...], min_q: int = MIN_BASE_QUALITY) -> DataFrame:
    """One row per position: used and unused calls, counts by allele and strand, mapping quality, the most frequent alternate (ties: first in allele order; none: the reference) and the low-depth flag.

    One partial aggregate and one shuffle by position; the reference joins afterwards, on rows already few.
    """
    used = F.col("q") >= min_q
    agg = [count_if(used).alias("used"), count_if(~used).alias("unused"), count_if(used & F.col("is_fwd")).alias("fwd")]
    agg += [count_if(used & (F.col("base") == a)).alias(f"n_{a}") for a in alleles]
    agg += [F.sqrt(F.avg(F.col("mapq") * F.col("mapq"))).alias("mapq_rms"), F.avg((F.col("mapq") == 0).cast("int")).alias("mapq0_frac")]
    out = obs.groupBy("pos").agg(*agg).join(ref, "pos")
    ranked = [F.struct(F.when(F.col("ref") == a, F.lit(-1).cast("long")).otherwise(F.col(f"n_{a}")).alias("n"), F.lit(-i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(alleles)]
    best = F.greatest(*ranked)
    return out.withColumn("alt", F.when(best["n"] > 0, best["a"]).otherwise(F.col("ref"))).withColumn("low_depth", F.col("used") < LOW_DEPTH)


def filter_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds, null if none: each read counts once."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def mapping_level(mapq: Column, unmapped: Column, singleton: Column, proper: Column, min_mapq: int = MIN_MAPQ, tier2_mapq: int = 0) -> Column:
    tier1 = (mapq >= min_mapq) & ~singleton & proper
    return F.when(unmapped, "UNMAPPED").when(tier1, "TIER1").when(mapq >= tier2_mapq, F.when(singleton | ~proper | (mapq > 0), "TIER2").otherwise("SUB")).otherwise("SUB")


def median_depth_nonzero(depths: DataFrame, part: list[str], depth: str = "depth") -> DataFrame:
    """Exact median of depths over 0, from a histogram of depths: what meets in a task is distinct depths, not positions."""
    hist = depths.filter(F.col(depth) > 0).groupBy(*part, depth).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*part).orderBy(depth)
    cum = hist.withColumn("c", F.sum("n").over(w)).withColumn("t", F.sum("n").over(Window.partitionBy(*part)))
    lo, hi = F.floor((F.col("t") - 1) / 2), F.floor(F.col("t") / 2)
    inside = lambda k: (F.col("c") > k) & (F.col("c") - F.col("n") <= k)
    return cum.groupBy(*part).agg(((F.max(F.when(inside(lo), F.col(depth))) + F.max(F.when(inside(hi), F.col(depth)))) / 2.0).alias("median"))


def rank_sums(obs: DataFrame, part: list[str], value: str, second: Column) -> DataFrame:
    """Mann-Whitney Z of a small-integer value between two groups of each part, by mid-ranks over distinct values, and the second group's mean."""
    bins = obs.groupBy(*part, value).agg(count_if(~second).alias("c1"), count_if(second).alias("c2"))
    w = Window.partitionBy(*part).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum(F.col("c1") + F.col("c2")).over(w), F.lit(0)) + (F.col("c1") + F.col("c2") + 1) / 2.0
    sums = bins.withColumn("rank", rank).groupBy(*part).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(F.col("rank") * F.col("c1")).alias("w1"), F.sum(F.col("rank") * F.col("c2")).alias("w2"), F.sum(F.col(value) * F.col("c2")).alias("s2"))
    return sums.select(*part, "n1", "n2", P.rank_sum_z(F.col("n1"), F.col("n2"), F.col("w1"), F.col("w2")).alias("z"), P.safe_frac(F.col("s2"), F.col("n2")).alias("mean2"))


def absolute_deviation(obs: DataFrame, part: list[str], value: str, least: int = 3) -> DataFrame:
    """Median, and median absolute deviation from it, of parts with at least so many rows."""
    mid = obs.groupBy(*part).agg(F.median(value).alias("median"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return obs.join(mid, part).groupBy(*part).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.first("n").alias("n"))


def strand_tables(obs: DataFrame, ref: DataFrame) -> DataFrame:
    """2x2 counts of strand and allele by position, with odds ratios, strand bias and a chi-square statistic."""
    alt = F.col("base") != F.col("ref")
    t = obs.join(ref, "pos").groupBy("pos").agg(count_if(alt & F.col("is_fwd")).alias("fa"), count_if(alt & ~F.col("is_fwd")).alias("ra"), count_if(~alt & F.col("is_fwd")).alias("fo"), count_if(~alt & ~F.col("is_fwd")).alias("ro"))
    c = [F.col(x) for x in ("fa", "ra", "fo", "ro")]
    return t.select("pos", "fa", "ra", "fo", "ro", P.log_odds(*c).alias("log_odds"), P.symmetric_strand_odds(*c).alias("strand_odds"), P.strand_bias(*c).alias("bias"), chi_square(*c).alias("chi2"))


def dependent_error(obs: DataFrame, decay: float = 0.4, floor: float = 0.25) -> DataFrame:
    """Each call's error exponent: calls of one strand and allele at a position, best quality first, count less and less as independent errors."""
    w = Window.partitionBy("pos", "is_fwd", "base").orderBy(F.desc("q"), "read_id", "read_pos")
    return obs.withColumn("weight", F.greatest(F.lit(floor), F.pow(F.lit(1.0 - decay), F.row_number().over(w) - 1)))


def mismatch_density(obs: DataFrame, ref: DataFrame, flank: int = 20, most: int = 2) -> DataFrame:
    """Flags calls with more than `most` mismatches within `flank` bases in their read."""
    w = Window.partitionBy("read_id").orderBy("read_pos").rangeBetween(-flank, flank)
    mm = obs.join(ref, "pos").withColumn("mismatch", (F.col("base") != F.col("ref")).cast("int"))
    return mm.withColumn("near", F.sum("mismatch").over(w)).withColumn("dense", F.col("near") > most)


def noise_panel(obs: DataFrame, ref: DataFrame, least: int = 12, most_ratio: float = 0.2) -> DataFrame:
    """Sites with enough calls and an alternate ratio over 0 and up to most_ratio: DP and AD."""
    t = obs.join(ref, "pos").groupBy("pos").agg(F.count("*").alias("dp"), count_if(F.col("base") != F.col("ref")).alias("alt"))
    return t.filter((F.col("dp") >= least) & (F.col("alt") > 0) & (F.col("alt") <= most_ratio * F.col("dp"))).select("pos", "dp", (F.col("dp") - F.col("alt")).alias("ref_depth"), F.col("alt").alias("alt_depth"))
