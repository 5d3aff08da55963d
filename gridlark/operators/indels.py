"""Indel callers: germline genotypes with context priors, frequencies, the two-sample model and its tallies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import probability as P
from gridlark.operators import genotype
from gridlark.operators.alleles import group_likelihoods


def priors(alleles: tuple[str, ...], ref: str, theta: Column) -> list[Column]:
    """ln prior of each genotype: a heterozygote with the reference has theta, a homozygous indel half of it, two indels theta squared, the reference the rest. theta is the rate of the repeat context."""
    out = []
    for a, b in genotype.genotypes(alleles):
        if a == b:
            out.append(F.ln(1 - 1.5 * theta) if a == ref else F.ln(theta / 2))
        else:
            out.append(F.ln(theta) if ref in (a, b) else 2 * F.ln(theta))
    return out


def germline(reads: DataFrame, theta: DataFrame, keys: list[str], alleles: tuple[str, ...], ref: str) -> DataFrame:
    """(keys, gt, gq, qual, pl) of groups of alleles, from reads with a ln likelihood per allele (array `lnps`) and a rate by keys.

    qual is the reference genotype's posterior as a quality, gq the rest of the best genotype's.
    """
    n = len(genotype.genotypes(alleles))
    lh = group_likelihoods(reads, keys, alleles).select(*keys, F.array(*[f"g{i}" for i in range(n)]).alias("lhood")).join(theta, keys)
    names = F.array(*[F.lit(f"{a}/{b}") for a, b in genotype.genotypes(alleles)])
    out = lh.withColumn("post", P.normalised(F.zip_with("lhood", F.array(*priors(alleles, ref, F.col("theta"))), lambda a, b: a + b)))
    best = P.first_best(F.col("post"))
    at_ref = genotype.genotypes(alleles).index((ref, ref))
    pl = F.transform("lhood", lambda x: P.rounded(-10 * (x - F.array_max("lhood")) / math.log(10)))
    return out.select(*keys, F.get(names, best).alias("gt"), P.int_phred(P.complement_of_best(F.col("post"))).alias("gq"), P.int_phred(F.col("post")[at_ref]).alias("qual"), pl.alias("pl"))


def continuous(reads: DataFrame, keys: list[str], ref: str, least: float = 0.01, expected_q: int = 17) -> DataFrame:
    """One row per indel allele with a frequency over `least` among reads that name an allele: counts, frequency and quality."""
    by = reads.groupBy(*keys, "allele").agg(F.count("*").alias("n"), F.count_if("is_fwd").alias("fwd"))
    rows = by.join(by.groupBy(*keys).agg(F.sum("n").alias("depth")), keys).filter((F.col("allele") != ref) & (F.col("n") > least * F.col("depth")))
    sure = rows.select("n", "depth").distinct().withColumn("q", P.poisson_quality(F.col("n"), F.col("depth"), expected_q))
    return rows.join(sure, ["n", "depth"]).select(*keys, "allele", "n", "fwd", "depth", (F.col("n") / F.col("depth")).alias("vf"), "q")


def tallies(reads: DataFrame, keys: list[str], ref: str, indel: str, tiers: tuple[int, ...] = (20, 5)) -> DataFrame:
    """Confident reads for the reference, the indel and other alleles, by strand, in tiers of mapping quality: ref1_fwd, ref1_rev, ..., other2_rev."""
    kind = {"ref": F.col("allele") == ref, "indel": F.col("allele") == indel, "other": ~F.col("allele").isin(ref, indel)}
    counts = [F.count_if(k & (F.col("mapq") >= q) & s).alias(f"{name}{i}_{strand}") for name, k in kind.items() for i, q in enumerate(tiers, 1) for strand, s in (("fwd", F.col("is_fwd")), ("rev", ~F.col("is_fwd")))]
    return reads.groupBy(*keys).agg(*counts)


def two_best(reads: DataFrame, keys: list[str], allele: str, share: float = 0.9) -> DataFrame:
    """Groups in which the allele is one of the two with most reads, and those two have at least this share of all."""
    by = reads.groupBy(*keys, "allele").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "allele")
    top = by.withColumn("_r", F.row_number().over(w)).groupBy(*keys).agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("_r") <= 2, F.col("n"))).alias("_two"), F.bool_or((F.col("allele") == allele) & (F.col("_r") <= 2)).alias("_in"))
    return top.filter(F.col("_in") & (F.col("_two") >= share * F.col("_all"))).select(*keys)


def somatic(reads: DataFrame, allele: str, share: float = 0.9) -> DataFrame:
    """The two-sample grid model of an indel allele against all others, at positions where it is one of the two best. reads: (pos, sample 0 or 1, allele, q)."""
    seen = reads.join(two_best(reads, ["pos"], allele, share), "pos", "left_semi").withColumn("is_alt", F.col("allele") == allele)
    lh = genotype.frequency_likelihoods(seen, ["pos", "sample"])
    both = lh.groupBy("pos").agg(F.max(F.when(F.col("sample") == 0, F.col("lhood"))).alias("normal"), F.max(F.when(F.col("sample") == 1, F.col("lhood"))).alias("tumor"))
    return genotype.somatic(both.filter("normal is not null and tumor is not null"))
