"""Filter sets as bit masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter names, by bit.
NAMES = ("LowGQX", "HighDepth", "HighDPFRatio", "HighSNVSB", "LowDepth", "PloidyConflict", "NotGenotyped", "NoPassedVariantGTs", "IndelConflict", "SiteConflict")
BIT = {name: 1 << i for i, name in enumerate(NAMES)}


def mask(**holds: Column) -> Column:
    """The union of the filters that hold; a null condition does not."""
    out = F.lit(0)
    for name, c in holds.items():
        out = out.bitwiseOR(F.when(c, BIT[name]).otherwise(0))
    return out


def rendered(bits: Column) -> Column:
    """Names joined by semicolons in order of their bits, or PASS."""
    named = F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, n) for n, b in BIT.items()]), lambda x: x.isNotNull())
    return F.when(bits == 0, "PASS").otherwise(F.array_join(named, ";"))


def germline(gqx: Column, depth: Column, expected_depth: Column, unused: Column, bias: Column, used: Column, min_gqx: int = 15) -> Column:
    """A sample's hard filters with the workflow's thresholds."""
    return mask(LowGQX=gqx < min_gqx, HighDepth=depth > 3 * expected_depth, HighDPFRatio=unused > 0.4 * (used + unused), HighSNVSB=bias > 10, LowDepth=used < 3)


def extended(samples: DataFrame, locus: list[str], bits: str = "filters", variant: str = "is_variant") -> DataFrame:
    """Locus filters: what all samples share, and NoPassedVariantGTs where no sample has a variant genotype without filters."""
    shared = samples.groupBy(*locus).agg(F.bit_and(bits).alias("shared"), F.bit_or(bits).alias("any"), F.bool_or(F.col(variant) & (F.col(bits) == 0)).alias("passed"))
    return shared.withColumn("locus_filters", F.col("shared").bitwiseOR(F.when(F.col("passed"), 0).otherwise(BIT["NoPassedVariantGTs"])))


def somatic_snv(nt: Column, qss_nt: Column, unused: Column, used: Column, spanning: Column, depth: Column, expected: Column) -> Column:
    """Array of the somatic filters that hold: depth, noise, spanning deletions, and the quality or the normal's genotype."""
    frac = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    hits = F.array(
        F.when(depth > 3 * expected, "HighDepth"),
        F.when(frac(unused, used + unused) >= 0.4, "BCNoise"),
        F.when(frac(spanning, used + spanning) > 0.75, "SpanDel"),
        F.when((nt != 0) | (qss_nt < 15), "QSS_ref"),
    )
    return F.filter(hits, lambda x: x.isNotNull())


def rethreshold(filters: Column, score: Column, least: float, name: str = "LowEVS") -> Column:
    """Adds or removes one filter by a new score threshold."""
    rest = F.array_except(filters, F.array(F.lit(name)))
    return F.when(score >= least, rest).otherwise(F.array_union(rest, F.array(F.lit(name))))


def somatic_indel(nt: Column, qsi_nt: Column, noise: Column, depth: Column, expected: Column, evs: Column | None = None, cutoff: float = 0.0, min_depth: int = 2) -> Column:
    """Array of the somatic indel filters that hold. With a score, the score's cutoff takes the place of noise and quality; depth filters hold either way. noise is the larger share of filtered base calls around the indel of both samples, depth the smaller locus depth."""
    judged = [F.when(noise >= 0.3, "IndelBCNoise"), F.when((nt != 0) | (qsi_nt < 30), "QSI_ref")] if evs is None else [F.when(evs < cutoff, "LowEVS")]
    hits = F.array(F.when(depth > 3 * expected, "HighDepth"), *judged, F.when(depth < min_depth, "LowDepth"))
    return F.filter(hits, lambda x: x.isNotNull())


def scored(score: Column, nt: Column, cutoff: Column, filters: Column, name: str = "LowEVS") -> tuple[Column, Column]:
    """The score, 0 where the normal is not the reference, and the filters with the one of a score below the cutoff."""
    own = F.when(nt != 0, F.lit(0.0)).otherwise(score)
    rest = F.array_except(filters, F.array(F.lit(name)))
    return own, F.when(own < cutoff, F.array_union(rest, F.array(F.lit(name)))).otherwise(rest)
