"""Error patterns: counts, and rates fitted to them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.probability import log_compressed


def basecall_patterns(obs: DataFrame, ref: DataFrame, min_q: int = 25) -> DataFrame:
    """How many positions show each pattern of reference and alternate counts by strand.

    Counts are log-compressed and the two strands put in order, so that patterns equal
    but for the strand are one.
    """
    alt = F.col("base") != F.col("ref")
    use = obs.filter(F.col("q") >= min_q).join(ref, "pos")
    sites = use.groupBy("pos").agg(*[F.count_if(a & s).alias(n) for n, a, s in (("r0", ~alt, F.col("is_fwd")), ("a0", alt, F.col("is_fwd")), ("r1", ~alt, ~F.col("is_fwd")), ("a1", alt, ~F.col("is_fwd")))])
    pair = lambda r, a: F.struct(log_compressed(F.col(r)).alias("ref"), F.col(a).alias("alt"))
    lo, hi = F.least(pair("r0", "a0"), pair("r1", "a1")), F.greatest(pair("r0", "a0"), pair("r1", "a1"))
    flat = sites.select(lo["ref"].alias("ref_a"), lo["alt"].alias("alt_a"), hi["ref"].alias("ref_b"), hi["alt"].alias("alt_b"))
    return flat.groupBy("ref_a", "alt_a", "ref_b", "alt_b").agg(F.count("*").alias("sites"))


def skip_tallies(sites: DataFrame, low: int, high: int) -> DataFrame:
    """Why sites are left out of error counting: empty, low, deep, or counted."""
    why = F.when(F.col("depth") == 0, "empty").when(F.col("depth") < low, "low").when(F.col("depth") > high, "deep").otherwise("counted")
    return sites.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def merged_counts(*tables: DataFrame) -> DataFrame:
    """Key-wise sum of count tables (key columns and `n`)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def _ln_pmf(n: np.ndarray, k: np.ndarray, p: float) -> np.ndarray:
    choose = np.array([math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1) for a, b in zip(n, k)])
    return choose + k * math.log(p) + (n - k) * math.log1p(-p)


def fitted_rates(counts: DataFrame, context: list[str], clean: float = 1e-8, steps: int = 200) -> DataFrame:
    """For each context the noisy rate and the share of noisy loci, of a mixture of clean, noisy and heterozygous loci.

    `counts` has (context, depth, alt, n): what reaches a task is one row per distinct
    pattern.  Expectation maximisation: each step raises the likelihood.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k, w = (pdf[c].to_numpy(float) for c in ("depth", "alt", "n"))
        rate, share, het = 0.05, 0.2, 0.001
        ll = -math.inf
        for _ in range(steps):
            parts = np.stack([math.log(max(1e-12, 1 - share - het)) + _ln_pmf(n, k, clean), math.log(share) + _ln_pmf(n, k, rate), math.log(het) + _ln_pmf(n, k, 0.5)])
            top = parts.max(axis=0)
            total = top + np.log(np.exp(parts - top).sum(axis=0))
            post = np.exp(parts - total) * w
            now = float((total * w).sum())
            share, het = min(0.998, max(1e-9, post[1].sum() / w.sum())), min(0.5, max(1e-9, post[2].sum() / w.sum()))
            rate = min(0.45, max(1e-7, (post[1] * k).sum() / max(1e-12, (post[1] * n).sum())))
            if now - ll < 1e-9 * abs(now):
                break
            ll = now
        return pd.DataFrame([[*pdf.iloc[0][context], rate, share, het, int(w.sum())]], columns=[*context, "rate", "noisy_share", "het_share", "loci"])

    types = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    return counts.groupBy(*context).applyInPandas(fit, ", ".join([f"`{c}` {types[c]}" for c in context] + ["rate double", "noisy_share double", "het_share double", "loci long"]))


def shared_levels(counts: DataFrame, context: list[str], level: str = "q", n: str = "n") -> DataFrame:
    """The uncompressed form of patterns: for each context the quality levels it shares and the count at each, in order. What meets is one context's levels, some hundred at most."""
    by = counts.groupBy(*context, level).agg(F.sum(n).alias("_n"))
    listed = by.groupBy(*context).agg(F.array_sort(F.collect_list(F.struct(F.col(level).alias("l"), F.col("_n").alias("n")))).alias("_x"))
    return listed.select(*context, F.transform("_x", lambda s: s["l"]).alias("levels"), F.transform("_x", lambda s: s["n"]).alias("counts"))
