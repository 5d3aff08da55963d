"""Genotype models in log space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions import probability as P
from gridlark.operators.running import tasks

#: Fixed value: the expected heterozygosity.
THETA = 0.001


def genotypes(alleles: tuple[str, ...]) -> list[tuple[str, str]]:
    """Diploid genotypes in the order of likelihood vectors."""
    return [(alleles[a], alleles[b]) for b in range(len(alleles)) for a in range(b + 1)]


def priors(alleles: tuple[str, ...], ref: Column, theta: float = THETA, polymorphic: bool = False) -> list[Column]:
    """ln prior of each genotype given the reference allele.

    Genomic: heterozygotes with the reference share theta, homozygous alternates half
    of that, other heterozygotes theta squared, the reference genotype the rest.
    Polymorphic: a site known to vary, where no allele is favoured.
    """
    n = len(alleles)
    others = n - 1
    het, hom, alt_het = theta / others, theta / 2 / others, theta * theta / others
    rest = 1 - theta - theta / 2 - alt_het * (others * (others - 1) / 2)
    out = []
    for a, b in genotypes(alleles):
        if polymorphic:
            p = (1 - theta) / (2 * n) if a == b else (1 + theta) / (n * (n - 1))
            out.append(F.lit(math.log(p)))
        elif a == b:
            out.append(F.when(ref == a, math.log(rest)).otherwise(math.log(hom)))
        else:
            out.append(F.when((ref == a) | (ref == b), math.log(het)).otherwise(math.log(alt_het)))
    return out


def likelihoods(obs: DataFrame, alleles: tuple[str, ...], keys: list[str], error: Column | None = None) -> DataFrame:
    """ln likelihood of each genotype (array `lhood`), from calls (base, q): sums of logs, which combine before the shuffle.

    A call is right with 1 - e, each wrong allele has e / (n - 1); a heterozygote is an even mix.
    error: each call's e, where it is not its quality's alone (errors that depend on each other).
    """
    e = P.error_prob(F.greatest(F.col("q"), F.lit(1))) if error is None else error
    right, wrong = 1 - e, e / (len(alleles) - 1)
    sums = []
    for i, (a, b) in enumerate(genotypes(alleles)):
        pa, pb = F.when(F.col("base") == a, right).otherwise(wrong), F.when(F.col("base") == b, right).otherwise(wrong)
        sums.append(F.sum(F.ln(pa if a == b else (pa + pb) / 2)).alias(f"g{i}"))
    n = len(sums)
    return obs.groupBy(*keys).agg(*sums, F.count("*").alias("depth")).select(*keys, "depth", F.array(*[f"g{i}" for i in range(n)]).alias("lhood"))


def called(lhoods: DataFrame, alleles: tuple[str, ...], theta: float = THETA) -> DataFrame:
    """Adds the best genotype under genomic priors, its quality, the variant quality, the polymorphic genotype, GQX and PL.

    Qualities sum the other genotypes' posteriors, never 1 minus the best.  GQX is 0
    where the two priors disagree on the genotype, else the smaller quality.
    """
    names = F.array(*[F.lit(f"{a}/{b}") for a, b in genotypes(alleles)])
    out = lhoods
    for tag, poly in (("", False), ("_poly", True)):
        prior = F.array(*priors(alleles, F.col("ref"), theta, poly))
        out = out.withColumn(f"post{tag}", P.normalised(F.zip_with("lhood", prior, lambda a, b: a + b)))
        out = out.withColumn(f"best{tag}", P.first_best(F.col(f"post{tag}")))
        out = out.withColumn(f"gt{tag}", F.get(names, F.col(f"best{tag}"))).withColumn(f"gq{tag}", P.int_phred(P.complement_of_best(F.col(f"post{tag}"))))
    ref_gt = F.array_position(names, F.concat(F.col("ref"), F.lit("/"), F.col("ref"))).cast("int") - 1
    out = out.withColumn("qual", P.int_phred(F.get("post", ref_gt)))
    out = out.withColumn("gqx", F.when(F.col("best") != F.col("best_poly"), 0).otherwise(F.least("gq", "gq_poly")))
    return out.withColumn("pl", F.transform("lhood", lambda x: P.rounded(-10 * (x - F.array_max("lhood")) / math.log(10))))


def continuous(obs: DataFrame, ref: DataFrame, least: float = 0.01, expected_q: int = 20) -> DataFrame:
    """One row per alternate allele with a frequency over `least`: counts, frequency, quality and strand bias."""
    by = obs.groupBy("pos", "base").agg(F.count("*").alias("n"), F.count_if("is_fwd").alias("fwd"))
    total = by.groupBy("pos").agg(F.sum("n").alias("depth"), F.sum("fwd").alias("depth_fwd"))
    rows = by.join(total, "pos").join(ref, "pos").filter((F.col("base") != F.col("ref")) & (F.col("n") > least * F.col("depth")))
    fa, ra = F.col("fwd"), F.col("n") - F.col("fwd")
    fo, ro = F.col("depth_fwd") - fa, F.col("depth") - F.col("depth_fwd") - ra
    # the tail sum is long and its arguments are few: once for each distinct pair
    sure = rows.select("n", "depth").distinct().withColumn("q", P.poisson_quality(F.col("n"), F.col("depth"), expected_q))
    return rows.join(sure, ["n", "depth"]).select("pos", F.col("base").alias("alt"), "n", "depth", (F.col("n") / F.col("depth")).alias("vf"), "q", P.strand_bias(fa, ra, fo, ro).alias("bias"))


#: Fixed value: the step of the allele-frequency grid.
STEP = 0.05


def frequencies() -> list[float]:
    """The three canonical frequencies (reference, heterozygous, alternate), then the grid between them."""
    grid = [round(i * STEP, 2) for i in range(1, 20) if i != 10]
    return [0.0, 0.5, 1.0, *grid]


def frequency_likelihoods(obs: DataFrame, keys: list[str]) -> DataFrame:
    """ln likelihood of each alternate frequency (array `lhood`) from calls (is_alt, q)."""
    e = P.error_prob(F.greatest(F.col("q"), F.lit(1)))
    sums = [F.sum(F.ln(F.when(F.col("is_alt"), f * (1 - e) + (1 - f) * e).otherwise((1 - f) * (1 - e) + f * e))).alias(f"f{i}") for i, f in enumerate(frequencies())]
    return obs.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"f{i}" for i in range(len(sums))]).alias("lhood"))


def _shared(g: int, own: float, other: float):
    return lambda x, i: x + F.when(i == g, own).otherwise(other)


def _unlike(g: int):
    return lambda s: s["i"] != g


def somatic(lhoods: DataFrame, theta: float = THETA, somatic_rate: float = 1e-6, shared_error: float = 5e-6, contamination: float = 0.15) -> DataFrame:
    """Joint posterior of the normal genotype and of being somatic, from arrays `normal` and `tumor` over frequencies().

    Non-somatic: both samples share one frequency, the genotype's or, at the shared
    error rate, any other.  Somatic: they differ; the normal sits at its genotype, and
    a reference normal may also show one step of contamination where the tumour
    frequency allows it.  Adds gt (0 reference, 1 heterozygous, 2 alternate), qss
    (quality of being somatic) and qss_nt (somatic and that genotype).
    """
    f = frequencies()
    n = len(f)
    spread = math.log(1 / (n - 1))
    first_grid = 3  # the grid's lowest frequency stands after the canonical ones
    gt_prior = [math.log(1 - 1.5 * theta), math.log(theta), math.log(theta / 2)]
    normal, tumor = F.col("normal"), F.col("tumor")
    both = F.zip_with(normal, tumor, lambda a, b: a + b)
    admixed = F.array(*[F.lit(contamination * x >= STEP) for x in f])
    names = []
    out = lhoods
    for g in range(3):
        # other frequencies of both samples, at the shared error rate
        same = F.transform(both, _shared(g, math.log1p(-shared_error), math.log(shared_error) + spread))
        differ = F.transform(F.filter(F.transform(tumor, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), _unlike(g)), lambda s: s["t"])
        if g == 0:
            indexed = F.transform(tumor, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.get(admixed, i).alias("mixed")))
            at_ref = F.transform(F.filter(indexed, lambda s: s["i"] != 0), lambda s: s["t"] + normal[0] + spread + F.when(s["mixed"], math.log(0.5)).otherwise(0.0))
            at_step = F.transform(F.filter(indexed, lambda s: s["mixed"] & (s["i"] != first_grid)), lambda s: s["t"] + normal[first_grid] + spread + math.log(0.5))
            som = P.log_sum_exp(F.concat(at_ref, at_step))
        else:
            som = P.log_sum_exp(differ) + normal[g] + spread
        out = out.withColumns({f"_s{g}0": P.log_sum_exp(same) + gt_prior[g] + math.log1p(-somatic_rate), f"_s{g}1": som + gt_prior[g] + math.log(somatic_rate)})
        names += [f"_s{g}0", f"_s{g}1"]
    out = out.withColumn("post", P.normalised(F.array(*names))).drop(*names)
    by_gt = [F.col("post")[2 * g] + F.col("post")[2 * g + 1] for g in range(3)]
    best = F.greatest(*[F.struct(p.alias("p"), F.lit(-g).alias("g")) for g, p in enumerate(by_gt)])
    out = out.withColumn("gt", -best["g"]).withColumn("qss", P.int_phred(F.col("post")[0] + F.col("post")[2] + F.col("post")[4]))
    not_nt = F.aggregate(F.filter("post", lambda p, i: i != 2 * F.col("gt") + 1), F.lit(0.0), lambda acc, p: acc + p)
    return out.withColumn("qss_nt", P.int_phred(not_nt))


def tiered(obs: DataFrame, tiers: tuple[int, ...]) -> DataFrame:
    """(pos, normal1, tumor1, normal2, tumor2, ...): likelihoods over frequencies() of both samples, of the calls of each tier's least quality and more, from one scan. Positions without calls of some sample and tier are left out.

    Calls of one position, sample, allele and quality are counted before their logs are taken, and then dealt by position:
    a sum of this many columns that is begun where calls are read holds a row of sums for every position there.
    """
    kind = ["pos", "sample", "is_alt", "q"]
    e = P.error_prob(F.greatest(F.col("q"), F.lit(1)))
    f = frequencies()
    calls = obs.select(*kind).repartition(tasks(obs), "pos").groupBy(*kind).agg(F.count("*").alias("n"))
    terms = calls.select("pos", "sample", "q", *[(F.col("n") * F.ln(F.when(F.col("is_alt"), x * (1 - e) + (1 - x) * e).otherwise((1 - x) * (1 - e) + x * e))).alias(f"t{i}") for i, x in enumerate(f)])
    sums = [F.sum(F.when((F.col("q") >= least) & (F.col("sample") == s), F.col(f"t{i}"))).alias(f"s{k}_{s}_{i}") for k, least in enumerate(tiers) for s in (0, 1) for i in range(len(f))]
    by = terms.groupBy("pos").agg(*sums)
    names = {f"{who}{k + 1}": (k, s) for k in range(len(tiers)) for who, s in (("normal", 0), ("tumor", 1))}
    seen = by.filter(" and ".join(f"s{k}_{s}_0 is not null" for k, s in names.values()))
    return seen.select("pos", *[F.array(*[f"s{k}_{s}_{i}" for i in range(len(f))]).alias(n) for n, (k, s) in names.items()])


def lower_tier(rows: DataFrame) -> DataFrame:
    """Of two tiers' results in one row (gt1, qss1, qss_nt1 and gt, qss, qss_nt of the second) the lower quality and its tier; where the tiers' genotypes differ the quality is 0."""
    return rows.withColumns({
        "tier": F.when(F.col("qss1") <= F.col("qss"), 1).otherwise(2),
        "qss_nt": F.when(F.col("gt1") != F.col("gt"), 0).otherwise(F.least("qss_nt1", "qss_nt")),
        "qss": F.least("qss1", "qss"),
        "gt": F.col("gt1"),
    })


def de_novo(trios: DataFrame, theta: float = THETA, mutation: float = 1e-8) -> DataFrame:
    """Score of a child's genotype being new, from PL arrays (child, father, mother) over the genotypes 0/0, 0/1, 1/1.

    All 27 triples are weighed by parental priors and transmission; a triple that the
    parents cannot pass on has the mutation rate.  dq = -10 log10(1 - P(new)), capped at 100, one decimal.
    """
    parent = [1 - 1.5 * theta, theta, theta / 2]
    send = [0.0, 0.5, 1.0]  # chance that a genotype passes on the alternate allele
    new, old = [], []
    for m in range(3):
        for d in range(3):
            pm, pd = send[m], send[d]
            made = [(1 - pm) * (1 - pd), pm * (1 - pd) + (1 - pm) * pd, pm * pd]
            for c in range(3):
                p = [F.pow(F.lit(10.0), -F.col(x)[i].cast("double") / 10) for x, i in (("mother", m), ("father", d), ("child", c))]
                weight = parent[m] * parent[d] * (made[c] if made[c] > 0 else mutation)
                (old if made[c] > 0 else new).append(p[0] * p[1] * p[2] * weight)
    total = lambda terms: F.aggregate(F.array(*terms), F.lit(0.0), lambda acc, x: acc + x)
    scored = trios.withColumn("_new", total(new)).withColumn("_old", total(old))
    kept = P.safe_frac(F.col("_old"), F.col("_old") + F.col("_new"))
    dq = F.least(F.lit(100.0), F.when(kept > 0, -10 * F.log10(kept)).otherwise(F.lit(100.0)))
    return scored.withColumn("dq", F.floor(dq * 10 + 0.5) / 10).drop("_new", "_old")


def haploid_called(lhoods: DataFrame, alleles: tuple[str, ...], theta: float = THETA) -> DataFrame:
    """Best single allele of positions with one copy, with its quality, from likelihoods of diploid genotypes (homozygous ones stand for the alleles)."""
    at = [i for i, (a, b) in enumerate(genotypes(alleles)) if a == b]
    prior = F.array(*[F.when(F.col("ref") == a, math.log(1 - theta)).otherwise(math.log(theta / (len(alleles) - 1))) for a in alleles])
    post = P.normalised(F.zip_with(F.array(*[F.col("lhood")[i] for i in at]), prior, lambda a, b: a + b))
    out = lhoods.withColumn("post", post)
    best = P.first_best(F.col("post"))
    return out.withColumn("allele", F.get(F.array(*map(F.lit, alleles)), best)).withColumn("gq", P.int_phred(P.complement_of_best(F.col("post"))))


def indel_rate_prior(length: Column, slope: float, intercept: float, n_alleles: Column) -> Column:
    """Mutation-rate prior of an indel by its length: exp(slope L + intercept) * 20, to the power of the new alleles."""
    return F.pow(F.exp(length * slope + intercept) * 20, n_alleles)


def nonsomatic_quality(normal: Column, tumor: Column, least: float = 0.1) -> Column:
    """Quality of both samples sharing one frequency, where variants under `least` do not count: from arrays over frequencies().

    Shared frequencies weigh one; a reference or homozygous normal with another tumour frequency weighs a half.
    """
    f = frequencies()
    valid = [i for i, x in enumerate(f) if x in (0.0, 1.0) or least - 1e-4 <= x <= 1 - least + 1e-4]
    same = P.log_sum_exp(F.array(*[normal[i] + tumor[i] for i in valid]))
    other = P.log_sum_exp(F.array(*[normal[n] + tumor[t] + math.log(0.5) for n in (0, 2) for t in valid if t != n]))
    return P.let(F.struct(same.alias("s"), other.alias("o")), lambda x: P.int_phred(1 / (1 + F.exp(x["s"] - x["o"]))))


def strand_noise(fwd: Column, rev: Column) -> Column:
    """How much likelier noise on one strand is than any frequency on both, 0 at least: from arrays over frequencies() of either strand's calls. A noise state has a frequency under one half on one strand, either one, and the reference on the other."""
    f = frequencies()
    states = [P.log_sum_exp(F.array(fwd[i] + rev[0], fwd[0] + rev[i])) + math.log(0.5) for i, x in enumerate(f) if 0 < x < 0.5]
    symmetric = [fwd[i] + rev[i] for i in range(3, len(f))]
    return F.greatest(F.lit(0.0), F.greatest(*states) - F.greatest(*symmetric))
