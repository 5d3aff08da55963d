"""Registered queries of callers, record sinks, scoring features and helpers; their SQL is in call_oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions import exact_tests as X
from gridlark.functions import probability as P
from gridlark.functions import sequence as S
from gridlark.operators import errors, evaluate, filters, genotype, indels, intervals, pileup, windows
from gridlark.plans import views as V
from gridlark.plans.queries import tidy
from gridlark.sources import formats, models
from gridlark.sources import records as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _reads(spark, d):
    """Calls as reads of indel alleles: N stands for the reference, R for a deletion, A for an insertion; with a ln likelihood of each allele."""
    e = P.error_prob(F.greatest(F.col("q"), F.lit(1)))
    lnps = F.array(*[F.when(F.col("base") == a, F.ln(1 - e)).otherwise(F.ln(e / 2)) for a in V.ALLELES])
    return V.observations(spark, d).withColumn("allele", F.col("base")).withColumn("lnps", lnps)


def _theta(spark, d):
    """A rate for each position by its repeat context, here the size of its part."""
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.lit(1e-4) * (1 + F.col("p_size") % 20)).alias("theta"))


@query
def germline_indels(spark, d):
    out = indels.germline(_reads(spark, d), _theta(spark, d), ["pos"], V.ALLELES, "N")
    return out.select("pos", "gt", "gq", "qual", F.array_join(F.transform("pl", lambda x: x.cast("string")), ",").alias("pl"))


@query
def continuous_indels(spark, d):
    return indels.continuous(_reads(spark, d), ["pos"], "N").select("pos", "allele", "n", "fwd", "depth", tidy(F.col("vf")).alias("vf"), "q")


@query
def somatic_indels(spark, d):
    return indels.somatic(_reads(spark, d), "R", share=0.7).select("pos", "gt", "qss", "qss_nt")


@query
def somatic_indel_tallies(spark, d):
    return indels.tallies(_reads(spark, d), ["pos", "sample"], "N", "R")


@query
def somatic_indel_filters(spark, d):
    s = indels.somatic(_reads(spark, d), "R", share=0.7)
    by = V.observations(spark, d).groupBy("pos").agg(*[F.count_if(F.expr(f"sample = {i}")).alias(f"d{i}") for i in (0, 1)], *[F.avg(F.when(F.col("sample") == i, F.when(F.col("q") < 10, 1.0).otherwise(0.0))).alias(f"w{i}") for i in (0, 1)])
    f = filters.somatic_indel(F.col("gt"), F.col("qss_nt"), F.greatest("w0", "w1"), F.least("d0", "d1"), F.lit(4), min_depth=9)
    return s.join(by, "pos").select("pos", F.array_join(f, ";").alias("filters"))


@query
def floating_reads(spark, d):
    """Reads without a base on the reference, by the kind of read."""
    n = F.floor("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_returnflag") == "A", F.concat(n, F.lit("S2I"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("3H"), n, F.lit("=2D"))).otherwise(F.concat(n, F.lit("M1X")))
    return V.table(spark, d, "lineitem").select("l_linestatus", (~S.has_match(S.cigar(text))).alias("floating")).groupBy("l_linestatus", "floating").agg(F.count("*").alias("n"))


@query
def synchronised_regions(spark, d):
    """Active regions of two samples (kinds before and after M), joined."""
    t = V.typed_regions(spark, d).withColumn("sample", (F.col("kind") < "M").cast("int"))
    return windows.synchronised(t, ["contig"], width=256)


@query
def forced_alleles(spark, d):
    t = V.typed_regions(spark, d).withColumn("pos", F.col("begin"))
    regions = intervals.merged(t.filter("kind = 'PROMO'"), ["contig"], width=256)
    return windows.forced_genotyped(t.filter("kind = 'SMALL' or kind = 'LARGE'").select("contig", "pos", "kind"), t.filter("kind = 'LARGE'"), regions, ["contig"], ["kind"])


@query
def phasing_noise(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos")
    calls = o.groupBy("pos", "read_id").agg(F.count_if(F.col("base") != F.col("ref")).alias("mismatches"), F.max("is_fwd").alias("is_fwd"), F.max("q").alias("run"))
    return windows.phasing_noise(calls.filter("mismatches > 0"), ["pos"], most=45).select("pos", "mismatches", "fwd", "reads", "noise")


@query
def chromosome_depths(spark, d):
    """Median depth of covered positions by contig, exact: the quantity the reference's sampling converges to."""
    depth = V.observations(spark, d).groupBy("pos").agg(F.count_if(F.expr("q >= 25")).alias("depth"))
    contigs = V.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("contig"))
    return pileup.median_depth_nonzero(depth.join(contigs, "pos"), ["contig"])


@query
def spanned_depth(spark, d):
    return intervals.mean_depth(V.regions(spark, d), ["contig"], gap=20, width=256).select("contig", "bases", "span", tidy(F.col("depth")).alias("depth"))


@query
def contig_sets(spark, d):
    t = V.typed_regions(spark, d)
    return intervals.same_contigs(t.filter("kind = 'PROMO' and end - begin > 40"), t.filter("kind = 'SMALL' and end - begin > 40"))


@query
def shared_quality_levels(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").withColumn("alt", F.col("base") != F.col("ref"))
    out = errors.shared_levels(o.groupBy("ref", "alt", "q").agg(F.count("*").alias("n")), ["ref", "alt"])
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("ref", "alt", text("levels").alias("levels"), text("counts").alias("counts"))


@query
def soft_max_values(spark, d):
    x = (F.col("p_size") - 25) / 10
    t = V.table(spark, d, "part").select("p_partkey", P.soft_max(x).alias("p"), P.soft_max(x, 2.0, 5.0).alias("r"), P.soft_max_range(F.array(x, -x, F.lit(0.5))).alias("xs"))
    back = P.soft_max_range_inverse(F.col("xs"))
    return t.select("p_partkey", tidy(F.col("p"), 6).alias("p"), tidy(F.col("r"), 6).alias("r"), tidy(P.soft_max_inverse(F.col("p"))).alias("x"), tidy(F.col("xs")[0], 6).alias("p0"), tidy(F.col("xs")[2], 6).alias("p2"), tidy(back[2]).alias("x2"))


@query
def flank_repeat_counts(spark, d):
    """Repeats of a unit of one or two letters on the flanks of a place in a name made of few letters."""
    s = F.translate(F.lower(F.concat("p_name", "p_type", "p_name")), "bcdfghjklmnpqrstvwxyzeiou ", "aaaaaaaaaaaaaaaaaaaaabbbb")
    t = V.table(spark, d, "part").select("p_partkey", s.alias("s"), (F.col("p_size") % 6 + 3).cast("int").alias("at"), (F.col("p_size") % 2 + 1).cast("int").alias("k"))
    r = S.flank_repeats(F.substr("s", F.col("at"), F.col("k")), F.left("s", F.col("at") - 1), F.substr("s", F.col("at")))
    return t.select("p_partkey", "s", r["up"].alias("up"), r["down"].alias("down"))


@query
def ploidy_records(spark, d):
    info = F.when(F.col("p_size") % 5 == 0, "X=1").otherwise(F.concat(F.lit("SVTYPE=CNV;END="), (F.col("p_partkey") + F.col("p_size")).cast("string")))
    r = S.copy_number_region(F.col("p_partkey"), info, F.lit("GT:CN"), F.concat(F.lit("0/1:"), (F.col("p_size") % 3).cast("string")))
    return V.table(spark, d, "part").select("p_partkey", r["begin"].alias("begin"), r["end"].alias("end"), r["ploidy"].alias("ploidy"))


@query
def pl_rectified(spark, d):
    pl = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_size").cast("long"), F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long"), F.col("p_size").cast("long"), F.lit(99).cast("long")))
    t = V.table(spark, d, "part").select("p_partkey", P.rectified_pl(pl).alias("pl"))
    p = P.pl_probabilities(F.col("pl"))
    return t.select("p_partkey", F.array_join(F.transform("pl", lambda x: x.cast("string")), ",").alias("pl"), tidy(p[0] + p[1] + p[2], 6).alias("total"))


@query
def allele_bias(spark, d):
    """-ln of the binomial tails of a heterozygote's two allele counts."""
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").groupBy("pos").agg(F.count_if(F.col("base") == F.col("ref")).alias("r0"), F.count_if(F.col("base") != F.col("ref")).alias("r1"))
    tail = lambda k: -F.ln(X.binom_at_most(F.col("r0") + F.col("r1"), F.col(k), F.lit(0.5)) + 1e-30)
    t = o.select("pos", "r0", "r1", tail("r0").alias("lower"), tail("r1").alias("upper"))
    return t.select("pos", "r0", "r1", tidy(F.col("lower")).alias("lower"), tidy(F.greatest("lower", "upper")).alias("bias"))


@query
def score_overrides(spark, d):
    s = V.scored(spark, d).withColumn("filters", F.when(F.col("score") % 10 == 0, F.array(F.lit("LowEVS"), F.lit("LowDepth"))).otherwise(F.array().cast("array<string>")))
    score, kept = filters.scored(F.col("score").cast("double"), F.col("masked"), F.lit(30.0), F.col("filters"))
    return s.select("id", score.alias("score"), F.array_join(F.array_sort(kept), ";").alias("filters"))


@query
def feature_frames(spark, d):
    info = F.concat_ws(",", F.col("value").cast("decimal(20,4)").cast("string"), F.when(F.col("user_id") % 3 == 0, ".").otherwise(F.col("user_id").cast("string")), F.length("event_type").cast("string"))
    t = V.table(spark, d, "events").select("event_id", info.alias("features"))
    return evaluate.feature_frame(t, ["value", "user", "letters", "absent"])


@query
def integrated_curves(spark, d):
    t = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("lib"), F.floor("l_quantity").cast("double").alias("x")).agg((F.count("*") / 10).alias("y"))
    out = evaluate.integrated(t, ["lib"])
    return out.select("lib", tidy(F.col("area")).alias("area"), tidy(F.col("ln_area")).alias("ln_area"))


def _site_calls(spark, d):
    """Called sites of one sample with the fields of the germline sink."""
    o = V.observations(spark, d)
    called = genotype.called(genotype.likelihoods(o.filter("q >= 17"), V.ALLELES, ["pos"]).join(V.reference(spark, d), "pos"), V.ALLELES)
    n = [F.count_if((F.col("q") >= 17) & (F.col("base") == a) & s).alias(f"{t}{a}") for a in V.ALLELES for t, s in (("f", F.col("is_fwd")), ("r", ~F.col("is_fwd")))]
    c = o.groupBy("pos").agg(F.count_if(F.expr("q >= 17")).alias("dp"), F.count_if(F.expr("q < 17")).alias("dpf"), F.round(F.sqrt(F.avg(F.col("mapq") * F.col("mapq")))).cast("int").alias("mq"), *n)
    out = called.select("pos", "ref", "gt", "gq", "gqx", "qual", "pl").join(c, "pos")
    first = F.array_except(F.array(*map(F.lit, V.ALLELES)), F.array("ref"))
    return out.withColumn("alleles", F.concat(F.array("ref"), first))


@query
def germline_site_lines(spark, d):
    """Sites as records with GT:GQ:GQX:DP:DPF:AD:ADF:ADR:SB:FT:PL; all alternates are listed, and PL follows the alleles' order here."""
    s = _site_calls(spark, d)
    of = lambda t, i: F.element_at(F.map_from_arrays(F.array(*map(F.lit, V.ALLELES)), F.array(*[F.col(f"{t}{a}") for a in V.ALLELES])), F.col("alleles")[i])
    for i in range(3):
        s = s.withColumns({f"adf{i}": of("f", i), f"adr{i}": of("r", i)})
    ad = lambda t: R.counts([F.col(f"{t}{i}") for i in range(3)])
    sb = P.strand_bias(F.col("adf1") + F.col("adf2"), F.col("adr1") + F.col("adr2"), F.col("adf0"), F.col("adr0"))
    bits = filters.germline(F.col("gqx"), F.col("dp") + F.col("dpf"), F.lit(16), F.col("dpf"), F.lit(0.0), F.col("dp"))
    ft = filters.rendered(bits)
    sample = [R.genotype_numbers(F.col("gt"), F.col("alleles")), F.col("gq"), F.col("gqx"), F.col("dp"), F.col("dpf"), R.counts([F.col(f"adf{i}") + F.col(f"adr{i}") for i in range(3)]), ad("adf"), ad("adr"), F.format_number(sb + 0.0, 1), ft, F.array_join(F.transform("pl", lambda x: x.cast("string")), ",")]
    alt = F.concat_ws(",", F.slice("alleles", 2, 2))
    return s.select(R.line(F.lit("chr1"), F.col("pos") + 1, F.col("ref"), alt, F.col("qual"), ft, [("SNVHPOL", F.lit(1)), ("MQ", F.col("mq"))], R.SITE, [sample]).alias("line"))


@query
def germline_indel_lines(spark, d):
    s = indels.germline(_reads(spark, d), _theta(spark, d), ["pos"], V.ALLELES, "N")
    n = [F.count_if((F.col("base") == a) & on).alias(f"{t}{a}") for a in "NAR" for t, on in (("f", F.col("is_fwd")), ("r", ~F.col("is_fwd")))]
    c = V.observations(spark, d).groupBy("pos").agg(F.count("*").alias("dpi"), *n)
    ft = F.when(F.col("gq") < 15, "LowGQX").otherwise("PASS")
    sample = [R.genotype_numbers(F.col("gt"), F.array(*map(F.lit, "NAR"))), F.col("gq"), F.col("gq"), F.col("dpi"), R.counts([F.col(f"f{a}") + F.col(f"r{a}") for a in "NAR"]), R.counts([F.col(f"f{a}") for a in "NAR"]), R.counts([F.col(f"r{a}") for a in "NAR"]), ft, F.array_join(F.transform("pl", lambda x: x.cast("string")), ",")]
    info = [("CIGAR", F.lit("1M1I,1M1D")), ("RU", F.lit("A,.")), ("REFREP", F.lit("1,.")), ("IDREP", F.lit("2,."))]
    return s.join(c, "pos").select(R.line(F.lit("chr1"), F.col("pos") + 1, F.lit("NR"), F.lit("NRA,N"), F.col("qual"), ft, info, R.INDEL, [sample]).alias("line"))


@query
def block_lines(spark, d):
    """Blocks of sites as records with END and the smallest depth."""
    o = V.observations(spark, d).groupBy("pos").agg(F.count_if(F.expr("q >= 17")).alias("dp"), F.count_if(F.expr("q < 17")).alias("dpf"))
    site = o.withColumn("contig", F.lit("chr1")).withColumn("low", F.col("dp") < 3)
    b = windows.site_blocks(site, ["contig"], ["low"], ["dp", "dpf"], width=1024)
    b = b.join(V.reference(spark, d).toDF("begin", "ref"), "begin")
    return b.select(R.block_line(F.col("contig"), F.col("begin"), F.col("end"), F.col("ref"), F.when(F.col("low"), "LowDepth").otherwise("PASS"), F.lit(None), F.col("mean_dp"), F.col("mean_dpf"), F.col("min_dp")).alias("line"))


def _somatic_sites(spark, d, least=25):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").withColumn("is_alt", F.col("base") != F.col("ref"))
    lh = genotype.frequency_likelihoods(o.filter(F.col("q") >= least), ["pos", "sample"])
    both = lh.groupBy("pos").agg(F.max(F.when(F.col("sample") == 0, F.col("lhood"))).alias("normal"), F.max(F.when(F.col("sample") == 1, F.col("lhood"))).alias("tumor"))
    return genotype.somatic(both.filter("normal is not null and tumor is not null"))


def _normal_type(gt):
    return F.get(F.array(*map(F.lit, ("ref", "het", "hom"))), gt)


@query
def somatic_site_lines(spark, d):
    s = _somatic_sites(spark, d)
    names = [(i, t) for i, t in ((0, "n"), (1, "t"))]
    aggs = []
    for i, t in names:
        own = F.col("sample") == i
        aggs += [F.count_if(own).alias(f"{t}dp"), F.count_if(own & (F.col("q") < 25)).alias(f"{t}fdp")]
        aggs += [F.concat_ws(",", F.count_if(own & (F.col("base") == a) & (F.col("q") >= 25)).cast("string"), F.count_if(own & (F.col("base") == a)).cast("string")).alias(f"{t}{a}") for a in V.ALLELES]
    c = V.observations(spark, d).groupBy("pos").agg(F.count_if(F.expr("mapq = 0")).alias("mq0"), *aggs).join(V.reference(spark, d), "pos")
    nt = _normal_type(F.col("gt"))
    ft = F.when((F.col("gt") != 0) | (F.col("qss_nt") < 15), "QSS_ref").otherwise("PASS")
    sample = lambda t: [F.col(f"{t}dp"), F.col(f"{t}fdp"), F.lit(0), F.lit(0), *[F.col(f"{t}{a}") for a in V.ALLELES]]
    info = [("SOMATIC", None), ("QSS", F.col("qss")), ("TQSS", F.lit(1)), ("NT", nt), ("QSS_NT", F.col("qss_nt")), ("TQSS_NT", F.lit(1)), ("MQ0", F.col("mq0"))]
    return s.join(c, "pos").select(R.line(F.lit("chr1"), F.col("pos") + 1, F.col("ref"), F.lit("."), F.lit(None), ft, info, R.SOMATIC_SITE + [f"{a}U" for a in V.ALLELES], [sample("n"), sample("t")]).alias("line"))


@query
def somatic_indel_lines(spark, d):
    s = indels.somatic(_reads(spark, d), "R", share=0.7)
    t = indels.tallies(_reads(spark, d), ["pos", "sample"], "N", "R")
    both = lambda kind, i: F.col(f"{kind}{i}_fwd") + F.col(f"{kind}{i}_rev")
    text = F.concat_ws(":", *[(both("ref", i) + both("indel", i) + both("other", i)).cast("string") for i in (1, 2)], *[F.concat_ws(",", both(k, 1).cast("string"), both(k, 2).cast("string")) for k in ("ref", "indel", "other")])
    own = t.groupBy("pos").agg(*[F.max(F.when(F.col("sample") == i, text)).alias(n) for i, n in ((0, "normal"), (1, "tumor"))])
    ft = F.when((F.col("gt") != 0) | (F.col("qss_nt") < 30), "QSI_ref").otherwise("PASS")
    info = [("SOMATIC", None), ("QSI", F.col("qss")), ("NT", _normal_type(F.col("gt"))), ("QSI_NT", F.col("qss_nt"))]
    return s.select("pos", "gt", "qss", "qss_nt").join(own, "pos").select(R.line(F.lit("chr1"), F.col("pos") + 1, F.lit("NR"), F.lit("N"), F.lit(None), ft, info, R.SOMATIC_INDEL, [[F.col("normal")], [F.col("tumor")]]).alias("line"))


@query
def likelihood_ratio_tests(spark, d):
    """A site's alternate share against a fixed error share, by the likelihood ratio."""
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").groupBy("pos").agg(F.count("*").alias("n"), F.count_if(F.col("base") != F.col("ref")).alias("k"))
    ln = lambda p: F.when(F.col("k") > 0, F.col("k") * F.ln(p)).otherwise(0.0) + F.when(F.col("n") > F.col("k"), (F.col("n") - F.col("k")) * F.ln(1 - p)).otherwise(0.0)
    p = X.likelihood_ratio_p(ln(F.lit(0.6)), ln(F.col("k") / F.col("n")))
    return o.select("pos", "n", "k", (p < 0.05).alias("rejected"))


@query
def normalised_records(spark, d):
    t = V.table(spark, d, "part").select("p_partkey", F.left("p_name", (F.col("p_size") % 4 + 1).cast("int")).alias("ref"), F.left("p_type", (F.col("p_size") % 3 + 1).cast("int")).alias("alt"))
    t = t.withColumns({"ref": F.translate(F.lower("ref"), "bcdfghjklmnpqrstvwxyz", "aaaaa"), "alt": F.translate(F.lower("alt"), "bcdfghjklmnpqrstvwxyz", "aaaaa")})
    return t.select("p_partkey", "ref", "alt", S.is_normalised(F.col("ref"), F.col("alt")).alias("normalised"), S.variant_class(F.upper("ref"), F.upper("alt")).alias("kind"))


@query
def dependent_genotypes(spark, d):
    """Diploid genotypes with errors that depend on each other: each call's error takes the exponent of its rank among calls of its strand and allele."""
    weighted = pileup.dependent_error(V.observations(spark, d).filter("q >= 17"))
    e = F.least(F.lit(0.75), F.pow(P.error_prob(F.greatest(F.col("q"), F.lit(1))), F.col("weight")))
    lh = genotype.likelihoods(weighted, V.ALLELES, ["pos"], e).join(V.reference(spark, d), "pos")
    return genotype.called(lh, V.ALLELES).select("pos", "gt", "gq", "qual", *[tidy(F.col("lhood")[i]).alias(f"g{i}") for i in (0, 3)])


@query
def somatic_callability(spark, d):
    """Non-somatic quality, and how much likelier strand noise is than a variant of the tumour."""
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").withColumn("is_alt", F.col("base") != F.col("ref")).filter("q >= 25")
    lh = genotype.frequency_likelihoods(o, ["pos", "sample", "is_fwd"])
    none = F.array_repeat(F.lit(0.0), len(genotype.frequencies()))
    take = lambda s, f: F.coalesce(F.max(F.when((F.col("sample") == s) & (F.col("is_fwd") == f), F.col("lhood"))), none)
    t = lh.groupBy("pos").agg(take(0, True).alias("nf"), take(0, False).alias("nr"), take(1, True).alias("tf"), take(1, False).alias("tr"))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    t = t.withColumns({"n": both("nf", "nr"), "t": both("tf", "tr")})
    return t.select("pos", genotype.nonsomatic_quality(F.col("n"), F.col("t")).alias("nqss"), tidy(genotype.strand_noise(F.col("tf"), F.col("tr"))).alias("snvsb"))


@query
def repeat_tracts(spark, d):
    """Tandem repeats and encodable contexts of a name made of few letters."""
    s = F.translate(F.lower(F.concat("p_name", "p_type", "p_name")), "bcdfghjklmnpqrstvwxyzeiou ", "aaaaaaaaaaaaaaaaaaaaabbbb")
    t = V.table(spark, d, "part").select("p_partkey", s.alias("s"), (F.col("p_size") % 9).cast("int").alias("at"), (F.col("p_size") % 2 + 1).cast("int").alias("k"))
    return t.select("p_partkey", S.tandem_count(F.col("s"), F.col("at"), F.col("k")).alias("repeats"), S.encodable(F.col("s"), 3).alias("encoded"), S.compressibility(F.col("s"), F.col("at"), F.col("at") + 1, 4).alias("context"))


@query
def stream_coverage(spark, d):
    """Running counts by user, closed once the watermark has passed them and drained: users without a later event by then are still open."""
    from gridlark.streaming import positions

    batch = V.table(spark, d, "events")
    rows = spark.readStream.schema(batch.schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return positions.drained(positions.coverage_runs(rows, "ts", "user_id", "1 hour"), "append")


@query
def error_rate_lookup(spark, d):
    t = V.table(spark, d, "part")
    model = t.filter("p_type <> 'PROMO' or p_size < 20").groupBy((F.col("p_size") % 2 + 1).alias("pattern"), (F.col("p_size") % 7 + 1).alias("count")).agg((F.min("p_size") * 1e-4).alias("rate"))
    rows = t.select("p_partkey", (F.col("p_size") % 3 + 1).alias("pattern"), (F.col("p_size") % 9 + 1).alias("count"), (F.col("p_type") == "SMALL").alias("is_complex"))
    return models.looked_up(rows, model).select("p_partkey", tidy(F.col("rate"), 6).alias("rate"))


@query
def rethresholded(spark, d):
    s = V.scored(spark, d).withColumn("filters", F.when(F.col("score") % 10 == 0, F.array(F.lit("LowEVS"), F.lit("LowDepth"))).otherwise(F.array().cast("array<string>")))
    return s.select("id", F.array_join(F.array_sort(filters.rethreshold(F.col("filters"), F.col("score"), 40)), ";").alias("filters"))


@query
def sorted_variants(spark, d):
    """Records in order of contig rank and position, one of equal ones."""
    t = V.table(spark, d, "part")
    contigs = t.groupBy(F.col("p_brand").alias("contig")).agg(F.max("p_partkey").alias("top"))
    contigs = contigs.join(evaluate.level_ranks(contigs, "top"), "top").select("contig", "rank")
    o = V.observations(spark, d).join(t.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("chrom")), "pos")
    rows = o.select("chrom", "pos", (F.col("pos") + 1).alias("end"), F.lit("X").alias("ref"), F.col("base").alias("alt"), F.when(F.col("mapq") >= 20, "PASS").otherwise("LowMQ").alias("filter"), F.col("q").cast("double").alias("qual"), (F.col("read_id") * 10 + F.col("read_pos")).alias("id"))
    return formats.sorted_records(rows, contigs).join(contigs.withColumnRenamed("contig", "chrom"), "chrom").select("chrom", "pos", "alt", "qual", "id", "rank")


@query
def merged_streams(spark, d):
    a = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("contig"), F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("a"))
    b = V.table(spark, d, "part").select(F.col("p_brand").alias("contig"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("b"))
    return formats.merged_sources(a, b)


@query
def genotype_indices(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.genotype_index(F.col("p_size") % 5, F.col("p_size") % 7).cast("long").alias("place"))


@query
def matched_depth(spark, d):
    """Depth from the stretches of reads that stand on the reference, not from their whole spans."""
    text = F.concat(F.floor("l_quantity").cast("int").cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("D4I7M"))
    t = V.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("contig"), F.explode(S.match_segments(S.cigar(text), F.col("l_partkey"))).alias("m"))
    return intervals.coverage(t.select("contig", "m.begin", "m.end"), ["contig"], width=256)
