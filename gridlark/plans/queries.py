"""Registered queries over the driver's tables; each has the SQL that checks it in oracles.py, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions import exact_tests as X
from gridlark.functions import probability as P
from gridlark.functions import sequence as S
from gridlark.operators import alleles, errors, evaluate, filters, forest, genotype, intervals, pileup, windows
from gridlark.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tidy(x: Column, places: int = 4) -> Column:
    """Rounds half up to a few places, as the SQL side does."""
    return F.floor(x * 10**places + 0.5) / 10**places


@query
def pileup_counts(spark, d):
    out = pileup.counts(V.observations(spark, d), V.reference(spark, d), V.ALLELES)
    return out.select("pos", "ref", "alt", "used", "unused", "fwd", "n_A", "n_N", "n_R", tidy(F.col("mapq_rms")).alias("mapq_rms"), tidy(F.col("mapq0_frac")).alias("mapq0_frac"), "low_depth")


@query
def read_filter_tallies(spark, d):
    o = V.observations(spark, d)
    reason = pileup.filter_reason([("qc_fail", F.col("q") < 5), ("duplicate", (F.col("lib") % 10 == 0) & (F.col("base") == "R")), ("unmapped", F.col("mapq") == 0), ("secondary", F.col("read_pos") > 6)])
    return o.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query
def mapping_levels(spark, d):
    o = V.observations(spark, d)
    level = pileup.mapping_level(F.col("mapq"), F.col("q") < 3, F.col("read_pos") == 1, F.col("is_fwd"))
    return o.select(level.alias("level"), "sample").groupBy("level", "sample").agg(F.count("*").alias("n"))


@query
def adjusted_qualities(spark, d):
    o = V.observations(spark, d).select(P.mapq_adjusted(F.col("q"), F.col("mapq")).alias("adjusted"), "q")
    return o.groupBy("q", "adjusted").agg(F.count("*").alias("n"))


@query
def region_merge(spark, d):
    return intervals.merged(V.regions(spark, d), ["contig"], width=256)


@query
def call_region_groups(spark, d):
    return intervals.merged(V.regions(spark, d), ["contig"], gap=20, width=256)


@query
def region_coverage(spark, d):
    return intervals.coverage(V.regions(spark, d), ["contig"], width=256)


@query
def positions_in_regions(spark, d):
    r = V.typed_regions(spark, d).filter("kind = 'PROMO'").withColumn("contig", F.lit("all"))
    return intervals.positions_in(V.reference(spark, d).withColumn("contig", F.lit("all")), r, ["contig"]).select("pos", "ref")


@query
def positions_outside_regions(spark, d):
    r = V.typed_regions(spark, d).filter("kind = 'ECONOMY' and end - begin >= 30").withColumn("contig", F.lit("all"))
    return intervals.positions_in(V.reference(spark, d).withColumn("contig", F.lit("all")), r, ["contig"], how="left_anti").select("pos", "ref")


@query
def region_overlap(spark, d):
    r = V.regions(spark, d)
    return intervals.overlaps(r, r, ["contig"]).filter("id < id_b").select("contig", "id", "id_b", (F.least("end", "end_b") - F.greatest("begin", "begin_b")).alias("shared"))


@query
def region_contained(spark, d):
    r = V.typed_regions(spark, d)
    return intervals.contained(r.filter("kind < 'M'"), r.filter("kind >= 'M'"), ["contig"]).select("contig", "id")


@query
def region_payload(spark, d):
    t = V.typed_regions(spark, d)
    after = F.lead("begin").over(Window.partitionBy("contig", "kind").orderBy("begin"))
    r = t.select("contig", "kind", "begin", F.least("end", after).alias("end"), ((F.col("end") - F.col("begin")) % 2).alias("ploidy"))
    points = t.select("contig", "kind", (F.col("begin") + 25).alias("pos"))
    return intervals.payload_at(points, r, ["contig", "kind"], "ploidy", 2).select("contig", "kind", "pos", F.col("ploidy").cast("int").alias("ploidy"))


@query
def region_conflicts(spark, d):
    r = V.regions(spark, d).withColumn("kind", F.col("id") % 3)
    return intervals.conflicts(r, ["contig"], "kind").groupBy("contig").agg(F.count("*").alias("pairs"))


@query
def callable_blocks(spark, d):
    c = V.observations(spark, d).filter("q >= 17").groupBy("pos").agg(F.count("*").alias("n")).filter("n >= 18").withColumn("contig", F.lit("all"))
    return intervals.blocks(c, ["contig"], width=512)


@query
def gap_positions(spark, d):
    c = V.observations(spark, d).filter("q >= 17").groupBy("pos").agg(F.count("*").alias("n")).filter("n >= 18").withColumn("contig", F.lit("all"))
    return intervals.gaps(c, ["contig"])


@query
def genome_segments(spark, d):
    contigs = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("contig")).agg(F.sum("p_size").cast("long").alias("length"))
    return intervals.segments(contigs, 100)


@query
def median_depth(spark, d):
    depth = V.observations(spark, d).groupBy("sample", "pos").agg(F.count_if(F.expr("q >= 40")).alias("depth"))
    return pileup.median_depth_nonzero(depth, ["sample"])


@query
def region_depth(spark, d):
    depth = V.observations(spark, d).groupBy("pos").agg(F.count("*").alias("depth")).withColumn("c", F.lit(1))
    r = V.regions(spark, d).withColumn("c", F.lit(1)).select("c", "begin", "end", "id")
    return intervals.positions_in(depth, r, ["c"], how="inner").groupBy("id").agg(F.median("depth").alias("median"), F.count("*").alias("covered"))


@query
def rank_sum(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos")
    return pileup.rank_sums(o, ["pos"], "q", F.col("base") != F.col("ref")).select("pos", "n1", "n2", tidy(F.col("z")).alias("z"), tidy(F.col("mean2")).alias("mean2"))


@query
def value_statistics(spark, d):
    return V.observations(spark, d).groupBy("sample", "base").agg(F.count("*").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"), tidy(F.avg("q")).alias("mean"), tidy(F.var_samp("q")).alias("variance"))


@query
def read_position_deviation(spark, d):
    return pileup.absolute_deviation(V.observations(spark, d), ["pos"], "q").select("pos", "n", F.col("median").cast("double").alias("median"), F.col("mad").cast("double").alias("mad"))


@query
def strand_tables(spark, d):
    t = pileup.strand_tables(V.observations(spark, d), V.reference(spark, d))
    return t.select("pos", "fa", "ra", "fo", "ro", *[tidy(F.col(c)).alias(c) for c in ("log_odds", "strand_odds", "bias", "chi2")])


@query
def exact_tests(spark, d):
    """Binomial and Fisher tests of strand by position."""
    t = pileup.strand_tables(V.observations(spark, d), V.reference(spark, d))
    alt, n = F.col("fa") + F.col("ra"), F.col("fa") + F.col("ra") + F.col("fo") + F.col("ro")
    return t.select("pos", tidy(X.binom_two_sided(alt, F.col("fa"), F.lit(0.5)), 6).alias("strand_p"), tidy(X.binom_at_least(n, alt, F.lit(0.05)), 6).alias("alt_p"), tidy(X.fisher_exact("fa", "ra", "fo", "ro"), 6).alias("fisher_p"), tidy(X.fisher_exact("fa", "ra", "fo", "ro", 1), 6).alias("fisher_more"), tidy(X.fisher_exact("fa", "ra", "fo", "ro", -1), 6).alias("fisher_less"))


@query
def indel_candidacy(spark, d):
    """Positions whose alternate support is too high for errors: the least rejecting count is worked out once per depth and joined."""
    t = V.observations(spark, d).join(V.reference(spark, d), "pos").groupBy("pos").agg(F.count("*").alias("depth"), F.count_if(F.col("base") != F.col("ref")).alias("support"))
    least = t.select("depth").distinct().withColumn("least", X.min_count(F.col("depth"), F.lit(0.3), F.lit(1e-3)))
    return t.join(least, "depth").filter((F.col("support") >= F.col("least")) & (F.col("depth") >= 2)).select("pos", "depth", "support", "least")


@query
def diploid_genotypes(spark, d):
    lh = genotype.likelihoods(V.observations(spark, d).filter("q >= 17"), V.ALLELES, ["pos"]).join(V.reference(spark, d), "pos")
    return genotype.called(lh, V.ALLELES).select("pos", "ref", "depth", "gt", "gt_poly", "gq", "gq_poly", "gqx", "qual")


@query
def genotype_likelihoods(spark, d):
    lh = genotype.likelihoods(V.observations(spark, d).filter("q >= 17"), V.ALLELES, ["pos", "sample"])
    return lh.select("pos", "sample", "depth", *[tidy(F.col("lhood")[i]).alias(f"g{i}") for i in range(6)])


@query
def continuous_alleles(spark, d):
    out = genotype.continuous(V.observations(spark, d), V.reference(spark, d))
    return out.select("pos", "alt", "n", "depth", tidy(F.col("vf")).alias("vf"), "q", tidy(F.col("bias")).alias("bias"))


@query
def case_control_counts(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos")
    alt = F.col("base") != F.col("ref")
    return o.groupBy("pos").agg(*[F.count_if((F.col("sample") == s) & k).alias(f"{n}_{t}") for s, n in ((0, "normal"), (1, "tumor")) for k, t in ((alt, "alt"), (~alt, "ref"))])


def _tiers(spark, d, *tiers):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").withColumn("is_alt", F.col("base") != F.col("ref"))
    return genotype.tiered(o, tiers)


def _tier(lhoods, k):
    """The model of one tier: pos, gt, post, qss, qss_nt."""
    return genotype.somatic(lhoods.select("*", F.col(f"normal{k}").alias("normal"), F.col(f"tumor{k}").alias("tumor"))).drop("normal", "tumor")


@query
def frequency_grid(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").withColumn("is_alt", F.col("base") != F.col("ref"))
    lh = genotype.frequency_likelihoods(o.filter("q >= 25"), ["pos", "sample"])
    return lh.select("pos", "sample", *[tidy(F.col("lhood")[i]).alias(f"f{i}") for i in (1, 3, 12, 20)])


@query
def somatic_calls(spark, d):
    """Grid model at two tiers, reconciled."""
    one = _tier(_tiers(spark, d, 25, 5), 1).withColumnsRenamed({"gt": "gt1", "qss": "qss1", "qss_nt": "qss_nt1"}).drop("post")
    return genotype.lower_tier(_tier(one, 2)).select("pos", "gt", "tier", "qss", "qss_nt")


@query
def somatic_filters(spark, d):
    one = _tier(_tiers(spark, d, 25), 1)
    o = V.observations(spark, d).groupBy("pos").agg(F.count_if(F.expr("q >= 25")).alias("used"), F.count_if(F.expr("q < 25")).alias("unused"), F.count_if(F.expr("mapq = 0")).alias("spanning"))
    f = filters.somatic_snv(F.col("gt"), F.col("qss_nt"), F.col("unused"), F.col("used"), F.col("spanning"), F.col("used") + F.col("unused"), F.lit(10))
    return one.join(o, "pos").select("pos", "gt", "qss_nt", F.array_join(f, ";").alias("filters"))


@query
def sliding_region_stats(spark, d):
    site = V.observations(spark, d).groupBy("pos").agg(F.count_if(F.expr("q >= 17")).alias("used"), F.count_if(F.expr("q < 17")).alias("unused"), F.count_if(F.expr("mapq = 0")).alias("spanning"), F.count_if(F.expr("mapq < 20")).alias("submapped")).withColumn("c", F.lit(1))
    counters = ["used", "unused", "spanning", "submapped"]
    out = windows.sliding_average(site, ["c"], "pos", counters, back=49, ahead=50, width=256)
    return out.select("pos", *[tidy(F.col(f"{x}_avg")).alias(f"{x}_avg") for x in counters])


@query
def recent_flags(spark, d):
    return windows.true_count(V.observations(spark, d), ["read_id"], ["read_pos", "pos", "q"], F.col("q") >= 30, 3).groupBy("recent").agg(F.count("*").alias("n"))


@query
def mismatch_density(spark, d):
    out = pileup.mismatch_density(V.observations(spark, d), V.reference(spark, d), flank=2)
    return out.groupBy("near", "dense").agg(F.count("*").alias("n"))


@query
def active_regions(spark, d):
    e = V.event_points(spark, d).filter("value > 50")
    return windows.active_regions(e, ["contig"], gap=3600)


@query
def overlap_clusters(spark, d):
    r = V.regions(spark, d)
    out = windows.overlap_clusters(r, ["contig"], F.col("id") % 4 == 0, width=256)
    return out.select("contig", "id", F.col("cluster").cast("long").alias("cluster"), "size", "indels", "conflict")


@query
def dependent_error(spark, d):
    out = pileup.dependent_error(V.observations(spark, d))
    return out.groupBy("pos").agg(tidy(F.sum("weight")).alias("weight"), F.count_if(F.expr("weight < 0.5")).alias("discounted"))


@query
def allele_ranks(spark, d):
    by = V.observations(spark, d).groupBy("sample", "pos", "base").agg(F.count("*").alias("n"), F.sum("q").alias("support"))
    return windows.ranked(by, ["sample", "pos"], [F.desc("support"), F.col("base")], 2).select("sample", "pos", "base", "support", "rank")


@query
def allele_votes(spark, d):
    by = V.observations(spark, d).groupBy("sample", "pos", "base").agg(F.count("*").alias("n"))
    total = Window.partitionBy("sample", "pos")
    ok = by.withColumn("t", F.sum("n").over(total)).filter(F.col("n") >= F.greatest(F.lit(1.0), 0.1 * F.col("t")))
    top = windows.ranked(ok, ["sample", "pos"], [F.desc("n"), F.col("base")], 2)
    return top.groupBy("pos", "base").agg(F.sum(3 - F.col("rank")).alias("votes"))


@query
def phase_sets(spark, d):
    o = V.observations(spark, d).groupBy("read_id", "pos").agg(F.max("q").alias("q"))
    v = o.select("read_id", "pos", (F.col("q") % 2 == 0).alias("is_het"), (F.col("q") % 3).cast("int").alias("hap0"), (F.col("q") % 5).cast("int").alias("hap1"))
    return windows.phase_sets(v, ["read_id"]).select("read_id", "pos", "is_het", "ps", "flip")


@query
def site_blocks(spark, d):
    """Greedy block compression; the SQL walks the sites one by one."""
    site = V.observations(spark, d).groupBy("pos").agg(F.count_if(F.expr("q >= 17")).alias("dp"), F.count_if(F.expr("q < 17")).alias("dpf")).withColumn("contig", F.lit("all")).withColumn("state", F.col("dp") >= 15)
    return windows.site_blocks(site, ["contig"], ["state"], ["dp", "dpf"], width=1024)


@query
def germline_filters(spark, d):
    lh = genotype.likelihoods(V.observations(spark, d).filter("q >= 17"), V.ALLELES, ["pos", "sample"]).join(V.reference(spark, d), "pos")
    called = genotype.called(lh, V.ALLELES).select("pos", "sample", "ref", "gt", "gqx", "depth")
    un = V.observations(spark, d).groupBy("pos", "sample").agg(F.count_if(F.expr("q < 17")).alias("unused"))
    bits = filters.germline(F.col("gqx"), F.col("depth") + F.col("unused"), F.lit(8), F.col("unused"), F.lit(0.0), F.col("depth"))
    s = called.join(un, ["pos", "sample"]).select("pos", bits.alias("filters"), (F.col("gt") != F.concat(F.col("ref"), F.lit("/"), F.col("ref"))).alias("is_variant"))
    return filters.extended(s, ["pos"]).select("pos", F.col("locus_filters").cast("int").alias("locus_filters"), filters.rendered(F.col("locus_filters")).alias("filter"))


@query
def noise_panel(spark, d):
    return pileup.noise_panel(V.observations(spark, d).filter("q >= 45"), V.reference(spark, d), least=3, most_ratio=0.7)


@query
def basecall_patterns(spark, d):
    return errors.basecall_patterns(V.observations(spark, d), V.reference(spark, d))


@query
def merged_tallies(spark, d):
    tab = lambda s: V.observations(spark, d).filter(F.col("sample") == s).groupBy("base", "q").agg(F.count("*").alias("n"))
    return errors.merged_counts(tab(0), tab(1))


@query
def skip_tallies(spark, d):
    return errors.skip_tallies(V.observations(spark, d).groupBy("pos").agg(F.count_if(F.expr("q >= 30")).alias("depth")), 8, 18)


@query
def error_rates(spark, d):
    """Mixture fit by context; checked in tests on data made with known rates."""
    o = V.observations(spark, d).join(V.reference(spark, d), "pos")
    c = o.groupBy("pos", "ref").agg(F.count("*").alias("depth"), F.count_if((F.col("base") != F.col("ref")) & (F.col("q") < 8)).alias("alt")).groupBy("ref", "depth", "alt").agg(F.count("*").alias("n"))
    return errors.fitted_rates(c, ["ref"])


@query
def precision_recall(spark, d):
    out = evaluate.sweep(V.scored(spark, d))
    return out.select("score", "tp", "fp", "fn", "filtered", tidy(F.col("precision")).alias("precision"), tidy(F.col("recall")).alias("recall"))


@query
def calibration_bins(spark, d):
    out = evaluate.calibration(V.scored(spark, d), 5, ["lang"])
    return out.select("lang", F.col("bin").cast("int").alias("bin"), F.col("median_score").cast("double").alias("median_score"), tidy(F.col("precision")).alias("precision"), "n")


@query
def confusion_table(spark, d):
    s = V.scored(spark, d).withColumn("ptag", F.when(F.col("score") >= 50, "TP").otherwise("FP"))
    return evaluate.confusion(s, "tag", "ptag", ["TP", "FP"])


@query
def truth_match(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").filter(F.col("base") != F.col("ref"))
    q = o.filter("sample = 1 and q >= 40").select("pos", "base")
    t = o.filter("sample = 0 and q >= 40").select("pos", "base")
    return evaluate.matched(q, t, ["pos", "base"]).groupBy("tag").agg(F.count("*").alias("n"))


@query
def labelled_regions(spark, d):
    c = V.reference(spark, d).select("pos", F.lit(1).alias("c"), F.when(F.col("pos") % 10 == 0, "TP").otherwise("FP").alias("tag"))
    r = V.typed_regions(spark, d).select(F.lit(1).alias("c"), "begin", F.least("end", F.col("begin") + 9).alias("end"), F.when(F.col("kind") == "PROMO", "fp").when(F.col("kind") == "ECONOMY", "ambiguous").alias("kind")).filter("kind is not null")
    return evaluate.labelled(c, r, ["c"]).select("pos", "tag")


@query
def balanced_sample(spark, d):
    """As many rows of either tag; which ones a hash decides, so only the counts are compared."""
    return evaluate.balanced(V.scored(spark, d), "tag", ["id"]).groupBy("tag").agg(F.count("*").alias("n"))


@query
def evidence_sample(spark, d):
    """A hash-ordered prefix of orders by lines until a target is reached (a sampling operator)."""
    per = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return evaluate.until(per, "n", 20_000, ["l_orderkey"])


@query
def forest_scores(spark, d):
    """Trains a forest on embeddings (one class against the rest), exports it and scores it in the plan."""
    v = V.table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)], (F.col("label") == 1).cast("double").alias("y"))
    names = [f"x{i}" for i in range(64)]
    model = forest.exported(forest.trained(v, names, "y", trees=5, depth=3), names)
    return v.select("vec_id", tidy(forest.probability(model), 6).alias("score"))


def _pedigree(spark, d):
    """(child, father, mother): each library with the two that follow it, where there are such, as families are listed one member after the other."""
    t = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("child"))
    for i, who in ((1, "father"), (2, "mother")):
        t = t.withColumn(who, F.col("child") + i).join(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias(who)), who)
    return t.select("child", "father", "mother")


@query
def de_novo_scores(spark, d):
    """Trios of a pedigree, at each position that all three have calls for: equi-joins on (position, library)."""
    lh = genotype.likelihoods(V.observations(spark, d).withColumn("base", F.when(F.col("base") == "R", "R").otherwise("A")), ("A", "R"), ["pos", "lib"])
    pl = genotype.called(lh.withColumn("ref", F.lit("A")), ("A", "R")).select("pos", "lib", "pl")
    ped = _pedigree(spark, d).toDF("child_lib", "father_lib", "mother_lib")
    trios = pl.toDF("pos", "child_lib", "child").join(ped, "child_lib")
    for who in ("father", "mother"):
        trios = trios.join(pl.toDF("pos", f"{who}_lib", who), ["pos", f"{who}_lib"])
    return genotype.de_novo(trios).select("pos", "child_lib", "father_lib", "mother_lib", "dq")


@query
def haplotype_counts(spark, d):
    """Distinct allele strings of whole reads, with the tie-aware rank by count: counts are ranked, not strings."""
    h = V.observations(spark, d).groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_pos", "base"))), lambda s: s["base"]), "").alias("hap"))
    by = h.groupBy("hap").agg(F.count("*").alias("n"))
    levels = evaluate.level_ranks(by, "n")
    return by.join(levels, "n").select("hap", "n", "rank")


@query
def kmer_counts(spark, d):
    w = V.table(spark, d, "part").select(F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("s")).filter("length(s) >= 4")
    k = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 3), lambda i: F.substr(F.col("s"), i, F.lit(4)))).alias("kmer"))
    return k.groupBy("kmer").agg(F.count("*").alias("n"))


@query
def run_lengths(spark, d):
    """Runs of one reference allele over consecutive positions, with the run each position lies in."""
    r = V.reference(spark, d)
    blocks = None
    for a in V.ALLELES:
        b = intervals.blocks(r.filter(F.col("ref") == a).withColumn("allele", F.lit(a)), ["allele"], width=512)
        blocks = b if blocks is None else blocks.union(b)
    return blocks.select("allele", "begin", "end", (F.col("end") - F.col("begin")).alias("length"))


@query
def cigar_lengths(spark, d):
    t = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.floor("l_quantity").cast("int").cast("string"), F.lit("M"), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "R", "D").otherwise("S"), F.lit("5M")).alias("c"))
    p = S.cigar(F.col("c"))
    return t.select("l_orderkey", "l_linenumber", S.cigar_length(p, "MIS=X").alias("read_len"), S.cigar_length(p, "MDN=X").alias("ref_len"), S.cigar_count(p, "ID").alias("indels"), (S.cigar_text(p) == F.col("c")).alias("same"))


@query
def sequence_functions(spark, d):
    t = V.table(spark, d, "part").select("p_partkey", F.translate(F.regexp_replace(F.upper("p_type"), "[^A-Z]", ""), "BDEFHIJKLMNOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTACGT"[:22]).alias("s"))
    u = S.repeat_unit(F.concat("s", "s"))
    return t.select("p_partkey", "s", S.reverse_complement(F.col("s")).alias("rc"), u["unit"].alias("unit"), u["count"].alias("times"))


@query
def trimmed_alleles(spark, d):
    t = V.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("ref"), F.concat(F.left("p_name", (F.col("p_size") % 5 + 1).cast("int")), F.substr("p_name", F.lit(5))).alias("alt"))
    a = S.trimmed_allele(F.col("p_partkey"), F.col("ref"), F.col("alt"))
    return t.select("p_partkey", a["pos"].alias("pos"), a["del_len"].alias("del_len"), a["ins_seq"].alias("ins_seq"))


@query
def record_fields(spark, d):
    t = V.table(spark, d, "events").select("event_id", F.concat(F.lit("U="), F.col("user_id").cast("string"), F.lit(";T="), F.col("event_type")).alias("info"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string"), F.lit(":"), (F.col("event_id") + 1).cast("string"), F.lit("-"), (F.col("event_id") + 10).cast("string")).alias("r"))
    g = S.region_of(F.col("r"))
    return t.select("event_id", S.info_value(F.col("info"), "U").alias("u"), S.info_value(F.col("info"), "X").alias("x"), S.format_value(F.lit("GT:DP:AD"), F.concat(F.lit("0/1:"), F.col("event_id").cast("string"), F.lit(":3")), "DP").alias("dp"), g["contig"].alias("contig"), g["begin"].alias("begin"), g["end"].alias("end"))


@query
def compressed_counts(spark, d):
    n = V.table(spark, d, "orders").select((F.floor("o_totalprice") % 5000).cast("long").alias("n"))
    return n.groupBy(P.log_compressed(F.col("n")).alias("value")).agg(F.count("*").alias("rows"))


@query
def record_lines(spark, d):
    """Called sites as text records."""
    from gridlark.sources.formats import vcf_line

    c = pileup.counts(V.observations(spark, d), V.reference(spark, d), V.ALLELES)
    out = vcf_line(c, F.lit("chr1"), F.col("pos") + 1, F.col("ref"), F.col("alt"), F.lit(None), F.when(F.col("low_depth"), "LowDepth").otherwise("PASS"), [("DP", F.col("used") + F.col("unused"))], [("DP", F.col("used")), ("DPF", F.col("unused")), ("AD", F.concat_ws(",", *[F.col(f"n_{a}").cast("string") for a in V.ALLELES]))])
    return out.select("line")


@query
def contig_set_difference(spark, d):
    have = V.regions(spark, d).select("contig")
    used = V.typed_regions(spark, d).filter("kind = 'PROMO' and end - begin = 50").select("contig")
    return have.subtract(used).withColumn("state", F.lit("skipped")).union(have.intersect(used).withColumn("state", F.lit("kept")))


@query
def group_read_sets(spark, d):
    """Reads by how many alleles of interest they support: all, some, none of the pair."""
    o = V.observations(spark, d).groupBy("read_id").agg(F.bool_or(F.col("base") == "A").alias("a"), F.bool_or(F.col("base") == "R").alias("r"))
    kind = F.when(F.col("a") & F.col("r"), "both").when(F.col("a") | F.col("r"), "one").otherwise("none")
    return o.groupBy(kind.alias("kind")).agg(F.count("*").alias("reads"))


@query
def site_indel_constraints(spark, d):
    site = V.observations(spark, d).groupBy("pos").agg(F.max("q").alias("qual"), F.min("q").alias("gqx")).withColumn("c", F.lit(1))
    indel = V.table(spark, d, "part").select(F.lit(1).alias("c"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + F.col("p_size")).alias("end"), (F.col("p_size") % 40).alias("indel_qual"), (F.col("p_size") % 7).alias("indel_gqx"), (F.col("p_size") % 2 == 0).alias("filtered"))
    return alleles.site_constraints(site, indel, ["c"]).select("pos", "qual", "gqx", "conflict")


@query
def indel_signals(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos")
    return alleles.indel_signals(o, ["ref"], (F.col("q") % 9 - 4).cast("int"))


@query
def confident_support(spark, d):
    e = P.error_prob(F.greatest(F.col("q"), F.lit(1)))
    lnps = F.array(*[F.struct(F.when(F.col("base") == a, F.ln(1 - e)).otherwise(F.ln(e / 2)).alias("lnp"), F.lit(a).alias("allele")) for a in V.ALLELES])
    return alleles.support(V.observations(spark, d).select("pos", "is_fwd", lnps.alias("lnps")), ["pos"])


@query
def allele_group_likelihoods(spark, d):
    """Sums over reads of log mixes; checked in tests against plain Python."""
    e = P.error_prob(F.greatest(F.col("q"), F.lit(1)))
    o = V.observations(spark, d).withColumn("lnps", F.array(*[F.when(F.col("base") == a, F.ln(1 - e)).otherwise(F.ln(e / 2)) for a in V.ALLELES]))
    out = alleles.group_likelihoods(o, ["pos"], V.ALLELES)
    return out.select("pos", *[tidy(F.col(f"g{i}")).alias(f"g{i}") for i in range(6)])


@query
def orthogonal_alleles(spark, d):
    """Greedy choice within clusters; checked in tests for its invariants."""
    r = windows.overlap_clusters(V.regions(spark, d), ["contig"], F.lit(False), width=256)
    return alleles.orthogonal_groups(r.select("contig", "cluster", "id", "begin", "end", (F.col("id") % 13).alias("support")), ["contig"], "cluster")


@query
def homopolymer_context(spark, d):
    return alleles.homopolymer_context(V.reference(spark, d).withColumn("c", F.lit(1)), ["c"], width=512).select("pos", "ref", "length")


@query
def left_shifts(spark, d):
    s = V.table(spark, d, "part").select("p_partkey", F.translate(F.lower(F.concat("p_name", "p_type")), "bcdfghjklmnpqrstvwxyz ", "aaa").alias("s")).filter("length(s) >= 6")
    return s.select("p_partkey", alleles.left_shift(F.col("s"), F.lit(4), F.lit(2)).alias("shift"))


@query
def haplotype_alignments(spark, d):
    """Global alignments of whole names and types; checked in tests against a plain search."""
    s = V.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return alleles.aligned(s, "a", "b").select("p_partkey", "cigar")


@query
def assembled_regions(spark, d):
    """Contigs from k-mers by brand; checked in tests on reads of a known sequence."""
    return alleles.assembled(V.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.regexp_replace("p_name", " ", "").alias("seq")).filter("length(seq) >= 5"), ["brand"])


@query
def depth_limited_reads(spark, d):
    o = alleles.depth_limited(V.observations(spark, d), ["pos"], [F.desc("mapq"), F.col("read_id"), F.col("read_pos"), F.col("q")], 10)
    return o.groupBy("pos").agg(F.count("*").alias("n"), F.min("mapq").alias("lowest"))


@query
def mean_depth(spark, d):
    """Bases over covered span, by contig."""
    r = V.regions(spark, d)
    span = intervals.merged(r, ["contig"], width=256).groupBy("contig").agg(F.sum(F.col("end") - F.col("begin")).alias("span"))
    return r.groupBy("contig").agg(F.sum(F.col("end") - F.col("begin")).alias("bases")).join(span, "contig").select("contig", "bases", "span", tidy(F.col("bases") / F.col("span")).alias("depth"))


@query
def compressible_sites(spark, d):
    c = pileup.counts(V.observations(spark, d), V.reference(spark, d), V.ALLELES)
    ref_n = F.when(F.col("ref") == "A", F.col("n_A")).when(F.col("ref") == "N", F.col("n_N")).otherwise(F.col("n_R"))
    keep = V.table(spark, d, "part").filter("p_type = 'ECONOMY'").select(F.lit(1).alias("c"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + 3).alias("end"))
    ok = c.filter((F.col("used") > 0) & (ref_n / F.greatest(F.col("used"), F.lit(1)) + 0.6 > 1)).withColumn("c", F.lit(1))
    return intervals.positions_in(ok, keep, ["c"], how="left_anti").select("pos", "used")


@query
def allele_fractions(spark, d):
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").filter("q >= 20")
    return o.groupBy("pos", "sample").agg(tidy(P.safe_frac(F.count_if(F.col("base") != F.col("ref")), F.count("*"))).alias("vaf"))


@query
def panel_noise(spark, d):
    """Totals and noisy samples from DP:AD columns of a panel."""
    t = V.observations(spark, d).join(V.reference(spark, d), "pos").groupBy("pos", "lib").agg(F.count("*").alias("dp"), F.count_if(F.col("base") != F.col("ref")).alias("alt"))
    cols = t.groupBy("pos").agg(F.collect_list(F.concat_ws(":", F.col("dp").cast("string"), F.concat_ws(",", (F.col("dp") - F.col("alt")).cast("string"), F.col("alt").cast("string")))).alias("cols"))
    alt = F.transform("cols", lambda c: F.get(F.split(F.get(F.split(c, ":"), F.lit(1)), ","), F.lit(1)).cast("int"))
    return cols.select("pos", F.size("cols").alias("total"), F.size(F.filter(alt, lambda a: a > 0)).alias("noise"), F.size(F.filter(alt, lambda a: a > 1)).alias("noise2"))


@query
def callable_regions(spark, d):
    """Positions where the normal genotype or the somatic call is sure enough, as blocks."""
    one = _tier(_tiers(spark, d, 25), 1)
    sure = one.filter((F.col("qss") >= 15) | (P.int_phred(F.col("post")[1] + F.col("post")[3] + F.col("post")[5]) >= 15))
    return intervals.blocks(sure.select(F.lit("all").alias("contig"), "pos"), ["contig"], width=512)


@query
def small_indels(spark, d):
    t = V.table(spark, d, "part").select("p_partkey", F.left("p_name", (F.col("p_size") % 7 + 1).cast("int")).alias("ref"), F.when(F.col("p_size") % 11 == 0, "<DEL>").otherwise(F.left("p_type", (F.col("p_size") % 5 + 1).cast("int"))).alias("alt"))
    return t.filter(~F.col("alt").rlike(r"[<>\[\]]") & (F.length("ref") != F.length("alt")) & (F.length("ref") <= 6) & (F.length("alt") <= 6))


@query
def training_labels(spark, d):
    """Labels of candidates: masked ones are unknown, conflicts are left out."""
    s = V.scored(spark, d).withColumn("filters", F.when(F.col("score") % 10 == 0, F.array(F.lit("IndelConflict"))).otherwise(F.array(F.lit("PASS"))))
    kept = s.filter(~F.exists("filters", lambda f: f.endswith("Conflict") | (f == "OffTarget")))
    return kept.select("id", F.when(F.col("masked") == 1, "UNK").otherwise(F.col("tag")).alias("label"))


@query
def stream_window_stats(spark, d):
    """Sliding statistics of the event stream, drained."""
    from gridlark.streaming import positions

    batch = V.table(spark, d, "events")
    rows = spark.readStream.schema(batch.schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = positions.drained(positions.sliding_stats(rows, "ts", ["event_type"], "value", "6 hours", "3 hours", "1 hour"))
    return out.select(F.unix_seconds(F.col("window.start")).alias("start"), "event_type", "n", tidy(F.col("mean")).alias("mean"))


@query
def stream_clusters(spark, d):
    """Clusters of each user's events, drained; the batch form is active_regions."""
    from gridlark.streaming import positions

    batch = V.table(spark, d, "events")
    rows = spark.readStream.schema(batch.schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = positions.drained(positions.clusters(rows, "ts", ["user_id"], "2 hours", "1 hour"))
    return out.select("user_id", F.unix_micros(F.col("session_window.start")).alias("first"), "n")


@query
def rna_het_grid(spark, d):
    """Heterozygous likelihood averaged over a symmetric grid of frequencies around one half."""
    o = V.observations(spark, d).join(V.reference(spark, d), "pos").withColumn("is_alt", F.col("base") != F.col("ref")).filter("q >= 20")
    lh = genotype.frequency_likelihoods(o, ["pos"])
    at = [genotype.frequencies().index(x) for x in (0.3, 0.4, 0.5, 0.6, 0.7)]
    return lh.select("pos", tidy(P.log_sum_exp(F.array(*[F.col("lhood")[i] for i in at])) - 1.6094379124341003).alias("het"))


@query
def sample_name_map(spark, d):
    """Names to samples, one to one: a name that is missing or double is reported."""
    names = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("lib"), "s_name")
    libs = V.observations(spark, d).groupBy("lib").agg(F.count("*").alias("reads"))
    out = libs.join(names.groupBy("lib").agg(F.count("*").alias("k"), F.min("s_name").alias("name")), "lib", "left")
    return out.select("lib", "reads", F.when(F.coalesce("k", F.lit(0)) == 1, F.col("name")).alias("name"), F.when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "double").otherwise("ok").alias("state"))


@query
def strand_support_features(spark, d):
    """Features of alternate alleles for scoring: counts, fraction, mean quality, rank-sum parts, odds."""
    o = V.observations(spark, d).join(V.reference(spark, d), "pos")
    alt = F.col("base") != F.col("ref")
    f = o.groupBy("pos").agg(F.count("*").alias("depth"), F.count_if(alt).alias("alt"), F.avg(F.when(alt, F.col("q"))).alias("alt_q"), F.avg(F.when(~alt, F.col("q"))).alias("ref_q"), F.sqrt(F.avg(F.when(alt, F.col("mapq") * F.col("mapq")))).alias("alt_mapq"), F.count_if(alt & F.col("is_fwd")).alias("alt_fwd"))
    return f.select("pos", "depth", "alt", "alt_fwd", tidy(F.coalesce(F.col("alt_q"), F.lit(0.0)) - F.coalesce(F.col("ref_q"), F.lit(0.0))).alias("q_shift"), tidy(F.coalesce("alt_mapq", F.lit(0.0))).alias("alt_mapq"), tidy(P.scaled(F.col("alt") / F.col("depth"), 0.1, 0.9)).alias("scaled"))


@query
def haploid_genotypes(spark, d):
    lh = genotype.likelihoods(V.observations(spark, d).filter("q >= 17"), V.ALLELES, ["pos"]).join(V.reference(spark, d), "pos")
    return genotype.haploid_called(lh, V.ALLELES).select("pos", "ref", "allele", "gq")


@query
def indel_rate_priors(spark, d):
    t = V.table(spark, d, "part")
    return t.select("p_partkey", tidy(F.log10(genotype.indel_rate_prior(F.col("p_size"), -0.3, -20.0, F.col("p_size") % 2 + 1))).alias("log_prior"))


@query
def allele_pair_conflicts(spark, d):
    """Loci whose closed ranges, one base wider unless a mismatch, meet."""
    t = V.table(spark, d, "part").select(F.lit(1).alias("c"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + F.col("p_size") % 4 + F.when(F.col("p_size") % 3 == 0, 1).otherwise(2)).alias("end"))
    return intervals.overlaps(t, t, ["c"], width=8).filter("id < id_b").groupBy("id").agg(F.count("*").alias("conflicts"))


@query
def known_alleles(spark, d):
    """Alternate alleles seen, against known ones: an equi-join on the allele key."""
    seen = V.observations(spark, d).join(V.reference(spark, d), "pos").filter(F.col("base") != F.col("ref")).groupBy("pos", "base").agg(F.count("*").alias("n"))
    known = V.observations(spark, d).filter("mapq >= 54").select("pos", "base").distinct().withColumn("known", F.lit(True))
    return seen.join(known, ["pos", "base"], "left").select("pos", "base", "n", F.coalesce("known", F.lit(False)).alias("known"))


@query
def depth_totals(spark, d):
    """Depth by contig summed over samples, with how many samples name it."""
    per = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("contig"), (F.col("l_linenumber") % 2).alias("sample")).agg(F.count("*").alias("depth"))
    return per.groupBy("contig").agg(F.sum("depth").alias("depth"), F.count("*").alias("samples"))


@query
def trailing_ambiguous(spark, d):
    """How many ambiguous bases end each read's allele string, on the side its strand gives."""
    r = V.observations(spark, d).groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_pos", "base"))), lambda s: s["base"]), "").alias("s"), F.max("is_fwd").alias("fwd"))
    tail = F.when(F.col("fwd"), F.length(F.regexp_extract("s", "N*$", 0))).otherwise(F.length(F.regexp_extract("s", "^N*", 0)))
    return r.groupBy(tail.alias("ambiguous")).agg(F.count("*").alias("reads"))


@query
def tied_dedup(spark, d):
    """Of records equal in place and alleles the best: highest quality, then lowest id."""
    o = V.observations(spark, d)
    w = Window.partitionBy("pos", "base").orderBy(F.desc("q"), F.desc("mapq"), F.col("read_id"), F.col("read_pos"))
    return o.withColumn("r", F.row_number().over(w)).filter("r = 1").select("pos", "base", "q", "mapq", "read_id")
