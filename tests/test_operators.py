"""Operators against brute force on small tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators import errors, evaluate, filters, forest, genotype, intervals, pileup, windows
from gridlark.operators.running import running
from gridlark.sources import formats


def test_merge_fixture(spark, rows):
    regions = lambda *x: spark.createDataFrame([("c", *r) for r in x], "c string, begin long, end long")
    assert rows(intervals.merged(regions((5, 10), (2, 3), (3, 7)), ["c"], width=4), "begin", "end") == [(2, 10)]
    assert len(rows(intervals.merged(regions((5, 10), (2, 3), (2, 4)), ["c"], width=4))) == 2
    assert rows(intervals.merged(regions(), ["c"])) == []


@pytest.mark.parametrize("seed", range(3))
def test_intervals_brute_force(spark, rows, seed):
    rnd = random.Random(seed)
    r = [(rnd.choice("ab"), b := rnd.randrange(60), b + rnd.randrange(0, 9), i) for i in range(40)]
    df = spark.createDataFrame(r, "c string, begin long, end long, id int")
    want = {}
    for c, b, e, _ in r:
        for p in range(b, e):
            want[c, p] = want.get((c, p), 0) + 1
    got = {(x.c, p): x.depth for x in intervals.coverage(df, ["c"], width=8).collect() for p in range(x.begin, x.end)}
    assert got == want
    covered = {(x.c, p) for x in intervals.merged(df, ["c"], width=8).collect() for p in range(x.begin, x.end)}
    assert covered == set(want)
    pairs = {(a[3], b[3]) for a in r for b in r if a[0] == b[0] and a[3] < b[3] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2]}
    found = [(x.id, x.id_b) for x in intervals.overlaps(df, df, ["c"], width=4).filter("id < id_b").collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    points = spark.createDataFrame([(c, p) for c in "ab" for p in range(70)], "c string, pos long")
    assert set(rows(intervals.positions_in(points, df, ["c"], width=4))) == set(want)


def test_running_bins_agree(spark):
    rnd = random.Random(4)
    data = [("x", rnd.randrange(50), i, rnd.randrange(9)) for i in range(60)]
    df = spark.createDataFrame(data, "k string, pos long, i int, v int")
    out = running(df, ["k"], "pos", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, ["i"], width=7).collect()
    s, m = 0, -1
    want = {}
    for _, _, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        s, m = s + v, max(m, v)
        want[i] = (s, m)
    assert {r.i: (r.s, r.m) for r in out} == want


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16])
def test_site_blocks_sequential_model(spark, width):
    """A block's result does not depend on how positions are cut into bins."""
    rnd = random.Random(5)
    sites = [(c, p, rnd.random() < 0.95, rnd.randrange(1, 40)) for c in "cd" for p in range(300) if rnd.random() < 0.97]
    df = spark.createDataFrame(sites, "c string, pos long, state boolean, v int")
    got = sorted((r.c, r.begin, r.end, r.min_v, r.mean_v) for r in windows.site_blocks(df, ["c"], ["state"], ["v"], width=width).collect())
    want, cur = [], []
    done = lambda c: (c[0][0], c[0][1], c[-1][1] + 1, min(x[3] for x in c), int(sum(x[3] for x in c) / len(c) + 0.5))
    for site in sites:
        v = [x[3] for x in [*cur, site]]
        if cur and site[0] == cur[-1][0] and site[1] == cur[-1][1] + 1 and site[2] == cur[-1][2] and min(v) + max(3, int(min(v) * 0.3)) >= max(v) / 2:
            cur.append(site)
        else:
            want += [done(cur)] if cur else []
            cur = [site]
    assert got == sorted([*want, done(cur)])


def test_interval_joins_of_all_lengths(spark):
    """Points and intervals from one base to the whole contig, against every pair."""
    rnd = random.Random(6)
    ivs = [(rnd.choice("cd"), b := rnd.randrange(100_000), b + max(0, int(10 ** rnd.uniform(-0.5, 5))), i) for i in range(150)]
    pts = [(rnd.choice("cd"), rnd.randrange(120_000), i) for i in range(300)]
    r = spark.createDataFrame(ivs, "c string, begin long, end long, id long")
    p = spark.createDataFrame(pts, "c string, pos long, k long")
    inside = {(k, i) for c, x, k in pts for d, b, e, i in ivs if c == d and b <= x < e}
    assert {(x.k, x.id) for x in intervals.positions_in(p, r, ["c"], how="inner").collect()} == inside
    assert sorted(x.k for x in intervals.positions_in(p, r, ["c"]).collect()) == sorted({k for k, _ in inside})
    assert sorted(x.k for x in intervals.positions_in(p, r, ["c"], how="left_anti").collect()) == sorted({k for _, _, k in pts} - {k for k, _ in inside})
    left = [(x.k, x.id) for x in intervals.positions_in(p, r, ["c"], how="left").collect()]
    assert set(left) == inside | {(k, None) for _, _, k in pts if k not in {a for a, _ in inside}} and len(left) == len(set(left))
    pairs = [(x.id, x.id_b) for x in intervals.overlaps(r, r, ["c"]).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for c, b, e, i in ivs for d, f, g, j in ivs if c == d and b < g and f < e and b < e and f < g}


def _somatic_model(normal, tumor):
    f = genotype.frequencies()
    n, theta, rate, shared = len(f), 0.001, 1e-6, 5e-6
    spread = -math.log(n - 1)
    prior = [math.log(1 - 1.5 * theta), math.log(theta), math.log(theta / 2)]
    lse = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    s = {}
    for g in range(3):
        s[g, 0] = lse([(math.log1p(-shared) if i == g else math.log(shared) + spread) + normal[i] + tumor[i] for i in range(n)]) + prior[g] + math.log(1 - rate)
        terms = []
        for t in range(n):
            for m in range(n):
                if m == t:
                    continue
                if g == 0 and 0.15 * f[t] >= 0.05 and m in (0, 3):
                    terms.append(spread + math.log(0.5) + normal[m] + tumor[t])
                elif m == g and not (g == 0 and 0.15 * f[t] >= 0.05):
                    terms.append(spread + normal[m] + tumor[t])
        s[g, 1] = lse(terms) + prior[g] + math.log(rate)
    total = lse(list(s.values()))
    return {k: math.exp(v - total) for k, v in s.items()}


def test_somatic_grid(spark):
    rnd = random.Random(6)
    data = [(i, [-rnd.random() * 60 for _ in range(21)], [-rnd.random() * 60 for _ in range(21)]) for i in range(20)]
    out = genotype.somatic(spark.createDataFrame(data, "i int, normal array<double>, tumor array<double>")).collect()
    for r in out:
        p = _somatic_model(data[r.i][1], data[r.i][2])
        assert [r.post[2 * g + s] for g in range(3) for s in range(2)] == pytest.approx([p[g, s] for g in range(3) for s in range(2)], abs=1e-9)
        assert r.gt == max(range(3), key=lambda g: p[g, 0] + p[g, 1])


def test_de_novo(spark):
    df = spark.createDataFrame([(1, [500, 0, 500], [0, 300, 900], [0, 300, 900]), (2, [500, 0, 500], [500, 0, 500], [0, 300, 900])], "i int, child array<int>, father array<int>, mother array<int>")
    dq = {r.i: r.dq for r in genotype.de_novo(df).collect()}
    assert dq[1] > 20 and dq[2] < 1


def test_fitted_rates(spark):
    rnd = random.Random(7)
    data = {}
    for _ in range(4000):
        p = 0.03 if rnd.random() < 0.3 else 1e-8
        k = sum(rnd.random() < p for _ in range(60))
        data["c", 60, k] = data.get(("c", 60, k), 0) + 1
    df = spark.createDataFrame([(*k, n) for k, n in data.items()], "ctx string, depth int, alt int, n long")
    r = errors.fitted_rates(df, ["ctx"]).first()
    assert r.rate == pytest.approx(0.03, rel=0.15) and r.noisy_share == pytest.approx(0.3, rel=0.2)


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, 1, True), (1, 0, True), (2, 1, True), (2, 3, False)], "l int, filters int, is_variant boolean")
    assert rows(filters.extended(df, ["l"]), "l", "locus_filters") == [(1, 0), (2, 129)]
    r = spark.range(1).select(filters.rendered(F.lit(129)), filters.rendered(F.lit(0)), filters.rethreshold(F.array(F.lit("LowEVS"), F.lit("x")), F.lit(0.9), 0.5)).first()
    assert (r[0], r[1], r[2]) == ("LowGQX;NoPassedVariantGTs", "PASS", ["x"])


def test_balanced_and_prefix(spark):
    df = spark.createDataFrame([(i, "a" if i % 5 else "b", 2) for i in range(200)], "id int, tag string, w int")
    assert {r.tag: r["count"] for r in evaluate.balanced(df, "tag", ["id"]).groupBy("tag").count().collect()} == {"a": 40, "b": 40}
    assert evaluate.until(df, "w", 31, ["id"]).count() == 16


def test_forest_export_scores_like_the_model(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, x := rnd.random(), y := rnd.random(), float(x + y > 1)) for i in range(300)], "i int, x double, y double, label double")
    model = forest.trained(df, ["x", "y"], "label", trees=3, depth=3)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    want = {r.i: r.p for r in model.transform(VectorAssembler(inputCols=["x", "y"], outputCol="_x").transform(df)).select("i", vector_to_array("probability")[1].alias("p")).collect()}
    exported = json.loads(json.dumps(forest.exported(model, ["x", "y"])))
    got = {r.i: r.p for r in df.select("i", forest.probability(exported).alias("p")).collect()}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        forest.merged_models({"a": {"b": 1}}, {"a": {"b": 2}})


def test_formats(spark, rows, tmp_path):
    vcf = tmp_path / "a.vcf"
    vcf.write_text("##x\n#CHROM\nc1\t5\t.\tA\tT,G\t12.5\tPASS\tDP=3;X=y\tGT:DP\t0/1:3\nc1\t7\t.\tAT\tA\t.\tLow;Q\t.\tGT\t0/0\n")
    got = formats.read_vcf(spark, str(vcf))
    assert rows(got, "pos", "ref", "alt", "qual") == [(5, "A", ["T", "G"], 12.5), (7, "AT", ["A"], None)]
    bad = tmp_path / "b.vcf"
    bad.write_text("c1\t7\t.\tAT\tCT\t.\t.\t.\n")
    with pytest.raises(Exception, match="not normalised"):
        formats.read_vcf(spark, str(bad), strict=True).collect()
    bed = tmp_path / "a.bed"
    bed.write_text("c1\t5\t9\tx\nc1\t9\t9\ty\n")
    assert rows(formats.read_bed(spark, str(bed), skip_invalid=True), "begin", "end") == [(5, 9)]
    with pytest.raises(Exception, match="empty or reversed"):
        formats.read_bed(spark, str(bed)).collect()
    fasta = tmp_path / "a.fa"
    fasta.write_text(">c1 note\nacgt\nRA\n>c2\nTT\n")
    assert rows(formats.read_fasta(spark, str(fasta))) == [("c1", "ACGTNA"), ("c2", "TT")]
    sam = tmp_path / "a.sam"
    sam.write_text("@HD\nr1\t99\tc1\t11\t60\t3M1I\t=\t20\t5\tACGT\tIIII\n")
    r = formats.read_sam(spark, str(sam)).first()
    assert (r.pos, r.is_proper, r.unmapped, [tuple(x) for x in r.cigar], r.qual) == (10, True, False, [("M", 3), ("I", 1)], [40] * 4)


def test_sorted_records(spark, rows):
    rec = spark.createDataFrame([("b", 5, "A", "T", "Low", 90.0, "1", 5), ("b", 5, "A", "T", "PASS", 10.0, "2", 5), ("a", 9, "A", "<DEL>", "PASS", None, "3", 20)], "chrom string, pos long, ref string, alt string, filter string, qual double, id string, end long")
    contigs = spark.createDataFrame([("b", 0), ("a", 1)], "contig string, rank int")
    assert [r.id for r in formats.sorted_records(rec, contigs).collect()] == ["2", "3"]


def test_rank_sum_brute_force(spark):
    rnd = random.Random(9)
    data = [(k, rnd.randrange(8), rnd.random() < 0.4) for k in range(5) for _ in range(20)]
    for r in pileup.rank_sums(spark.createDataFrame(data, "k int, v int, alt boolean"), ["k"], "v", F.col("alt")).collect():
        a, b = [v for k, v, s in data if k == r.k and not s], [v for k, v, s in data if k == r.k and s]
        every = sorted(a + b)
        rank = lambda v: (2 * every.index(v) + every.count(v) + 1) / 2
        w1, w2 = sum(map(rank, a)), sum(map(rank, b))
        n, m, w = (len(b), len(a), w2) if w1 > w2 else (len(a), len(b), w1)
        mean = n * (n + m + 1) / 2
        assert r.z == pytest.approx((w - mean) / math.sqrt(m * mean / 6))


def _score(cigar, a, b):
    """Of an alignment: matches 2, mismatches -3, a gap -5 and -1 for each base. Also checks that it fits both sequences."""
    import re

    i = j = total = 0
    for n, op in re.findall(r"(\d+)([=XID])", cigar):
        n = int(n)
        if op in "=X":
            assert all((a[i + k] == b[j + k]) == (op == "=") for k in range(n))
            total += n * (2 if op == "=" else -3)
            i, j = i + n, j + n
        else:
            total += -5 - n
            i, j = (i + n, j) if op == "D" else (i, j + n)
    assert (i, j) == (len(a), len(b))
    return total


def test_alignment_is_optimal():
    from functools import cache

    from gridlark.operators.alleles import align

    rnd = random.Random(10)
    for _ in range(40):
        a, b = ("".join(rnd.choice("AC") for _ in range(rnd.randrange(0, 7))) for _ in range(2))

        @cache
        def best(i, j, gap):
            if i == len(a) and j == len(b):
                return 0
            out = []
            if i < len(a) and j < len(b):
                out.append((2 if a[i] == b[j] else -3) + best(i + 1, j + 1, ""))
            if i < len(a):
                out.append(-1 - 5 * (gap != "D") + best(i + 1, j, "D"))
            if j < len(b):
                out.append(-1 - 5 * (gap != "I") + best(i, j + 1, "I"))
            return max(out)

        assert _score(align(a, b), a, b) == best(0, 0, "")


def test_assembly_finds_the_sequence(spark):
    from gridlark.operators.alleles import assembled

    whole = "ACGTTGCAAGGCTTACCGATAGGATCCA"
    reads = [("r", whole[i : i + 12]) for i in range(len(whole) - 11)] * 3
    out = assembled(spark.createDataFrame(reads, "k string, seq string"), ["k"], k=6).first()
    assert out.contig == whole


def test_assembly_uses_every_kmer(spark):
    from gridlark.operators.alleles import assembled

    wholes = ["ACGTTGCAAGGCTTACC", "GGGATTTCTCTAGAAAT"]
    reads = [("r", w[i : i + 9]) for w in wholes for i in range(len(w) - 8)] * 3
    out = assembled(spark.createDataFrame(reads, "k string, seq string"), ["k"], k=6).collect()
    assert sorted(r.contig for r in out) == sorted(wholes)
    assert sum(r.kmers for r in out) == len({w[i : i + 6] for w in wholes for i in range(len(w) - 5)})


def test_orthogonal_groups_keep_ploidy(spark):
    from gridlark.operators.alleles import orthogonal_groups

    rnd = random.Random(11)
    rows = [("c", 1, i, b := rnd.randrange(30), b + rnd.randrange(1, 6), rnd.randrange(9)) for i in range(40)]
    taken = {r.id for r in orthogonal_groups(spark.createDataFrame(rows, "c string, k int, id long, begin long, end long, support int"), ["c"], "k").collect() if r.taken}
    depth = lambda p, ids: sum(r[3] <= p < r[4] for r in rows if r[2] in ids)
    assert all(depth(p, taken) <= 2 for p in range(40))
    for r in rows:  # what was left out would not fit
        if r[2] not in taken:
            assert any(depth(p, taken) >= 2 for p in range(r[3], r[4]))


def test_models(spark, tmp_path):
    from gridlark.sources import models

    path = tmp_path / "m.json"
    path.write_text(json.dumps({"sample": [{"isStatic": True, "sampleName": "s", "motif": [{"indelRate": 0.1, "noisyLocusRate": 0.2, "repeatCount": 1, "repeatPatternSize": 1}, {"indelRate": 0.3, "noisyLocusRate": 0.2, "repeatCount": 4, "repeatPatternSize": 2}]}]}))
    model = models.read_error_model(spark, str(path))
    rows = spark.createDataFrame([(1, 2, 4, False), (2, 2, 4, True), (3, 9, 9, False)], "i int, pattern int, count int, is_complex boolean")
    assert {r.i: r.rate for r in models.looked_up(rows, model).collect()} == {1: 0.3, 2: 0.1, 3: 0.1}
    a, b = spark.createDataFrame([("c", 1.5)], "contig string, depth double"), spark.createDataFrame([("c", 2.0)], "contig string, depth double")
    assert models.summed_depths(a, b).first().depth == 3.5
    with pytest.raises(Exception, match="not in every table"):
        models.summed_depths(a, b.withColumn("contig", F.lit("d"))).collect()


def test_equal_genotypes_do_not_depend_on_the_order_of_reads(spark):
    """Two alternates with the same qualities tie: the first genotype is called, in whatever order the logs are added up."""
    calls = [("N", 31), ("N", 25), ("N", 19), *((b, q) for b in "AR" for q in (17, 20, 28))]
    rnd = random.Random(1)
    obs = spark.createDataFrame([(pos, *c) for pos in range(300) for c in rnd.sample(calls, len(calls))], "pos long, base string, q int").coalesce(1)
    lh = genotype.likelihoods(obs, ("A", "N", "R"), ["pos"]).withColumn("ref", F.lit("N"))
    out = genotype.called(lh, ("A", "N", "R")).select("gt", "gt_poly", "gqx").distinct().collect()
    assert [(r.gt, r.gt_poly, r.gqx) for r in out] == [("A/N", "A/N", 3)]
    hap = spark.createDataFrame([("N", [x, -9.0, -9.0, -9.0, -9.0, -5.0]) for x in (-5.000000000000001, -4.999999999999999)], "ref string, lhood array<double>")
    assert {r.allele for r in genotype.haploid_called(hap.withColumn("lhood", F.expr("transform(lhood, (x, i) -> if(i = 2, -30D, x))")), ("A", "N", "R")).collect()} == {"A"}


def test_coverage_reads_regions_once_in_tasks_that_grow_in_number(spark, rows, tmp_path, monkeypatch):
    """What a task holds is bounded: rows are dealt by the size of the files, and regions are worked out once."""
    from gridlark.operators import running as R

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    spark.range(3000).selectExpr("cast(id % 3 as string) c", "id * 5 begin", "id * 5 + id % 17 end").write.parquet(f"{tmp_path}/r")
    read = spark.read.parquet(f"{tmp_path}/r")
    out = intervals.coverage(read.mapInArrow(counted, read.schema), ["c"], width=64)
    deep = {}
    for r in read.collect():
        for p in range(r.begin, r.end):
            deep[r.c, p] = deep.get((r.c, p), 0) + 1
    assert {(r.c, p): r.depth for r in out.collect() for p in range(r.begin, r.end)} == deep
    assert seen.value == 3000
    least = spark.sparkContext.defaultParallelism
    assert R.tasks(read) == least
    monkeypatch.setattr(R, "DEALT", 1 << 10)
    assert R.tasks(read) > least and R.tasks(read.union(read)) > 1.5 * R.tasks(read)
    assert intervals.merged(read, ["c"], width=64).count() == len(rows(intervals.merged(read, ["c"])))


def test_tiers_deal_calls_by_position_before_sums_begin(spark):
    """The many sums of a position begin after the shuffle; the same calls, counted, give the same sums."""
    rnd = random.Random(3)
    rows = [(p, s, rnd.random() < 0.3, rnd.choice((3, 12, 30, 41))) for p in range(40) for s in (0, 1) for _ in range(rnd.randrange(0, 9))]
    obs = spark.createDataFrame(rows, "pos long, sample int, is_alt boolean, q int")
    out = genotype.tiered(obs, (25, 5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pos") == 1 and "sum(" not in plan[plan.index("Exchange hashpartitioning(pos") :]
    want = {}
    for t, least in ((1, 25), (2, 5)):
        for s, who in ((0, "normal"), (1, "tumor")):
            lh = genotype.frequency_likelihoods(obs.filter((F.col("q") >= least) & (F.col("sample") == s)), ["pos"])
            want[f"{who}{t}"] = {r.pos: r.lhood for r in lh.collect()}
    got = {r.pos: r for r in out.collect()}
    assert set(got) == set.intersection(*map(set, want.values())) and got
    for p, r in got.items():
        for n, by in want.items():
            assert r[n] == pytest.approx(by[p], abs=1e-9)
