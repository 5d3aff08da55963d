"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlark.operators import evaluate
from gridlark.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return bool(x) if "bool" in type(x).__name__ else int(x) if hasattr(x, "__index__") else str(x)


def table(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.toPandas()) == table(want) and len(want)


#: Queries that SQL does not express; each has a test of its values below.
WITHOUT_SQL = {"assembled_regions", "error_rates", "evidence_sample", "forest_scores", "haplotype_alignments", "orthogonal_alleles"}


def test_every_query_is_checked():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


def test_evidence_sample_is_a_prefix(spark):
    """Orders by hash, taken until the lines before one reach the target."""
    per = spark.read.parquet(f"{DATA}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    order = per.select("*", F.shiftright(F.xxhash64("l_orderkey", F.lit(1)), 16).alias("h")).collect()
    for target in (1, 500, 20_000):
        want, total = set(), 0
        for r in sorted(order, key=lambda r: (r.h, r.l_orderkey)):
            if total >= target:
                break
            want.add(r.l_orderkey)
            total += r.n
        assert {r.l_orderkey for r in evaluate.until(per, "n", target, ["l_orderkey"]).collect()} == want
    assert QUERIES["evidence_sample"](spark, DATA).count() == len(want)


def test_forest_scores_rank_their_class(spark):
    own = {r.vec_id: r.label == 1 for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = {r.vec_id: r.score for r in QUERIES["forest_scores"](spark, DATA).collect()}
    assert got.keys() == own.keys() and all(0 <= s <= 1 for s in got.values())
    yes, no = [got[v] for v in own if own[v]], [got[v] for v in own if not own[v]]
    assert sum((a > b) + (a == b) / 2 for a in yes for b in no) > 0.8 * len(yes) * len(no)


def test_error_rates_fit_better_than_their_neighbours(spark, duck):
    """No rate or share nearby makes the counts likelier."""
    counts = duck.execute("""SELECT ref, depth, alt, count(*) AS n FROM (SELECT p_partkey, ['A','N','R'][CAST(p_size % 3 AS INT) + 1] AS ref, count(*) AS depth, count(*) FILTER (l_returnflag <> ['A','N','R'][CAST(p_size % 3 AS INT) + 1] AND floor(l_quantity) < 8) AS alt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1, 2, 3""").fetchall()

    def likelihood(ref, rate, noisy, het):
        pmf = lambda n, k, p: math.comb(n, k) * p**k * (1 - p) ** (n - k)
        return sum(n * math.log((1 - noisy - het) * pmf(d, k, 1e-8) + noisy * pmf(d, k, rate) + het * pmf(d, k, 0.5)) for r, d, k, n in counts if r == ref)

    got = QUERIES["error_rates"](spark, DATA).collect()
    assert sum(r.loci for r in got) == sum(c[3] for c in counts) and len(got) == 3
    for r in got:
        best = likelihood(r.ref, r.rate, r.noisy_share, r.het_share)
        for f in (0.8, 1.25):
            assert best >= likelihood(r.ref, r.rate * f, r.noisy_share, r.het_share) - 1e-3
            assert best >= likelihood(r.ref, r.rate, min(0.99, r.noisy_share * f) if f < 1 else r.noisy_share * 0.9, r.het_share) - 1e-3


def test_orthogonal_alleles_are_greedy(spark):
    """Within all overlapping regions of a contig: the best supported first, two at most over a position."""
    part = spark.read.parquet(f"{DATA}/part.parquet").collect()
    want = {}
    for contig in {r.p_brand for r in part}:
        held = {}
        for r in sorted((r for r in part if r.p_brand == contig), key=lambda r: (-(r.p_partkey % 13), r.p_partkey)):
            span = range(r.p_partkey, r.p_partkey + r.p_size)
            want[r.p_partkey] = all(held.get(p, 0) < 2 for p in span)
            for p in span if want[r.p_partkey] else ():
                held[p] = held.get(p, 0) + 1
    assert {r.id: r.taken for r in QUERIES["orthogonal_alleles"](spark, DATA).collect()} == want


def test_assembled_regions_hold_their_words(spark):
    """Every run of five letters of a contig stands in a name of its brand."""
    part = spark.read.parquet(f"{DATA}/part.parquet").collect()
    names = {}
    for r in part:
        names.setdefault(r.p_brand, set()).add(r.p_name.replace(" ", ""))
    got = QUERIES["assembled_regions"](spark, DATA).collect()
    assert got and {r.brand for r in got} <= set(names)
    for r in got:
        seq = next(v for v in r.asDict().values() if isinstance(v, str) and v != r.brand)
        assert all(any(seq[i : i + 5] in n for n in names[r.brand]) for i in range(len(seq) - 4))


def test_alignments_span_whole_strings(spark):
    got = {r.p_partkey: r.cigar for r in QUERIES["haplotype_alignments"](spark, DATA).collect()}
    part = spark.read.parquet(f"{DATA}/part.parquet").collect()
    assert len(got) == len(part)
    for r in part:
        ops = re.findall(r"(\d+)([=XID])", got[r.p_partkey])
        assert sum(int(n) for n, op in ops if op in "=XD") == len(r.p_name)
        assert sum(int(n) for n, op in ops if op in "=XI") == len(r.p_type)


def test_confident_support_counts_reads_that_look_alike(spark, duck, tmp_path):
    """Rows that agree in position, read, place and quality are calls of their own, also with other bases."""
    got = f"select * from '{DATA}/lineitem.parquet'"
    other = f"select * replace (case l_returnflag when 'A' then 'N' else 'A' end as l_returnflag) from '{DATA}/lineitem.parquet' where l_orderkey % 3 = 0"
    c = duckdb.connect()
    c.execute(f"copy ({got} union all {other} union all {got} where l_orderkey % 5 = 0) to '{tmp_path}/lineitem.parquet' (format parquet)")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert table(QUERIES["confident_support"](spark, str(tmp_path)).toPandas()) == table(c.execute(ORACLES["confident_support"]).df())
