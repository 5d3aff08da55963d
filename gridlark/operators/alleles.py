"""Alleles: conflicts between loci, support, groups of alleles, shifting and alignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions import probability as P
from gridlark.operators.intervals import positions_in


def site_constraints(sites: DataFrame, indels: DataFrame, part: list[str], width: int = 32) -> DataFrame:
    """Sites under variant indels take the smallest quality and gqx of theirs and the indels'; a filtered indel makes the site conflict.

    sites: (pos, qual, gqx); indels: (begin, end, indel_qual, indel_gqx, filtered).
    """
    over = positions_in(sites.select(*part, "pos").distinct(), indels, part, how="inner", width=width)
    least = over.groupBy(*part, "pos").agg(F.min("indel_qual").alias("_q"), F.min("indel_gqx").alias("_g"), F.bool_or("filtered").alias("_f"))
    out = sites.join(least, [*part, "pos"], "left")
    # least() passes over nulls: sites under no indel stay as they are
    return out.withColumns({"qual": F.least("qual", "_q"), "gqx": F.least("gqx", "_g"), "conflict": F.coalesce("_f", F.lit(False))}).drop("_q", "_g", "_f")


def indel_signals(rows: DataFrame, context: list[str], change: Column) -> DataFrame:
    """Counts by context and signal: insertions and deletions of 1, 2, and 3 or more, and the reference."""
    size = F.least(F.abs(change), F.lit(3)).cast("string")
    kind = F.when(change == 0, "REF").when(change > 0, F.concat(F.lit("I"), size)).otherwise(F.concat(F.lit("D"), size))
    return rows.groupBy(*context, kind.alias("signal")).agg(F.count("*").alias("n"))


def confident_support(reads: DataFrame, keys: list[str], least: float = 0.51) -> DataFrame:
    """Reads by allele and strand, counted where the best allele's posterior is `least` or more; others are non-confident.

    reads: one row per read and allele, (read_id, allele, lnp, is_fwd).
    """
    by = reads.groupBy(*keys, "read_id").agg(F.collect_list(F.struct("lnp", "allele")).alias("lnps"), F.first("is_fwd").alias("is_fwd"))
    return support(by, keys, least)


def support(reads: DataFrame, keys: list[str], least: float = 0.51) -> DataFrame:
    """confident_support of one row per read, (lnps, is_fwd), whose array lnps has (lnp, allele): every row counts, whether or not it has an identity of its own."""
    best = F.array_max("lnps")
    post = F.exp(best["lnp"] - P.log_sum_exp(F.transform("lnps", lambda x: x["lnp"])))
    called = reads.select(*keys, "is_fwd", F.when(post >= least, best["allele"]).otherwise("none").alias("allele"))
    return called.groupBy(*keys, "allele").agg(F.count("*").alias("reads"), F.count_if("is_fwd").alias("fwd"))


def group_likelihoods(reads: DataFrame, keys: list[str], alleles: tuple[str, ...], mismapped: float = 1e-4, length: int = 100) -> DataFrame:
    """ln likelihood of each diploid genotype over a group of alleles, from reads with a ln likelihood per allele (array `lnps`).

    A read is an even mix of the genotype's alleles, or mismapped, when any base is as likely.
    """
    from gridlark.operators.genotype import genotypes

    import math

    noise = math.log(mismapped) + length * math.log(0.25)
    good = math.log1p(-mismapped)
    at = {a: i for i, a in enumerate(alleles)}
    sums = []
    for i, (a, b) in enumerate(genotypes(alleles)):
        mix = P.log_sum_exp(F.array(F.col("lnps")[at[a]] + math.log(0.5), F.col("lnps")[at[b]] + math.log(0.5)))
        sums.append(F.sum(P.log_sum_exp(F.array(mix + good, F.lit(noise)))).alias(f"g{i}"))
    return reads.groupBy(*keys).agg(*sums)


def orthogonal_groups(alleles: DataFrame, part: list[str], cluster: str, ploidy: int = 2) -> DataFrame:
    """Of each cluster, alleles taken greedily by support while no position is held by more than `ploidy` of them.

    alleles: (id, begin, end, support).  A cluster is what overlaps, so its size is bounded by depth, not by the table.
    """

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, int] = {}
        out = []
        for row in pdf.sort_values(["support", "id"], ascending=[False, True]).itertuples():
            span = range(int(row.begin), int(row.end))
            ok = all(held.get(p, 0) < ploidy for p in span)
            for p in span if ok else ():
                held[p] = held.get(p, 0) + 1
            out.append((row.id, ok))
        return pd.DataFrame(out, columns=["id", "taken"])

    return alleles.groupBy(*part, cluster).applyInPandas(take, "id long, taken boolean")


def left_shift(ref: Column, pos: Column, length: Column) -> Column:
    """How far a deletion of `length` bases at `pos` (from 0) moves left in `ref` without changing the result: as long as the base before equals the last one deleted."""
    steps = F.sequence(F.lit(0), F.greatest(pos, F.lit(0)))
    base = lambda p: F.substr(ref, (p + 1).cast("int"), F.lit(1))

    def step(acc: Column, i: Column) -> Column:
        more = acc["go"] & (pos - i > 0) & (base(pos - i - 1) == base(pos - i - 1 + length))
        return F.struct((acc["n"] + more.cast("int")).alias("n"), more.alias("go"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), step, lambda acc: acc["n"])


def homopolymer_context(ref: DataFrame, part: list[str], width: int = 1 << 16) -> DataFrame:
    """The length of the run of one base that each position lies in, with its begin and end."""
    from gridlark.operators.intervals import blocks

    runs = blocks(ref.select(*part, "pos", "ref"), [*part, "ref"], width=width)
    return positions_in(ref, runs.withColumnRenamed("ref", "run"), part, how="inner").filter(F.col("ref") == F.col("run")).select(*part, "pos", "ref", "begin", "end", (F.col("end") - F.col("begin")).alias("length"))


def align(a: str, b: str, match: int = 2, mismatch: int = -3, gap: int = -5, extend: int = -1) -> str:
    """Global alignment with affine gaps, as a CIGAR of = X I D over a (reference) and b; of equal paths, matches come first, then deletions."""
    neg = float("-inf")
    n, m = len(a), len(b)
    score = [[[neg] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    back = [[[0] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    score[0][0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            for state, (di, dj) in enumerate(((1, 1), (1, 0), (0, 1))):
                if i < di or j < dj or (i == j == 0):
                    continue
                prev = score[i - di][j - dj]
                if state == 0:
                    cost = [match if a[i - 1] == b[j - 1] else mismatch] * 3
                else:
                    cost = [extend if k == state else gap + extend for k in range(3)]
                k = max(range(3), key=lambda k: (prev[k] + cost[k], -k))
                score[i][j][state], back[i][j][state] = prev[k] + cost[k], k
    i, j, state, ops = n, m, max(range(3), key=lambda k: (score[n][m][k], -k)), []
    while i or j:
        ops.append(("=" if a[i - 1] == b[j - 1] else "X") if state == 0 else "D" if state == 1 else "I")
        before = back[i][j][state]
        i, j, state = i - (state != 2), j - (state != 1), before
    out, at = "", 0
    ops.reverse()
    while at < len(ops):
        end = at
        while end < len(ops) and ops[end] == ops[at]:
            end += 1
        out += f"{end - at}{ops[at]}"
        at = end
    return out


def aligned(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the alignment of two short sequences (haplotypes of at most a few hundred bases) as a CIGAR string; null where either is null."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = list(zip(x, y))
        of = {pair: align(*pair) for pair in set(pairs) if None not in pair}  # equal pairs once
        return pd.Series([of.get(pair) for pair in pairs], dtype=object)

    return rows.withColumn("cigar", run(F.col(a), F.col(b)))


def assembled(reads: DataFrame, keys: list[str], k: int = 5, least: int = 2) -> DataFrame:
    """Contigs of each region from its reads' k-mers: from the most frequent k-mer, extended both ways by the most frequent next one seen `least` times, never twice by the same; then further ones from what is left, until each k-mer is in one contig.

    K-mers are counted by Spark first; a region's task gets one row per distinct k-mer.
    """
    words = reads.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - (k - 1)), lambda i: F.substr(F.col("seq"), i, F.lit(k)))).alias("kmer"))
    counts = words.filter(F.length("kmer") == k).groupBy(*keys, "kmer").agg(F.count("*").alias("n")).filter(F.col("n") >= least)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(pdf["kmer"], pdf["n"]))
        letters = sorted({c for w in n for c in w})
        used: set[str] = set()
        out = []
        for seed in sorted(n, key=lambda w: (-n[w], w)):
            if seed in used:
                continue
            contig, before = seed, len(used)
            used.add(seed)
            for right in (True, False):
                while True:
                    ends = [contig[-(k - 1) :] + c if right else c + contig[: k - 1] for c in letters]
                    ends = [w for w in ends if w in n and w not in used]
                    if not ends:
                        break
                    w = min(ends, key=lambda w: (-n[w], w))
                    used.add(w)
                    contig = contig + w[-1] if right else w[0] + contig
            out.append([*pdf.iloc[0][keys], contig, len(used) - before, int(n[seed])])
        return pd.DataFrame(out, columns=[*keys, "contig", "kmers", "seed_count"])

    types = {f.name: f.dataType.simpleString() for f in reads.schema.fields}
    return counts.groupBy(*keys).applyInPandas(grow, ", ".join([f"`{c}` {types[c]}" for c in keys] + ["contig string, kmers long, seed_count long"]))


def depth_limited(reads: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` reads of each position in a total order; the limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return reads.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
