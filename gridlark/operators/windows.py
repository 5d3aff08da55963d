"""Sliding, clustering and sequential computations along positions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridlark.operators.running import BIN, running


def sliding_average(rows: DataFrame, part: list[str], pos: str, values: list[str], back: int, ahead: int = 0, width: int = BIN) -> DataFrame:
    """Averages over the positions [pos - back, pos + ahead]; nulls are left out, absent positions do not count.

    Cut into bins with the margins of their neighbours, so a long contig is many tasks.
    """
    own = F.floor(F.col(pos) / width)
    bins = F.array_distinct(F.array(own, F.floor((F.col(pos) + back) / width), F.floor((F.col(pos) - ahead) / width)))
    copies = rows.withColumn("_bin", F.explode(bins)).withColumn("_own", F.col("_bin") == own)
    w = Window.partitionBy(*part, "_bin").orderBy(pos).rangeBetween(-back, ahead)
    for v in values:
        copies = copies.withColumn(f"{v}_avg", F.avg(v).over(w))
    return copies.filter("_own").drop("_bin", "_own")


def true_count(rows: DataFrame, part: list[str], order: list[str], flag: Column, last: int) -> DataFrame:
    """How many of the last rows, this one included, hold the flag."""
    return rows.withColumn("recent", F.sum(flag.cast("int")).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(1 - last, 0)))


def sessions(rows: DataFrame, part: list[str], pos: str, gap: int, tie: list[str] = (), width: int = BIN) -> DataFrame:
    """Numbers clusters: a row more than `gap` from the one before starts a new one."""
    ahead = running(rows, part, pos, {"_last": ("max", F.col(pos))}, list(tie), before=True, width=width)
    flagged = ahead.withColumn("_new", F.when(F.col("_last").isNull() | (F.col(pos) - F.col("_last") > gap), 1).otherwise(0))
    return running(flagged, part, pos, {"session": ("sum", F.col("_new"))}, list(tie), width=width).drop("_last", "_new")


def active_regions(candidates: DataFrame, part: list[str], pos: str = "pos", gap: int = 13, least: int = 2) -> DataFrame:
    """Clusters of at least `least` candidate positions at most `gap` apart."""
    found = sessions(candidates.select(*part, pos).distinct(), part, pos, gap)
    return found.groupBy(*part, "session").agg(F.min(pos).alias("begin"), (F.max(pos) + 1).alias("end"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("session")


def overlap_clusters(loci: DataFrame, part: list[str], is_indel: Column, width: int = BIN) -> DataFrame:
    """Numbers groups of loci whose closed ranges touch; a group with more than one indel conflicts. Loci have (begin, end)."""
    order = ["end", "id"]
    ahead = running(loci, part, "begin", {"_reach": ("max", F.col("end"))}, order, before=True, width=width)
    flagged = ahead.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("begin") > F.col("_reach")), 1).otherwise(0))
    numbered = running(flagged, part, "begin", {"cluster": ("sum", F.col("_new"))}, order, width=width).drop("_reach", "_new")
    size = numbered.groupBy(*part, "cluster").agg(F.count_if(is_indel).alias("indels"), F.count("*").alias("size"))
    return numbered.join(size, [*part, "cluster"]).withColumn("conflict", F.col("indels") > 1)


def ranked(rows: DataFrame, part: list[str], by: list[Column], top: int) -> DataFrame:
    """The first rows of each part; the limit is applied before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*by))).filter(F.col("rank") <= top)


def phase_sets(variants: DataFrame, part: list[str]) -> DataFrame:
    """Phases heterozygous variants of a region: with two or more, PS is the 1-based position of the first, and a variant is flipped if its haplotypes stand the other way round than the first one's.

    Variants have (pos, is_het, hap0, hap1).
    """
    w = Window.partitionBy(*part)
    het = F.when(F.col("is_het"), F.col("pos"))
    out = variants.withColumn("_n", F.count_if("is_het").over(w)).withColumn("_first", F.min(het).over(w)).withColumn("_hap", F.min_by(F.when(F.col("is_het"), F.col("hap0")), het).over(w))
    on = F.col("is_het") & (F.col("_n") >= 2)
    return out.withColumn("ps", F.when(on, F.col("_first") + 1)).withColumn("flip", F.when(on, F.col("hap0") != F.col("_hap"))).drop("_n", "_first", "_hap")


def _tolerates(lo: float, hi: float, frac: float, abs_tol: int) -> bool:
    return lo + max(abs_tol, int(lo * frac)) >= hi / 2.0


def site_blocks(sites: DataFrame, part: list[str], same: list[str], values: list[str], frac: float = 0.3, abs_tol: int = 3, width: int = BIN) -> DataFrame:
    """Compresses runs of sites to blocks (begin, end, and of each value min and rounded mean).

    A site joins a block if it is the next position, agrees in `same`, and every value
    keeps within tolerance of the block's smallest.  Where contiguity or agreement ends,
    a block must end: those runs are relational, numbered in bins whose sums are carried
    on.  Within a run the tolerance is greedy and needs order: runs are dealt over
    tasks, and a task streams its runs in order with one open block, so that the result
    does not depend on bins and a run of any length takes no memory.
    """
    bins = F.array_distinct(F.array(F.floor(F.col("pos") / width), F.floor((F.col("pos") + 1) / width)))
    binned = sites.withColumn("_bin", F.explode(bins))  # the last position of a bin is seen by the next one too
    w = Window.partitionBy(*part, "_bin").orderBy("pos")
    key = F.struct(*same)
    new = (F.col("pos") - F.lag("pos").over(w) != 1) | ~key.eqNullSafe(F.lag(key).over(w))
    flagged = binned.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).filter(F.col("_bin") == F.floor(F.col("pos") / width)).drop("_bin")
    runs = running(flagged, part, "pos", {"_run": ("sum", F.col("_new"))}, width=width)
    runs = runs.select(*part, "_run", "pos", *same, *(F.col(v).cast("long").alias(v) for v in values)).repartition(*part, "_run").sortWithinPartitions(*part, "_run", "pos")
    n_part, n_same, n_values = len(part), len(same), len(values)

    def greedy(batches):
        open_, run_of = None, None  # the open block: head columns, begin, last position, smallest, largest, sums, sites

        def row(b):
            head, begin, last, lo, _, sums, n = b
            return [*head, begin, last + 1, *lo, *(int(x / n + 0.5) for x in sums)]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            heads, rests = list(zip(*columns[: n_part + 1])), list(zip(*columns[n_part + 2 : n_part + 2 + n_same]))
            done = []
            for i, pos in enumerate(columns[n_part + 1]):
                v = [columns[n_part + 2 + n_same + k][i] for k in range(n_values)]
                if open_ is not None and run_of == heads[i]:
                    _, _, _, lo, hi, sums, _ = open_
                    lo, hi = [min(a, b) for a, b in zip(lo, v)], [max(a, b) for a, b in zip(hi, v)]
                    if all(_tolerates(float(a), float(b), frac, abs_tol) for a, b in zip(lo, hi)):
                        open_ = (open_[0], open_[1], pos, lo, hi, [a + b for a, b in zip(sums, v)], open_[6] + 1)
                        continue
                if open_ is not None:
                    done.append(row(open_))
                run_of = heads[i]
                open_ = ((*heads[i][:-1], *rests[i]), pos, pos, v, v, v, 1)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[row(open_)]), types)], names)

    kinds = {f.name: f.dataType for f in sites.schema.fields}
    numbers = ["begin", "end", *(f"min_{v}" for v in values), *(f"mean_{v}" for v in values)]
    names = [*part, *same, *numbers]
    types = [*(to_arrow_type(kinds[c]) for c in [*part, *same]), *[pa.int64()] * len(numbers)]
    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in [*part, *same]), *(f"{c} long" for c in numbers)])
    return runs.mapInArrow(greedy, schema)


def synchronised(regions: DataFrame, part: list[str], sample: str = "sample", delay: int = 9, width: int = BIN) -> DataFrame:
    """Active regions over all samples: those of any samples that overlap are one, and one stays open `delay` positions after its last sample's."""
    from gridlark.operators.intervals import merged

    wide = regions.select(*part, "begin", (F.col("end") + delay).alias("end"))
    out = merged(wide, part, width=width)
    return out.select(*part, "begin", (F.col("end") - delay).alias("end"), F.col("n").alias("regions"))


def forced_genotyped(forced: DataFrame, discovered: DataFrame, regions: DataFrame, part: list[str], key: list[str]) -> DataFrame:
    """Forced alleles with whether they are genotyped: one that was not discovered, in an active region with discovered candidates, is not.

    forced and discovered: (part, pos, key); regions: (part, begin, end).
    """
    from gridlark.operators.intervals import positions_in

    found = discovered.select(*part, "pos", *key).distinct().withColumn("_found", F.lit(True))
    rich = positions_in(discovered.select(*part, "pos").distinct(), regions, part, how="inner").select(*part, "begin", "end").distinct()
    inside = positions_in(forced.select(*part, "pos").distinct(), rich, part).withColumn("_inside", F.lit(True))
    out = forced.join(found, [*part, "pos", *key], "left").join(inside, [*part, "pos"], "left")
    return out.withColumn("genotyped", F.col("_found").isNotNull() | F.col("_inside").isNull()).drop("_found", "_inside")


def phasing_noise(calls: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Haplotypes that look like a sequencer's phasing errors: one mismatch, seen on one strand only, beside a homopolymer longer than `most`.

    calls: (keys, mismatches, is_fwd, run) of each read of a haplotype; run is the longest homopolymer next to the mismatch.
    """
    by = calls.groupBy(*keys).agg(F.max("mismatches").alias("mismatches"), F.count_if("is_fwd").alias("fwd"), F.count("*").alias("reads"), F.max("run").alias("run"))
    return by.withColumn("noise", (F.col("mismatches") == 1) & ((F.col("fwd") == 0) | (F.col("fwd") == F.col("reads"))) & (F.col("run") > most))
