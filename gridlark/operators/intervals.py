"""Relational algebra of half-open intervals and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.running import BIN, dealt, running


def merged(regions: DataFrame, part: list[str], gap: int = 0, width: int = BIN) -> DataFrame:
    """Disjoint regions (part, begin, end, n): overlapping ones merge, and those at most `gap` apart (0: adjacent ones too). Empty intervals are left out."""
    rows = regions.select(*part, "begin", "end").filter("begin < end")
    ahead = running(rows, part, "begin", {"_reach": ("max", F.col("end"))}, ["end"], before=True, width=width)
    flagged = ahead.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("begin") > F.col("_reach") + gap), 1).otherwise(0))
    numbered = running(flagged, part, "begin", {"_island": ("sum", F.col("_new"))}, ["end"], width=width)
    return numbered.groupBy(*part, "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def coverage(regions: DataFrame, part: list[str], width: int = BIN) -> DataFrame:
    """Runs of equal depth (part, begin, end, depth), depth over 0, from +1 and -1 at the ends of regions.

    Depth and the next step are carried from bin to bin together, so that steps are dealt once; regions are read once.
    """
    both = F.array(*[F.struct(F.col(c).alias("pos"), F.lit(d).alias("d")) for c, d in (("begin", 1), ("end", -1))])
    ends = regions.filter("begin < end").select(*part, F.explode(both).alias("_e")).select(*part, "_e.pos", "_e.d")
    steps = dealt(ends.groupBy(*part, "pos").agg(F.sum("d").alias("d")).filter("d <> 0"), part, "pos", width)
    bins = steps.groupBy(*part, "_bin").agg(F.sum("d").alias("_d"), F.min("pos").alias("_first"))
    along = Window.partitionBy(*part).orderBy("_bin")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*part, "_bin", F.coalesce(F.sum("_d").over(past), F.lit(0)).alias("_ahead"), F.lead("_first").over(along).alias("_next"))
    inner = Window.partitionBy(*part, "_bin").orderBy("pos")
    depth = F.sum("d").over(inner.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_ahead")
    out = steps.join(carried, [*part, "_bin"]).withColumns({"depth": depth, "end": F.coalesce(F.lead("pos").over(inner), F.col("_next"))})
    return out.filter("depth > 0").select(*part, F.col("pos").alias("begin"), "end", F.col("depth").cast("long").alias("depth"))


#: Bins of a level are so many times as wide as those of the level below; an interval lies in the level in which it spans a few bins.
FAN = 16


def _level(begin: Column, end: Column, width: int) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log(float(FAN), (end - begin) / F.lit(float(width))))).cast("int")


def _present(regions: DataFrame, width: int) -> list[int]:
    """The levels that intervals lie in: a handful, as lengths grow by FAN from one to the next."""
    return sorted(r[0] for r in regions.select(_level(F.col("begin"), F.col("end"), width).alias("l")).distinct().collect())


def _size(level: Column, width: int) -> Column:
    return F.pow(F.lit(float(FAN)), level).cast("long") * width


def _bins(begin: str, end: str, level: Column, width: int) -> Column:
    size = _size(level, width)
    return F.sequence(F.floor(F.col(begin) / size), F.floor((F.col(end) - 1) / size))


def positions_in(points: DataFrame, regions: DataFrame, part: list[str], pos: str = "pos", how: str = "left_semi", width: int = 32) -> DataFrame:
    """Points that lie in some region (left_semi), in none (left_anti), or with each region they lie in (inner): an equi-join on bins.

    Regions are binned by length: long ones lie in few wide bins, and a point looks into a bin of each level there is.
    """
    over = regions.filter("begin < end")
    levels = _present(over, width) or [0]
    over = over.withColumn("_r_level", _level(F.col("begin"), F.col("end"), width)).withColumn("_r_bin", F.explode(_bins("begin", "end", F.col("_r_level"), width)))
    for c in part:
        over = over.withColumnRenamed(c, f"_r_{c}")
    inside = (F.col(pos) >= F.col("begin")) & (F.col(pos) < F.col("end"))
    if len(levels) == 1:
        at = points.withColumn("_level", F.lit(levels[0]))
    elif how == "inner":
        at = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    else:
        # a row in several bins would come out several times: keys are matched first
        keys = points.select(*part, pos).distinct()
        hits = positions_in(keys, regions, part, pos, "inner", width)
        if how == "left":
            return points.join(hits, [*part, pos], "left")
        return points.join(hits.select(*part, pos).distinct(), [*part, pos], how)
    at = at.withColumn("_bin", F.floor(F.col(pos) / _size(F.col("_level"), width)))
    on = (F.col("_bin") == F.col("_r_bin")) & (F.col("_level") == F.col("_r_level")) & inside
    for c in part:
        on &= F.col(c) == F.col(f"_r_{c}")
    return at.join(over, on, how).drop("_bin", "_level", "_r_bin", "_r_level", *[f"_r_{c}" for c in part])


def overlaps(a: DataFrame, b: DataFrame, part: list[str], width: int = 32) -> DataFrame:
    """Pairs of intervals that overlap, once each: a's columns, and b's with the suffix _b.

    A pair is made in the wider level of the two, in the first bin there that both share.
    """
    left, right = a.filter("begin < end"), b.filter("begin < end")
    levels = sorted({*_present(left, width), *_present(right, width)}) or [0]

    def binned(rows: DataFrame, begin: str, end: str, own: str) -> DataFrame:
        """Each interval in the bins of its level and of all wider ones."""
        at = rows.withColumn(own, _level(F.col(begin), F.col(end), width))
        at = at.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(own))))
        return at.withColumn("_bin", F.explode(_bins(begin, end, F.col("_level"), width)))

    left = binned(left, "begin", "end", "_own")
    right = right.select(*part, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in part])
    right = binned(right, "begin_b", "end_b", "_own_b")
    hit = (F.col("begin") < F.col("end_b")) & (F.col("begin_b") < F.col("end")) & (F.col("_level") == F.greatest("_own", "_own_b"))
    size = _size(F.col("_level"), width)
    first = F.col("_bin") == F.greatest(F.floor(F.col("begin") / size), F.floor(F.col("begin_b") / size))
    return left.join(right, [*part, "_level", "_bin"]).filter(hit & first).drop("_bin", "_level", "_own", "_own_b")


def contained(a: DataFrame, regions: DataFrame, part: list[str], width: int = 32) -> DataFrame:
    """Intervals that lie within one region of the merged set: merged regions do not overlap, so the one that holds the begin decides."""
    whole = merged(regions, part).select(*part, F.col("begin").alias("_begin"), F.col("end").alias("_end"))
    firsts = a.select(*part, F.col("begin").alias("_pos")).distinct()
    over = positions_in(firsts, whole.withColumnsRenamed({"_begin": "begin", "_end": "end"}), part, "_pos", "inner", width)
    over = over.select(*part, F.col("_pos").alias("begin"), F.col("end").alias("_end"))
    return a.join(over, [*part, "begin"]).filter(F.col("end") <= F.col("_end")).select(a.columns)


def payload_at(points: DataFrame, regions: DataFrame, part: list[str], value: str, default, pos: str = "pos", width: int = 32) -> DataFrame:
    """Points with the value of the region they lie in, or the default; regions must not overlap."""
    return positions_in(points, regions, part, pos, "left", width).withColumn(value, F.coalesce(value, F.lit(default))).drop("begin", "end")


def conflicts(regions: DataFrame, part: list[str], value: str, width: int = 32) -> DataFrame:
    """Pairs of overlapping regions whose values differ, each pair once."""
    both = overlaps(regions, regions, part, width)
    return both.filter((F.col(value) != F.col(f"{value}_b")) & ((F.col("begin") < F.col("begin_b")) | ((F.col("begin") == F.col("begin_b")) & ((F.col("end") < F.col("end_b")) | ((F.col("end") == F.col("end_b")) & (F.col(value) < F.col(f"{value}_b")))))))


def blocks(positions: DataFrame, part: list[str], pos: str = "pos", width: int = BIN) -> DataFrame:
    """Consecutive positions as regions (part, begin, end)."""
    points = positions.select(*part, F.col(pos).alias("begin"), (F.col(pos) + 1).alias("end")).distinct()
    return merged(points, part, width=width).select(*part, "begin", "end")


def gaps(positions: DataFrame, part: list[str], pos: str = "pos") -> DataFrame:
    """Positions without a row between the first and the last of each part."""
    span = positions.groupBy(*part).agg(F.min(pos).alias("_a"), F.max(pos).alias("_b"))
    # a span is cut into bins before it is unrolled, so no task makes a whole contig
    bins = span.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / BIN), F.floor(F.col("_b") / BIN)))).repartition(*part, "_k")
    every = bins.withColumn(pos, F.explode(F.sequence(F.greatest(F.col("_a"), F.col("_k") * BIN), F.least(F.col("_b"), F.col("_k") * BIN + BIN - 1)))).select(*part, pos)
    return every.join(positions.select(*part, pos), [*part, pos], "left_anti")


def segments(contigs: DataFrame, size: int) -> DataFrame:
    """(contig, number, begin, end): each contig in equal parts of at most `size`, the first ones a position longer where it does not divide."""
    n = F.ceil(F.col("length") / size)
    cut = contigs.withColumn("_n", n).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    base, rest = F.floor(F.col("length") / F.col("_n")), F.col("length") % F.col("_n")
    begin = F.col("number") * base + F.least(F.col("number"), rest)
    return cut.select("contig", "number", begin.alias("begin"), (begin + base + F.when(F.col("number") < rest, 1).otherwise(0)).alias("end"))


def mean_depth(reads: DataFrame, part: list[str], gap: int = 1000, width: int = BIN) -> DataFrame:
    """(part, bases, span, depth): read bases over the covered span, from which gaps longer than `gap` are left out."""
    span = merged(reads, part, gap=gap, width=width).groupBy(*part).agg(F.sum(F.col("end") - F.col("begin")).alias("span"))
    bases = reads.filter("begin < end").groupBy(*part).agg(F.sum(F.col("end") - F.col("begin")).alias("bases"))
    return bases.join(span, part).withColumn("depth", F.col("bases") / F.col("span"))


def same_contigs(a: DataFrame, b: DataFrame, contig: str = "contig") -> DataFrame:
    """One row: contigs only in the first, only in the second, and whether the sets are equal."""
    one, two = a.select(contig).distinct().withColumn("_a", F.lit(1)), b.select(contig).distinct().withColumn("_b", F.lit(1))
    both = one.join(two, contig, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second")).withColumn("same", (F.col("only_first") == 0) & (F.col("only_second") == 0))
