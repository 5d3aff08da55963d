"""Running aggregates along positions, in two levels.

A window over a whole contig is one task however long the contig is.  Here rows are
cut into bins of positions: each bin is aggregated, the aggregates of the bins
before it are carried in, and the running value is taken within the bin.  Only one
row per bin is ordered contig-wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 16

#: Fixed value: input bytes, as stored, whose rows are dealt to one task. Rows of positions are stored in some bytes each and sorted in some hundred.
DEALT = 4 << 20


def tasks(df: DataFrame) -> int:
    """Tasks to deal rows to: as many as there are cores, and more as the files that df rests on grow, so that what a task holds does not. Sizes that are unknown count as the session's shuffle partitions."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    least = spark.sparkContext.defaultParallelism
    if any(x >= 1 << 60 for x in sizes):
        return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-sum(sizes) // DEALT))


def dealt(df: DataFrame, part: list[str], pos: str, width: int = BIN) -> DataFrame:
    """df with `_bin`, its rows dealt over tasks by part and bin. Rows without a part or position have no place and are left out; said here, the filter is the same for all that read the rows, and they are dealt once."""
    keys = [*part, "_bin"]
    placed = df.withColumn("_bin", F.floor(F.col(pos) / width)).filter(" and ".join(f"`{k}` is not null" for k in keys))
    return placed.repartition(tasks(df), *keys)


def running(df: DataFrame, part: list[str], pos: str, values: dict[str, tuple[str, Column]], tie: list[str] = (), before: bool = False, width: int = BIN) -> DataFrame:
    """Adds, for each name, the running sum or max ("sum" or "max", expression) in order of (pos, tie), up to the row itself or, with before, the row ahead of it.

    Where no row lies ahead, a sum is 0 and a max null.
    """
    binned = dealt(df, part, pos, width)
    for name, (_, x) in values.items():
        binned = binned.withColumn(f"_v_{name}", x)
    total = {n: (F.sum if kind == "sum" else F.max)(f"_v_{n}") for n, (kind, _) in values.items()}
    bins = binned.groupBy(*part, "_bin").agg(*[t.alias(f"_t_{n}") for n, t in total.items()])
    past = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*part, "_bin", *[(F.sum if values[n][0] == "sum" else F.max)(f"_t_{n}").over(past).alias(f"_c_{n}") for n in values])
    inner = Window.partitionBy(*part, "_bin").orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = binned.join(carried, [*part, "_bin"])
    for n, (kind, _) in values.items():
        own = (F.sum if kind == "sum" else F.max)(f"_v_{n}").over(inner)
        out = out.withColumn(n, F.coalesce(own, F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) if kind == "sum" else F.greatest(own, F.col(f"_c_{n}")))
    return out.select(*df.columns, *values)
