"""Evaluation against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.operators.intervals import positions_in
from gridlark.operators.running import running


def matched(query: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match on keys: TP, FP or FN."""
    q, t = query.select(*keys).distinct().withColumn("_q", F.lit(True)), truth.select(*keys).distinct().withColumn("_t", F.lit(True))
    return q.join(t, keys, "full_outer").select(*keys, F.when(F.col("_q") & F.col("_t"), "TP").when(F.col("_q"), "FP").otherwise("FN").alias("tag"))


def level_ranks(rows: DataFrame, value: str, bins: int = 1024) -> DataFrame:
    """(value, rank): the distinct values' places from the largest, 1 first. Distinct values are dealt by range, and each range starts at the counts of those above it."""
    levels = rows.select(value).distinct()
    ends = levels.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.floor((F.col("_hi") - F.col(value)) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)) * (bins - 1))
    cut = levels.crossJoin(F.broadcast(ends)).withColumn("_bin", scaled)  # one row of two numbers
    above = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
    starts = cut.groupBy("_bin").agg(F.count("*").alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(F.desc(value)))
    return cut.join(starts, "_bin").select(value, (F.col("_start") + place).cast("int").alias("rank"))


def sweep(scored: DataFrame, score: str = "score", tag: str = "tag", width: int = 16) -> DataFrame:
    """For each score as threshold: tp, fp, fn, filtered, precision, recall.

    Counts by score first; the sums over higher scores are carried across bins of `width` scores.
    """
    by = scored.groupBy(score).agg(F.count_if(F.col(tag) == "TP").alias("t"), F.count_if(F.col(tag) == "FP").alias("f"))
    all_ = by.agg(F.sum("t").alias("_t"), F.sum("f").alias("_f"))
    down = by.withColumns({"_one": F.lit(1), "_down": -F.col(score)})
    out = running(down, ["_one"], "_down", {"tp": ("sum", F.col("t")), "fp": ("sum", F.col("f"))}, width=width).crossJoin(F.broadcast(all_))  # one row
    return out.select(score, "tp", "fp", (F.col("_t") - F.col("tp")).alias("fn"), (F.col("_t") + F.col("_f") - F.col("tp") - F.col("fp")).alias("filtered"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("_t") > 0, F.col("tp") / F.col("_t")).otherwise(F.lit(0.0)).alias("recall"))


def calibration(scored: DataFrame, bins: int, part: list[str], score: str = "score", tie: str = "id", tag: str = "tag") -> DataFrame:
    """Equal-count bins of each part by score: median score, precision, rows.

    A row's rank is the rows of lower scores, carried across scores, and its place
    within its score, so that no part meets in one task; the first bins are a row larger.
    """
    per = scored.groupBy(*part, score).agg(F.count("*").alias("_n"))
    below = running(per, part, score, {"_below": ("sum", F.col("_n"))}, before=True, width=16).select(*part, score, "_below")
    size = per.groupBy(*part).agg(F.sum("_n").alias("_all"))
    place = F.row_number().over(Window.partitionBy(*part, score).orderBy(tie)) - 1 + F.col("_below")
    ranked = scored.join(below, [*part, score]).join(size, part).withColumn("_k", place)
    small, over = F.floor(F.col("_all") / bins), F.col("_all") % bins
    bin_ = F.when(F.col("_k") < over * (small + 1), F.floor(F.col("_k") / (small + 1))).otherwise(over + F.floor((F.col("_k") - over * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    cut = ranked.withColumn("bin", bin_.cast("int"))
    return cut.groupBy(*part, "bin").agg(F.median(score).alias("median_score"), F.avg((F.col(tag) == "TP").cast("int")).alias("precision"), F.count("*").alias("n"))


def confusion(rows: DataFrame, truth: str, predicted: str, values: list[str]) -> DataFrame:
    """Counts of truth by predicted value, a column per value."""
    return rows.groupBy(truth).agg(*[F.count_if(F.col(predicted) == v).alias(f"as_{v}") for v in values])


def labelled(candidates: DataFrame, regions: DataFrame, part: list[str], tag: str = "tag", kind: str = "kind", default: str = "UNK") -> DataFrame:
    """Candidates that are neither TP nor FN take a region's label: FP regions first, then ambiguous ones, else the default."""
    hit = positions_in(candidates.select(*part, "pos").distinct(), regions.select(*part, "begin", "end", kind), part, how="inner")
    best = hit.groupBy(*part, "pos").agg(F.bool_or(F.col(kind) == "fp").alias("_fp"), F.bool_or(F.col(kind) == "ambiguous").alias("_amb"))
    out = candidates.join(best, [*part, "pos"], "left")
    fresh = F.when(F.col("_fp"), "FP").when(F.col("_amb"), "AMBI").otherwise(default)
    return out.withColumn(tag, F.when(F.col(tag).isin("TP", "FN"), F.col(tag)).otherwise(fresh)).drop("_fp", "_amb")


def hash_ordered(keys: list[Column], seed: int) -> Column:
    """An order that looks random and is the same in every run."""
    return F.xxhash64(*keys, F.lit(seed))


def balanced(rows: DataFrame, tag: str, keys: list[str], seed: int = 1) -> DataFrame:
    """As many rows of each tag as the rarest has, chosen by hash. Rows are ranked in buckets of the hash, so no tag meets in one task."""
    h = rows.withColumn("_h", hash_ordered([F.col(k) for k in keys], seed)).withColumn("_b", F.shiftright("_h", 52))
    per = h.groupBy(tag, "_b").agg(F.count("*").alias("_n"))
    least = per.groupBy(tag).agg(F.sum("_n").alias("_n")).agg(F.min("_n").alias("_least"))
    carry = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(tag).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(tag, "_b").orderBy("_h", *keys)) + F.col("_before")
    return h.join(carry.drop("_n"), [tag, "_b"]).withColumn("_rank", rank).crossJoin(F.broadcast(least)).filter(F.col("_rank") <= F.col("_least")).drop("_h", "_b", "_before", "_rank", "_least")


def until(rows: DataFrame, weight: str, target: int, keys: list[str], seed: int = 1) -> DataFrame:
    """The prefix of a hash order whose weights reach the target: an early-stopping sample."""
    h = rows.withColumn("_h", F.shiftright(hash_ordered([F.col(k) for k in keys], seed), 16)).withColumn("_one", F.lit(1))
    summed = running(h, ["_one"], "_h", {"_sum": ("sum", F.col(weight))}, keys, before=True, width=1 << 40)
    return summed.filter(F.col("_sum") < target).drop("_h", "_one", "_sum")


def integrated(points: DataFrame, part: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Trapezoid integral of a function given at some points of each part, and the ln of that of exp(y): a few points a part."""
    w = Window.partitionBy(*part).orderBy(x)
    step = points.withColumns({"_dx": F.lead(x).over(w) - F.col(x), "_y2": F.lead(y).over(w)}).filter("_dx is not null")
    top = F.max(F.greatest(F.col(y), F.col("_y2"))).over(Window.partitionBy(*part))
    step = step.withColumn("_top", top).withColumn("_e", (F.exp(F.col(y) - F.col("_top")) + F.exp(F.col("_y2") - F.col("_top"))) / 2 * F.col("_dx"))
    return step.groupBy(*part).agg(F.sum((F.col(y) + F.col("_y2")) / 2 * F.col("_dx")).alias("area"), (F.max("_top") + F.ln(F.sum("_e"))).alias("ln_area"))


def feature_frame(records: DataFrame, names: list[str], field: str = "features", sep: str = ",") -> DataFrame:
    """A column for each feature named by a header, from a record's list of values; a missing or broken value is null."""
    values = F.split(F.col(field), sep)
    return records.select(*[c for c in records.columns if c != field], *[F.get(values, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def importance(model, features: list[str]) -> list[tuple[str, float]]:
    """Features of a trained forest by importance, largest first; ties by name."""
    return sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
