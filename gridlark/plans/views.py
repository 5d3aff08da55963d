"""Views that give the driver's tables the shapes of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLELES = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base calls: pos, base, q, is_fwd, sample (0 normal, 1 tumour), lib, mapq, read_id, read_pos."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pos"),
        F.col("l_returnflag").alias("base"),
        F.floor("l_quantity").cast("int").alias("q"),
        (F.col("l_linestatus") == "F").alias("is_fwd"),
        (F.col("l_linenumber") % 2).cast("int").alias("sample"),
        F.col("l_suppkey").alias("lib"),
        (F.floor(F.col("l_discount") * 100 + 0.5).cast("int") * 6).alias("mapq"),
        F.col("l_orderkey").alias("read_id"),
        F.col("l_linenumber").cast("int").alias("read_pos"),
    )


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference allele of each position."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.element_at(F.array(*map(F.lit, ALLELES)), (F.col("p_size") % 3 + 1).cast("int")).alias("ref"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping regions (contig, begin, end, id)."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("contig"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.col("p_partkey").alias("id"))


def typed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions with their kind, the type of the part."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("contig"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("begin"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.col("p_partkey").alias("id"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positions (contig = user, pos = seconds since 2024-01-01, class, value)."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("contig"), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000000).cast("long").alias("pos"), F.col("event_type").alias("class"), "value")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled candidates: id, score, and tag TP or FP."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 100).cast("long").alias("score"), F.when(F.col("quality") == 1, "TP").otherwise("FP").alias("tag"), "lang", F.col("toxic").alias("masked"))
