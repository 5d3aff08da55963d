"""JSON models and small tables that callers look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of an error model file.
ERROR_MODEL = "sample array<struct<isStatic:boolean,sampleName:string,motif:array<struct<indelRate:double,noisyLocusRate:double,repeatCount:int,repeatPatternSize:int>>>>"
THETA_MODEL = "thetas array<struct<repeatPatternSize:int,theta:array<double>>>"


def read_error_model(spark: SparkSession, path: str) -> DataFrame:
    """sample, pattern size, repeat count, rates: one row per motif."""
    s = spark.read.schema(ERROR_MODEL).option("multiLine", True).json(path).select(F.explode("sample").alias("s"))
    m = s.select(F.col("s.sampleName").alias("sample"), F.explode("s.motif").alias("m"))
    return m.select("sample", F.col("m.repeatPatternSize").alias("pattern"), F.col("m.repeatCount").alias("count"), F.col("m.indelRate").alias("rate"), F.col("m.noisyLocusRate").alias("noisy"))


def read_theta(spark: SparkSession, path: str) -> DataFrame:
    """pattern, count (1-based place), theta."""
    t = spark.read.schema(THETA_MODEL).option("multiLine", True).json(path).select(F.explode("thetas").alias("t"))
    return t.select(F.col("t.repeatPatternSize").alias("pattern"), F.posexplode("t.theta").alias("count", "theta")).withColumn("count", F.col("count") + 1)


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("contig string, depth double").csv(path)


def summed_depths(*tables: DataFrame) -> DataFrame:
    """Depth by contig over samples; every table must name the same contigs."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    n = len(tables)
    s = out.groupBy("contig").agg(F.sum("depth").alias("depth"), F.count("*").alias("n"))
    return s.select("contig", F.when(F.col("n") == n, F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("contig is not in every table: "), "contig")).cast("double")).alias("depth"))


def looked_up(rows: DataFrame, model: DataFrame, complex_: str = "is_complex") -> DataFrame:
    """Rates by (pattern, count); complex alleles, and contexts the model lacks, use (1, 1). The model has a row per context, some hundreds at most."""
    key = rows.withColumns({"_p": F.when(F.col(complex_), 1).otherwise(F.col("pattern")), "_c": F.when(F.col(complex_), 1).otherwise(F.col("count"))})
    m = model.select(F.col("pattern").alias("_p"), F.col("count").alias("_c"), "rate")
    base = m.filter("_p = 1 and _c = 1").agg(F.max("rate").alias("_base"))
    # one row
    return key.join(m, ["_p", "_c"], "left").crossJoin(F.broadcast(base)).withColumn("rate", F.coalesce("rate", "_base")).drop("_p", "_c", "_base")


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labelled feature tables as CSV with a header; dots are missing values."""
    return spark.read.option("header", True).option("nullValue", ".").schema(schema).csv(path)
