"""The corpus pipeline: five stages over documents, each written and read again.

Quality rules reject documents; one document of each near-duplicate component stays;
contaminated documents go; documents are taken as often as their mixing rate says;
shards and places are assigned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import bloom, decontam, mixing, ngram_join, quality, sharding
from gridlark.llm.queries import DOMAINS, SHARES
from gridlark.llm.stores import stored


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents under names of our own (c0, c1, ...), so that no column an operator adds clashes with one they have; and the names of id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects, all their columns.

    A null or empty text has too few words and goes; repeated rows stay or go together;
    an empty table gives no rows; further columns pass, whatever their names.
    """
    rows, _, text = _numbered(docs)
    return quality.judged(rows, rows.columns, text).filter("kept").select(rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id, of equal ids with the smallest hash of its text, of equal rows any one.

    Documents without words or without an id stay.  An empty table gives no rows;
    further columns pass, whatever their names.

    Most documents are no copies: a Bloom filter over those that go, and those whose row
    is repeated, lets the others through without a shuffle.
    """
    rows, id_col, text = _numbered(docs)
    found = ngram_join.labelled(rows, id_col, text).filter("doc_id is not null and label is not null")
    counted = found.groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    counted = stored(counted, "counted")
    first = counted.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    marked = counted.join(first, "label").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first"))
    marked = stored(marked.filter("not stays or n > 1").select("doc_id", "text_hash", "stays"), "marked")
    hashed = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(0)).bitwiseXOR(hashed)
    may = bloom.passes(bloom.built(marked.select(F.col("doc_id").bitwiseXOR(F.col("text_hash")))), key)
    listed = rows.filter(may).withColumns({"k_id": F.col(id_col).cast("long"), "k_hash": hashed})
    listed = listed.join(marked.toDF("k_id", "k_hash", "stays"), ["k_id", "k_hash"], "left")
    out = rows.filter(~may).union(listed.filter("stays is null").select(rows.columns))
    if not marked.filter("stays").isEmpty():
        out = out.union(listed.filter("stays").dropDuplicates(["k_id", "k_hash"]).select(rows.columns))
    return out.toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in windows of test items.

    A null or empty text has no words and stays; repeated rows stay or go together; an
    empty table gives no rows; further columns pass, whatever their names.
    """
    rows, _, text = _numbered(docs)
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.benchmark_hits(rows, tests, rows.columns, text).filter(~decontam.contaminated()).select(rows.columns).toDF(*docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, at random by its id but the same in every run.

    A null or empty text has no tokens and the prior's rate; repeated rows are taken
    equally often, as are rows with one id and text; an empty table gives no rows; further columns pass, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "c_id")
    rows, id_col, text = _numbered(docs)
    _, fit = mixing.mixed(rows.withColumnRenamed(id_col, "c_id"), labels, DOMAINS, SHARES, "c_id", text)
    # rates follow from the text and the fit alone, so texts are read again instead of joined
    rated = mixing.memberships(rows, fit["model"], text, fit["residuals"], rows.columns)
    taken = rated.withColumn("copies", mixing.copies(F.col("rate"), F.col(id_col))).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(rows.columns).toDF(*docs.columns)


def sharding_by_slots(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with size, text_crc32, virtual_slot, shard, slot and next_shard; columns of these names are replaced, further ones pass.

    A null text has no bytes; a null id hashes like any; an empty table gives no rows.
    """
    return sharding.sharded(docs, ["doc_id"], shards=24, folder=sharding.map_folder(spark, "pipeline", sf_dir))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_weights", mixing_to_weights),
    ("sharding", sharding_by_slots),
]
#: Near duplicates and mixing are iterations, which one SQL query does not express; tests/llm holds each stage against a plain model of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
