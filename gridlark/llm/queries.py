"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm import chat, decontam, html_text, licenses, mixing, ngram_join, pii, quality, sharding, warc


#: Domains of the labelled table, in order of precedence, and their target shares of all tokens.
DOMAINS = (("toxic", "toxic = 1"), ("good", "quality = 1"), ("poor", "quality = 0"))
SHARES = [0.02, 0.93, 0.05]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judged(table(spark, sf_dir, "documents"), ["doc_id"], measured=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra.select("conv_id", "t.turn", "t.role", F.lit(said)))
    out = chat.formatted(rows)
    turns = chat.turns_of(F.col("formatted"))
    whole = F.concat_ws("", F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = chat.loss_text(F.col("segments"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "refused_turn")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.sharded(docs.select("doc_id", "text"), ["doc_id"], shards=24, folder=sharding.map_folder(spark, "documents", sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"), ["doc_id"])
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", (lambda k: lambda s: s["kind"] == k)(k))).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    every = F.concat("base", "added")
    return found.select("doc_id", *counts, F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said(every).alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scanned(table(spark, sf_dir, "documents"), ["doc_id"], templates=licenses.TEMPLATES + licenses.whole_texts())
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(licenses.labels(), ",").alias("labels"), licenses.score().alias("score"), F.filter("spans", lambda s: s["covered"] >= licenses.COVERED).alias("found"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(table(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.page_text(table(spark, sf_dir, "pages"), ["page_id"])
    return out.select("page_id", "text", F.length("text").cast("long").alias("text_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, fit = mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), DOMAINS, SHARES)
    return out.select("doc_id", "tokens", *[F.col("p")[k].alias(f"p_{name}") for k, (name, _) in enumerate(DOMAINS)], "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(",".join(fit["unmet"])).alias("unmet_domains"))
