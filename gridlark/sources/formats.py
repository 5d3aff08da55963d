"""Text formats: records in, records out. Files are read and written by Spark, wherever its paths lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.sequence import cigar, cigar_length, is_normalised
from gridlark.operators.evaluate import level_ranks


def read_vcf(spark: SparkSession, path: str, strict: bool = False, region: tuple[str, int, int] | None = None) -> DataFrame:
    """chrom, pos (1-based), id, ref, alt (array), qual, filter (array), info, format, samples (array). Strict: a record that is not trimmed is an error. region: only records that begin in (contig, begin, end), from 0 and half-open."""
    fields = F.split("value", "\t")
    f = [F.get(fields, F.lit(i)) for i in range(9)]
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    out = rows.select(
        f[0].alias("chrom"),
        f[1].cast("long").alias("pos"),
        f[2].alias("id"),
        F.upper(f[3]).alias("ref"),
        F.split(f[4], ",").alias("alt"),
        F.nullif(f[5], F.lit(".")).cast("double").alias("qual"),
        F.split(f[6], ";").alias("filter"),
        f[7].alias("info"),
        f[8].alias("format"),
        F.slice(fields, 10, F.greatest(F.size(fields) - 9, F.lit(0))).alias("samples"),
    )
    if strict:
        bad = F.exists("alt", lambda a: a.rlike("^[ACGTN]+$") & ~is_normalised(F.col("ref"), a))
        out = out.withColumn("pos", F.when(bad, F.raise_error(F.concat(F.lit("record is not normalised: "), "chrom", F.lit(":"), F.col("pos").cast("string"))).cast("long")).otherwise(F.col("pos")))
    return out if region is None else out.filter((F.col("chrom") == region[0]) & F.col("pos").between(region[1] + 1, region[2]))


def vcf_line(rows: DataFrame, chrom: Column, pos: Column, ref: Column, alt: Column, qual: Column, filters: Column, info: list[tuple[str, Column]], fmt: list[tuple[str, Column]]) -> DataFrame:
    """One text line per row; nulls are dots, absent INFO keys are left out."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    pairs = F.array_join(F.array(*[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in info]), ";")
    fields = [shown(chrom), shown(pos), F.lit("."), shown(ref), shown(alt), shown(qual), shown(filters), F.when(pairs == "", ".").otherwise(pairs), F.lit(":".join(k for k, _ in fmt)), F.concat_ws(":", *[shown(c) for _, c in fmt])]
    return rows.select("*", F.concat_ws("\t", *fields).alias("line"))


def read_bed(spark: SparkSession, path: str, skip_invalid: bool = False) -> DataFrame:
    """contig, begin, end, name. An empty or reversed interval is left out or, by default, an error."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("contig string, begin long, end long, name string").csv(path)
    if skip_invalid:
        return rows.filter("begin < end")
    return rows.withColumn("begin", F.when(F.col("begin") < F.col("end"), F.col("begin")).otherwise(F.raise_error(F.lit("an interval is empty or reversed")).cast("long")))


def write_bed(regions: DataFrame, path: str) -> None:
    """Sorted over all files: the range partitioning keeps files in order."""
    regions.select("contig", "begin", "end").orderBy("contig", "begin").write.option("sep", "\t").csv(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, seq: upper case, codes other than ACGT as N. A file holds one record per `>`."""
    rows = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    seq = F.regexp_replace(F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "")), "[^ACGT]", "N")
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("contig"), seq.alias("seq"))


def fasta_region(sequences: DataFrame, contig: str, begin: int, end: int) -> DataFrame:
    """contig, begin, seq: the part of a contig from begin to end (from 0, half-open), as far as it reaches."""
    return sequences.filter(F.col("contig") == contig).select("contig", F.lit(begin).cast("long").alias("begin"), F.substr("seq", F.lit(begin + 1), F.lit(end - begin)).alias("seq"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """contig, length, rank: contig sizes in the order of the index, by its byte offsets."""
    rows = spark.read.option("sep", "\t").schema("contig string, length long, offset long, bases int, width int").csv(path)
    return rows.select("contig", "length", "offset").join(level_ranks(rows.withColumn("_at", -F.col("offset")), "_at").select((-F.col("_at")).alias("offset"), "rank"), "offset").select("contig", "length", "rank")


def read_sam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Reads of SAM text: qname, flag bits as booleans, contig, 0-based pos, mapq, cigar path, seq, qualities.

    Qualities over 70, and bases written as equal to the reference, are an error; reads
    without qualities are left out.  region: only reads that touch (contig, begin, end).
    """
    fields = F.split("value", "\t")
    f = [F.get(fields, F.lit(i)) for i in range(11)]
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (f[10] != "*"))
    if region is not None:
        begin = f[3].cast("long") - 1
        rows = rows.filter((f[2] == region[0]) & (begin < region[2]) & (begin + F.greatest(F.lit(1), cigar_length(cigar(f[5]), "MDN=X")) > region[1]))
    flag = f[1].cast("int")
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    quals = F.transform(F.split(f[10], ""), lambda c: F.ascii(c) - 33)
    bad = F.exists(quals, lambda q: q > 70)
    return rows.select(
        f[0].alias("qname"),
        *[bit(b).alias(n) for n, b in (("is_paired", 1), ("is_proper", 2), ("unmapped", 4), ("mate_unmapped", 8), ("is_reverse", 16), ("is_secondary", 256), ("is_qcfail", 512), ("is_dup", 1024), ("is_supp", 2048))],
        f[2].alias("contig"),
        (f[3].cast("long") - 1).alias("pos"),
        f[4].cast("int").alias("mapq"),
        cigar(f[5]).alias("cigar"),
        F.when(F.contains(f[9], F.lit("=")), F.raise_error(F.lit("a base is written as equal to the reference")).cast("string")).otherwise(f[9]).alias("seq"),
        F.when(bad, F.raise_error(F.lit("a base quality is over 70")).cast("array<int>")).otherwise(quals).alias("qual"),
    )


def merged_sources(*sources: DataFrame) -> DataFrame:
    """One table of many position-sorted ones, in order of (contig, pos, source): a range shuffle, no merge in one task."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("src_rank", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out.orderBy("contig", "pos", "src_rank")


def sorted_records(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """By contig rank, position and end; of records equal in place and alleles one stays: passing first, then the highest quality, then one that is not symbolic."""
    from pyspark.sql import Window

    w = Window.partitionBy("chrom", "pos", "ref", "alt").orderBy(F.desc(F.col("filter") == "PASS"), F.desc_nulls_last("qual"), F.col("alt").startswith("<"), "id")
    best = records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return best.join(contigs.select(F.col("contig").alias("chrom"), "rank"), "chrom").orderBy("rank", "pos", "end").drop("rank")
