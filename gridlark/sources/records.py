"""Variant records as text lines: what each sink writes, from rows of calls. `write_records` puts them under a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("."))


def _joined(values: list[Column], sep: str) -> Column:
    return F.concat_ws(sep, *[_shown(v) for v in values])


def line(chrom: Column, pos: Column, ref: Column, alt: Column, qual: Column, filters: Column, info: list[tuple[str, Column | None]], fmt: list[str], samples: list[list[Column]]) -> Column:
    """One record; positions are 1-based. A flag is an INFO key with None; nulls are dots, absent INFO values are left out."""
    said = [F.lit(k) if v is None else F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in info]
    pairs = F.array_join(F.filter(F.array(*said), lambda x: x.isNotNull()), ";") if said else F.lit("")
    fields = [_shown(chrom), pos.cast("string"), F.lit("."), _shown(ref), _shown(alt), _shown(qual), _shown(filters), F.when(pairs == "", ".").otherwise(pairs)]
    return F.concat_ws("\t", *fields, F.lit(":".join(fmt)), *[_joined(s, ":") for s in samples])


def counts(values: list[Column]) -> Column:
    return F.concat_ws(",", *[v.cast("string") for v in values])


#: The FORMAT fields of each sink.
SITE = ["GT", "GQ", "GQX", "DP", "DPF", "AD", "ADF", "ADR", "SB", "FT", "PL"]
INDEL = ["GT", "GQ", "GQX", "DPI", "AD", "ADF", "ADR", "FT", "PL"]
BLOCK = ["GT", "GQX", "DP", "DPF", "MIN_DP"]
SOMATIC_SITE = ["DP", "FDP", "SDP", "SUBDP"]
SOMATIC_INDEL = ["DP", "DP2", "TAR", "TIR", "TOR"]


def genotype_numbers(gt: Column, alleles: Column) -> Column:
    """A genotype of allele names (a/b) as places in the array of alleles, the smaller first."""
    at = lambda i: F.array_position(alleles, F.split(gt, "/")[i]) - 1
    return F.concat_ws("/", F.least(at(0), at(1)).cast("string"), F.greatest(at(0), at(1)).cast("string"))


def block_line(chrom: Column, begin: Column, end: Column, ref: Column, filters: Column, gqx: Column, dp: Column, dpf: Column, least_dp: Column) -> Column:
    """A block of sites without a variant: END, the smallest GQX, rounded mean depths and the smallest depth."""
    info = [("END", F.when(end > begin + 1, end)), ("BLOCKAVG_min30p3a", None)]
    return line(chrom, begin + 1, ref, F.lit("."), F.lit(None), filters, info, BLOCK, [[F.lit("0/0"), gqx, dp, dpf, least_dp]])


def write_records(lines: DataFrame, path: str, header: list[str]) -> None:
    """Lines (chrom, pos, line) in order over all files; the header lies in a file of its own whose name sorts first."""
    lines.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.text(f"{path}/0-header")
    lines.orderBy("chrom", "pos", "line").select(F.col("line").alias("value")).write.text(f"{path}/1-records")
