"""Files written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from gridlark.sources import formats, models, records


def _write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_bed_and_index(spark, tmp_path):
    rows = [("b", 5, 9), ("a", 7, 8), ("a", 1, 3)]
    formats.write_bed(spark.createDataFrame(rows, "contig string, begin long, end long"), str(tmp_path / "bed"))
    back = [tuple(r)[:3] for r in formats.read_bed(spark, str(tmp_path / "bed")).collect()]
    assert sorted(back) == sorted(rows)
    fai = _write(tmp_path, "x.fai", "chr2\t30\t6\t10\t11\nchr1\t20\t50\t10\t11\nchrM\t5\t90\t10\t11\n")
    assert {(r.contig, r.length, r["rank"]) for r in formats.read_fai(spark, fai).collect()} == {("chrM", 5, 3), ("chr1", 20, 2), ("chr2", 30, 1)}


def test_fasta_region(spark, tmp_path):
    path = _write(tmp_path, "x.fa", ">one some text\nACGT\nacgr\n>two\nGG\n")
    seqs = formats.read_fasta(spark, path)
    assert {r.contig: r.seq for r in seqs.collect()} == {"one": "ACGTACGN", "two": "GG"}
    assert [tuple(r) for r in formats.fasta_region(seqs, "one", 2, 20).collect()] == [("one", 2, "GTACGN")]


def test_sam_reads(spark, tmp_path):
    line = lambda n, pos, cigar, seq, qual: f"{n}\t16\tchr1\t{pos}\t60\t{cigar}\t*\t0\t0\t{seq}\t{qual}\n"
    path = _write(tmp_path, "a.sam", "@HD\tVN:1.6\n" + line("r1", 11, "2M3D1M", "ACG", "II!") + line("r2", 40, "3M", "ACG", "III") + line("r3", 12, "3M", "ACG", "*"))
    got = {r.qname: r for r in formats.read_sam(spark, path).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].is_reverse and got["r1"].pos == 10 and got["r1"].qual[:3] == [40, 40, 0]
    assert [r.qname for r in formats.read_sam(spark, path, ("chr1", 14, 16)).collect()] == ["r1"]
    bad = _write(tmp_path, "b.sam", line("r1", 11, "3M", "A=G", "III"))
    with pytest.raises(Exception, match="equal to the reference"):
        formats.read_sam(spark, bad).collect()


def test_vcf_regions_and_trimming(spark, tmp_path):
    rec = lambda pos, ref, alt: f"chr1\t{pos}\t.\t{ref}\t{alt}\t.\tPASS\t.\n"
    path = _write(tmp_path, "a.vcf", "##x\n#CHROM\n" + rec(5, "A", "AT") + rec(9, "CAT", "C") + rec(20, "AC", "GT"))
    assert [r.pos for r in formats.read_vcf(spark, path, strict=True, region=("chr1", 4, 9)).orderBy("pos").collect()] == [5, 9]
    for ref, alt in (("CAT", "CT"), ("AC", "AG"), ("CAT", "CAG")):
        with pytest.raises(Exception, match="not normalised"):
            formats.read_vcf(spark, _write(tmp_path, f"{ref}{alt}.vcf", rec(5, ref, alt)), strict=True).collect()


def test_models_and_tables(spark, tmp_path):
    theta = _write(tmp_path, "t.json", json.dumps({"thetas": [{"repeatPatternSize": 1, "theta": [0.1, 0.2]}, {"repeatPatternSize": 2, "theta": [0.3]}]}))
    assert {(r.pattern, r["count"], r.theta) for r in models.read_theta(spark, theta).collect()} == {(1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.3)}
    a, b = _write(tmp_path, "a.tsv", "c1\t2.5\nc2\t1.0\n"), _write(tmp_path, "b.tsv", "c1\t1.5\nc2\t3.0\n")
    one, two = models.read_depths(spark, a), models.read_depths(spark, b)
    assert {tuple(r) for r in models.summed_depths(one, two).collect()} == {("c1", 4.0), ("c2", 4.0)}
    with pytest.raises(Exception, match="not in every table"):
        models.summed_depths(one, two.filter("contig = 'c1'")).collect()
    csv = _write(tmp_path, "f.csv", "x,y,tag\n1.5,.,TP\n.,2,FP\n")
    assert [tuple(r) for r in models.read_features(spark, csv, "x double, y double, tag string").collect()] == [(1.5, None, "TP"), (None, 2.0, "FP")]


def test_records_are_written_in_order_under_a_header(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 30), ("a", 4)], "chrom string, pos long")
    line = records.line(F.col("chrom"), F.col("pos"), F.lit("A"), F.lit("T"), F.lit(None), F.lit("PASS"), [("SOMATIC", None), ("DP", F.col("pos")), ("X", F.lit(None).cast("string"))], ["GT", "AD"], [[F.lit("0/1"), F.lit(None)]])
    records.write_records(rows.withColumn("line", line), str(tmp_path / "out"), ["##fileformat=VCFv4.1", "#CHROM"])
    parts = sorted((tmp_path / "out").glob("*/part-*"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text == ["##fileformat=VCFv4.1", "#CHROM", "a\t4\t.\tA\tT\t.\tPASS\tSOMATIC;DP=4\tGT:AD\t0/1:.", "a\t30\t.\tA\tT\t.\tPASS\tSOMATIC;DP=30\tGT:AD\t0/1:.", "b\t2\t.\tA\tT\t.\tPASS\tSOMATIC;DP=2\tGT:AD\t0/1:."]
    back = formats.read_vcf(spark, [str(p) for p in parts]).orderBy("chrom", "pos").collect()
    assert [(r.chrom, r.pos, r.alt, r.samples) for r in back] == [("a", 4, ["T"], ["0/1:."]), ("a", 30, ["T"], ["0/1:."]), ("b", 2, ["T"], ["0/1:."])]
