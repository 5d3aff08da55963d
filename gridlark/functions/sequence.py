"""Sequences, CIGAR strings, alleles and record fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"(\d+)([MIDNSHP=X])"


def cigar(text: Column) -> Column:
    """Array of (op, len); parts of no length are dropped."""
    n, op = F.regexp_extract_all(text, F.lit(_PART), F.lit(1)), F.regexp_extract_all(text, F.lit(_PART), F.lit(2))
    return F.filter(F.zip_with(n, op, lambda a, b: F.struct(b.alias("op"), a.cast("int").alias("len"))), lambda s: s["len"] > 0)


def cigar_valid(text: Column) -> Column:
    return text.rlike(r"^(?:\d+[MIDNSHP=X])+$")


def cigar_length(path: Column, ops: str) -> Column:
    """Bases in segments of the given ops: MIS=X for the read, MDN=X for the reference, M=X for matches, ID for gaps."""
    return F.aggregate(path, F.lit(0), lambda acc, s: acc + F.when(s["op"].isin(list(ops)), s["len"]).otherwise(0))


def cigar_count(path: Column, ops: str) -> Column:
    return F.size(F.filter(path, lambda s: s["op"].isin(list(ops))))


def cigar_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["len"].cast("string"), s["op"])), "")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def repeat_unit(seq: Column) -> Column:
    """The shortest unit that tiles the sequence, and how often: (unit, count)."""
    n = F.length(seq)
    tiles = F.filter(F.sequence(F.lit(1), n), lambda k: (n % k == 0) & (F.repeat(F.substr(seq, F.lit(1), k), (n / k).cast("int")) == seq))
    unit = F.substr(seq, F.lit(1), tiles[0])
    return F.when(n > 0, F.struct(unit.alias("unit"), (n / tiles[0]).cast("int").alias("count")))


def genotype_index(a0: Column, a1: Column) -> Column:
    """Place of a diploid genotype in a likelihood vector."""
    lo, hi = F.least(a0, a1), F.greatest(a0, a1)
    return lo + (hi * (hi + 1) / 2).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common suffix."""
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda k: F.right(a, k) == F.right(b, k))), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda k: F.left(a, k) == F.left(b, k))), F.lit(0))


def trimmed_allele(pos: Column, ref: Column, alt: Column) -> Column:
    """(pos, del_len, ins_seq) of a record: the common suffix goes first, then the common prefix; each allele keeps what is left."""
    s = common_suffix(ref, alt)
    r, a = F.left(ref, F.length(ref) - s), F.left(alt, F.length(alt) - s)
    p = common_prefix(r, a)
    return F.struct((pos + p).alias("pos"), (F.length(r) - p).alias("del_len"), F.substr(a, p + 1).alias("ins_seq"))


def info_value(info: Column, key: str) -> Column:
    """Value of key=value in a semicolon list; null if absent."""
    return F.try_element_at(F.str_to_map(info, F.lit(";"), F.lit("=")), F.lit(key))


def format_value(fmt: Column, sample: Column, key: str) -> Column:
    """A sample's field by its place in the FORMAT column; null if absent."""
    at = F.array_position(F.split(fmt, ":"), F.lit(key)).cast("int")
    return F.when(at > 0, F.get(F.split(sample, ":"), at - 1))


def region_of(text: Column) -> Column:
    """(contig, begin, end) of `contig:start-end`, 1-based and closed, as 0-based and half-open; a bare contig is unbounded."""
    rx = r"^(.*):([0-9,]+)-([0-9,]+)$"
    num = lambda i: F.regexp_replace(F.regexp_extract(text, rx, i), ",", "").cast("long")
    hit = text.rlike(rx)
    return F.struct(F.when(hit, F.regexp_extract(text, rx, 1)).otherwise(text).alias("contig"), F.when(hit, num(2) - 1).alias("begin"), F.when(hit, num(3)).alias("end"))


def left_normalised(ref: Column, alt: Column) -> Column:
    """Whether a record is trimmed on the right: the alleles' last bases differ, or one allele is a single base."""
    return (F.right(ref, F.lit(1)) != F.right(alt, F.lit(1))) | (F.least(F.length(ref), F.length(alt)) == 1)


def variant_class(ref: Column, alt: Column) -> Column:
    simple = ref.rlike("^[ACGTN]+$") & alt.rlike("^[ACGTN]+$")
    return F.when(alt.isin(".", ""), "ref").when(~simple, "symbolic").when((F.length(ref) == 1) & (F.length(alt) == 1), "snv").when(F.length(ref) == F.length(alt), "mnv").otherwise("indel")


def flank_repeats(unit: Column, upstream: Column, downstream: Column) -> Column:
    """How often a unit repeats right before and right after a place: (up, down)."""
    step = F.greatest(F.length(unit), F.lit(1))
    most = lambda flank: F.floor(F.length(flank) / step).cast("int")
    run = lambda flank, take: F.array_max(F.filter(F.sequence(F.lit(0), most(flank)), lambda k: take(flank, k * step) == F.repeat(unit, k)))
    return F.struct(run(upstream, F.right).alias("up"), run(downstream, F.left).alias("down"))


def has_match(path: Column) -> Column:
    """Whether a read has a base that stands on the reference; one without floats."""
    return F.exists(path, lambda s: s["op"].isin("M", "=", "X"))


def copy_number_region(pos: Column, info: Column, fmt: Column, sample: Column) -> Column:
    """(begin, end, ploidy) of a copy-number record: from after the record's 1-based position to INFO END, with the sample's CN; null without either."""
    end, cn = info_value(info, "END").cast("long"), format_value(fmt, sample, "CN").cast("int")
    return F.when(end.isNotNull() & cn.isNotNull(), F.struct(pos.cast("long").alias("begin"), end.alias("end"), cn.alias("ploidy")))


def is_normalised(ref: Column, alt: Column) -> Column:
    """Whether a record is trimmed on both sides: last bases differ, and first ones but for a padding base; a substitution of several bases need only differ at its ends."""
    last = F.right(ref, F.lit(1)) != F.right(alt, F.lit(1))
    first = F.left(ref, F.lit(1)) != F.left(alt, F.lit(1))
    shorter = F.least(F.length(ref), F.length(alt))
    return F.when(F.length(ref) == F.length(alt), last & first).otherwise((shorter == 1) | (last & ~((shorter > 1) & (F.left(ref, F.lit(2)) == F.left(alt, F.lit(2))))))


def tandem_count(seq: Column, pos: Column, size: Column) -> Column:
    """Repeats of the unit of `size` bases at pos (from 0) if it is the left end of its tract, else 1."""
    unit = F.substr(seq, pos + 1, size)
    left_end = (pos <= size - 1) | (F.substr(seq, pos, F.lit(1)) != F.substr(seq, pos + size, F.lit(1)))
    most = F.greatest(F.lit(1), F.floor((F.length(seq) - pos) / size).cast("int"))
    count = F.array_max(F.filter(F.sequence(F.lit(1), most), lambda k: F.substr(seq, pos + 1, k * size) == F.repeat(unit, k)))
    return F.when(left_end, F.coalesce(count, F.lit(1))).otherwise(1)


def encodable(context: Column, words: int) -> Column:
    """Bases of a context that so many words encode, each but the first being the shortest run that what came before does not hold."""
    padded = F.concat(context, F.lit("#"))  # the end is a base of its own

    def step(n: Column, _: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n)), lambda k: ~F.contains(F.left(padded, n), F.substr(padded, n + 1, k)))
        return n + F.coalesce(F.array_min(fresh), F.lit(1))

    return F.aggregate(F.sequence(F.lit(2), F.lit(words)), F.lit(1), step) if words > 1 else F.lit(1)


def compressibility(seq: Column, left: Column, right: Column, words: int) -> Column:
    """The longer of the contexts left of `left` and from `right` on (from 0) that so many words encode."""
    return F.greatest(encodable(F.reverse(F.left(seq, left)), words), encodable(F.substr(seq, right + 1), words))


def match_segments(path: Column, pos: Column) -> Column:
    """(begin, end) of each stretch of a read that stands on the reference, its first base at pos."""

    def step(acc: Column, s: Column) -> Column:
        on = s["op"].isin("M", "=", "X")
        after = acc["at"] + F.when(on | s["op"].isin("D", "N"), s["len"]).otherwise(0)
        own = F.array(F.struct(acc["at"].alias("begin"), after.alias("end")))
        return F.struct(after.alias("at"), F.when(on, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return F.aggregate(path, F.struct(pos.cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
