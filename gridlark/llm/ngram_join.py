"""Exact n-gram Jaccard join by regions of a metric space.

Documents are sets of 5-word shingles; 1 - Jaccard is a metric, and documents
within RADIUS = 0.2 link.  Two kinds of pivots carve the space.

*Shingle pivots.*  The distance from a document x of n shingles to the one-element
set {s} is 1 - 1/n if s is in x, else 1: the Voronoi cell of {s} holds documents
with s, and ties between cells are broken by one order over shingles (rarest
first).  A document within RADIUS of x holds at least ceil(0.8 n) of x's shingles,
so it holds one of the first n - ceil(0.8 n) + 1 of them: x is replicated to
those cells, the window within which each neighbour's copy must lie.  A document
pivot cannot do this first step: nearly all pairs of documents lie at distance
exactly 1, so that every document would lie in every other pivot's window.

*Document pivots.*  Cells of at most LEAF documents give all their pairs.  A larger
cell is cut by documents: its documents are measured against its first pivots, and
those within RADIUS of one become a class.  The cell is joined again as long as it
holds more than one class: the next pivots are drawn from outside its main class and
measured against what is not of their class, and pivots leave the cell.  Distances
to the first pivots are kept: |d(x,p) - d(y,p)| <= d(x,y), the triangle inequality,
rules later pairs out.

*A contraction of the metric.*  Each set is also counted into BINS bins by hash.  The
bins' shared counts are at least the shared shingles, so the distance of two
histograms is at most that of the sets: pairs whose histograms lie further apart
than RADIUS are dropped before any text is moved for them.

Copies (equal sets) are one class from the start.  No pair within a group of
copies is made, no shingle is dropped, and every pair of classes that links is
joined through a chain of verified links.

Only shingles that hold over FREQUENT / 2 of all shingle occurrences are counted,
which bounds that table to 2 / FREQUENT entries whatever the corpus; they come
last in the order.  Cells of shingles counted over LEAF times are dealt by (shingle,
document), so no key meets in one task.  Shingles are compared by 64-bit hashes.  A
class is a 64-bit hash of its set; sets that share one by chance are told apart by a
second hash, so that classes rest on 128 bits.

Before texts or histograms are shuffled, Bloom filters of bounded size narrow them to
those that pairs name; the exact join follows.  This is the one plan at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm import bloom
from gridlark.llm.components import components
from gridlark.llm.stores import Scratch, stored
from gridlark.llm.text import U64, mix64, shingle_sets, string_chunks

WORDS, PERCENT = 5, 80
#: Share of all shingle occurrences from which a shingle is sure to count as frequent.
FREQUENT = 4e-6
#: Documents of a cell that are joined outright.
LEAF = 64
#: Document pivots that a larger cell takes first, and in later rounds; documents of a cell that meet in one task besides.
FIRST_PIVOTS, PIVOTS, PART = 2, 512, 2048
#: The radius of a link, and the bins of a histogram (counts of 8 bits).
RADIUS, BINS = 1 - PERCENT / 100, 1024
#: Candidates of each pivot that are measured, best histograms first, before the rest.
PROBES = 2
#: Rows of the cells for which tables of a few numbers a row get one file.
ROWS_A_FILE = 1_000_000
#: Shingles over which a task counts before it reports local frequent ones.
BLOCK = 1 << 20
#: Pairs whose texts a task holds unpacked at once.
PAIRS = 1024


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x, type=pa.int64())


def _class_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's set, whatever the order of its elements: the second tells sets apart that share the first."""
    out = []
    for salt in (0, 0x9E3779B97F4A7C15):
        total = np.zeros(len(hashes) + 1, U64)
        np.cumsum(mix64(hashes ^ U64(salt)), out=total[1:])
        out.append(mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64)))
    return out[0], mix64(out[0] ^ mix64(out[1]))


def _classes(hashes: np.ndarray, bounds: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The class of each text: the first hash, or where different sets share it the second."""
    first, second = _class_hashes(hashes, bounds)
    return np.where(np.isin(first, shared), second, first) if len(shared) else first


def _survey(id_col: str, text_col: str, words: int):
    """(0, document, class, size, second hash, text hash) of each document; (1, shingle, count) of those frequent in a block of a task; (2, 0, occurrences)."""

    def rows(kind: int, a, b, n, second=None, text=None) -> pa.RecordBatch:
        none = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), a if isinstance(a, pa.Array) else _signed(a), _signed(b), _signed(n), _signed(none if second is None else second), _signed(none) if text is None else text],
            ["kind", "a", "b", "n", "second", "text_hash"],
        )

    def flush(block: list[np.ndarray]):
        every = np.concatenate(block)
        values, counts = np.unique(every, return_counts=True)
        often = counts >= max(2, FREQUENT / 2 * len(every))
        yield rows(1, values[often], counts[often], np.zeros(often.sum(), np.int64))
        yield rows(2, np.zeros(1, np.int64), np.array([len(every)]), np.zeros(1, np.int64))

    def run(batches):
        block: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, hi, data, offsets in string_chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets, words)
                first, second = _class_hashes(hashes, bounds)
                yield rows(0, ids.slice(lo, hi - lo), first, np.diff(bounds), second, batch.column(2).slice(lo, hi - lo))
                block.append(hashes)
                held += len(hashes)
                if held >= BLOCK:
                    yield from flush(block)
                    block, held = [], 0
        if held:
            yield from flush(block)

    return run


def _postings(words: int, percent: int, leaf: int, frequent, shared):
    """(deal, s, x, n, at, wide): x lies in the cell of s, the shingle at that place of its order; wide cells are dealt by s and x."""

    def run(batches):
        values, counts = frequent.value
        seen: set[int] = set()  # copies within a task are sent once
        for batch in batches:
            for _, _, data, offsets in string_chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets, words)
                sizes, classes = np.diff(bounds), _classes(hashes, bounds, shared.value)
                rank = np.zeros(len(hashes), np.int64)
                if len(values) and len(hashes):
                    at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
                    rank = np.where(values[at] == hashes, counts[at], 0)
                fresh = np.zeros(len(sizes), bool)
                for d, c in enumerate(classes.tolist()):
                    if sizes[d] and c not in seen:
                        seen.add(c)
                        fresh[d] = True
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((hashes, rank, owner))
                place = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
                prefix = sizes + (-percent * sizes // 100) + 1
                keep = (place < prefix[owner]) & fresh[owner]
                s, x, wide = hashes[order][keep], classes[owner[keep]], rank[order][keep] >= leaf
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.where(wide, mix64(s ^ x), s)), _signed(s), _signed(x), pa.array(sizes[owner[keep]].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(wide)],
                    ["deal", "s", "x", "n", "at", "wide"],
                )

    return run


def _fits(na, nb, ia, ib, percent: int):
    """Whether sizes, and the places of the first common shingle, allow a link. Works on arrays and Columns alike."""
    least = (percent * (na + nb) + 99 + percent) // (100 + percent) if not isinstance(na, Column) else F.ceil(F.lit(percent) * (na + nb) / (100 + percent))
    if isinstance(na, Column):
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - ia, nb - ib) >= least)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - ia, nb - ib) >= least)


def _cells(percent: int, leaf: int):
    """Reads postings in order of s: pairs (0, x, y) of cells up to `leaf` documents, else the cell's postings (1, x, s, n, at)."""
    names = ["kind", "x", "other", "n", "at"]

    def emit(kind, x, other, n, at):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), _signed(x), _signed(other), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names)

    def joined(s, x, n, at):
        """All cells of these arrays are complete and small: pairs at each lag within a cell."""
        out_x, out_y = [], []
        for lag in range(1, leaf):
            if lag >= len(s):
                break
            same = s[lag:] == s[:-lag]
            if not same.any():
                break
            i = np.flatnonzero(same)
            i = i[_fits(n[i].astype(np.int64), n[i + lag].astype(np.int64), at[i], at[i + lag], percent)]
            out_x.append(x[i])
            out_y.append(x[i + lag])
        if out_x:
            a, b = np.concatenate(out_x), np.concatenate(out_y)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield emit(0, pairs[0], pairs[1], np.zeros(pairs.shape[1]), np.zeros(pairs.shape[1]))

    def cut(s, x, n, at, wide):
        """Complete cells."""
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
        s, x, n, at, wide = (v[fresh] for v in (s, x, n, at, wide))
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        size = np.repeat(size, size)
        large = wide | (size > leaf)
        if large.any():
            yield emit(1, x[large], s[large], n[large], at[large])
        small = ~large & (size > 1)
        if small.any():
            yield from joined(s[small], x[small], n[small], at[small])

    def run(batches):
        held: list[np.ndarray] | None = None
        over = None  # the shingle of a large cell that is being passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = new if held is None else [np.concatenate(v) for v in zip(held, new)]
            if over is not None:
                rest = held[0] == over
                if rest.any():
                    yield emit(1, held[1][rest], held[0][rest], held[2][rest], held[3][rest])
                    held = [v[~rest] for v in held]
                if len(held[0]):
                    over = None
                else:
                    continue
            tail = int(np.searchsorted(held[0], held[0][-1], side="left")) if not held[4][-1] else len(held[0])
            if tail:
                yield from cut(*(v[:tail] for v in held))
                held = [v[tail:] for v in held]
            if len(held[0]) > 4 * leaf and len(np.unique(held[1])) > leaf:
                over = held[0][0]
                yield emit(1, held[1], held[0], held[2], held[3])
                held = [v[:0] for v in held]
        if held is not None and len(held[0]):
            yield from cut(*held)

    return run


def _described(words: int, shared, wanted):
    """Of rows (id, text): class, the text compressed, size, and the histogram of the set (none if a bin is over its 8 bits).

    Rows that the filter of wanted classes and ids rules out, and repeats within the task, are left out.
    """

    def run(batches):
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in string_chunks(batch.column(1)):
                hashes, bounds = shingle_sets(data, offsets, words)
                sizes, classes = np.diff(bounds), _classes(hashes, bounds, shared.value).view(np.int64)
                own = bloom.may_hold(wanted.value, classes ^ ids[lo:hi]) & (sizes > 0)
                for i in np.flatnonzero(own).tolist():
                    c = int(classes[i])
                    own[i] = not (c in seen or seen.add(c))
                at = np.flatnonzero(own)
                place = np.cumsum(own) - 1
                owner = np.repeat(np.arange(len(sizes)), sizes)
                mine = own[owner]
                flat = place[owner[mine]] * BINS + (hashes[mine] >> U64(40)).astype(np.int64) % BINS
                bins = np.bincount(flat, minlength=BINS * len(at)).reshape(-1, BINS)
                out = [row.astype(np.uint8).tobytes() if row.max() < 256 else None for row in bins]
                raw = data.tobytes()
                packed = [pack.compress(raw[offsets[i] : offsets[i + 1]]) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(classes[at]), pa.array(packed, pa.binary()), pa.array(sizes[at]), pa.array(out, pa.binary())], ["class", "text", "n", "bins"])

    return run


def _near(percent: int):
    """Of rows (x, y, sizes, histograms): the pairs that may link by their histograms, and the similarity these allow."""

    def run(batches):
        for batch in (b.slice(at, 4 * PAIRS) for b in batches for at in range(0, b.num_rows, 4 * PAIRS)):
            known = np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False) & batch.column(5).is_valid().to_numpy(zero_copy_only=False))
            keep, most = np.ones(batch.num_rows, bool), np.ones(batch.num_rows)
            nx, ny = (batch.column(i).to_numpy() for i in (2, 3))
            if len(known):
                a, b = (np.frombuffer(b"".join(batch.column(i).take(pa.array(known)).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
                common = np.minimum(a, b).sum(axis=1, dtype=np.int64)
                keep[known] = 100 * common >= percent * (nx[known] + ny[known] - common)
                most[known] = common / (nx[known] + ny[known] - common)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(most).filter(keep)], ["x", "y", "most"])

    return run


def _against(percent: int, probes: int | None):
    """Reads (s, part, pivot, x, n, at, label, bins) in order of parts of cells, pivots first: the pairs of a pivot and a document of another class that may link, with probes only each pivot's best ones."""

    def meet(t: pa.Table):
        s, part, pivot, x, n, at, label = (t.column(i).to_numpy() for i in range(7))
        bins = np.frombuffer(b"".join(b if b is not None else b"\xff" * BINS for b in t.column(7).to_pylist()), np.uint8).reshape(-1, BINS)
        whole = np.array([b is not None for b in t.column(7).to_pylist()])
        n, at = n.astype(np.int64), at.astype(np.int64)
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (part[1:] != part[:-1])])
        out = []
        for a, b in zip(first, np.r_[first[1:], len(s)]):
            rows = a + np.flatnonzero(~pivot[a:b])
            for i in a + np.flatnonzero(pivot[a:b]):
                j = rows[(label[rows] != label[i]) & _fits(n[rows], n[i], at[rows], at[i], percent)]
                common = np.where(whole[j] & whole[i], np.minimum(bins[j], bins[i]).sum(axis=1, dtype=np.int64), np.minimum(n[j], n[i]))
                may = 100 * common >= percent * (n[j] + n[i] - common)
                j, most = j[may], (common / (n[j] + n[i] - common))[may]
                if probes is not None:
                    j = j[np.argsort(-most, kind="stable")[:probes]]
                out.append(np.stack([np.minimum(x[j], x[i]), np.maximum(x[j], x[i])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            s, part = t.column(0).to_numpy(), t.column(1).to_numpy()
            other = np.flatnonzero((s != s[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield meet(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield meet(held)

    return run


def _measured(words: int):
    """Of rows (x, y, compressed texts of both): x, y, and how many shingles they share and have together."""

    def run(batches):
        pack = zstandard.ZstdDecompressor()
        for batch in (b.slice(at, PAIRS) for b in batches for at in range(0, b.num_rows, PAIRS)):
            sets = []
            for c in (2, 3):
                parts = []
                for lo, hi, data, offsets in string_chunks(pa.array([pack.decompress(t) for t in batch.column(c).to_pylist()], pa.binary())):
                    hashes, bounds = shingle_sets(data, offsets, words)
                    parts += [hashes[bounds[i] : bounds[i + 1]] for i in range(hi - lo)]
                sets.append(parts)
            common = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)], np.int64)
            united = np.array([len(a) + len(b) for a, b in zip(*sets)], np.int64) - common
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(united)], ["x", "y", "common", "united"])

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id (the smallest id reachable by links) and class_id (the smallest id with an equal set).

    A null or empty text, or one without words, has an empty set: it links with
    nothing and is its own component.  Repeated rows each give a row.  A row with a
    null id takes part, but names no component: one reachable only by such rows has
    a null component_id.
    Other columns of docs are ignored, whatever their names.
    """
    return labelled(docs, id_col, text_col, words, percent, leaf).select("doc_id", "n_shingles", "component_id", "class_id")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """What jaccard_classes gives, with text_hash (xxhash64 of the text, a null one as empty) and label, which is one for each component even where ids repeat; null for an empty set."""
    spark = docs.sparkSession
    work = Scratch(spark, "ngram-join")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    survey = base.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_survey("doc_id", "text", words), "kind int, a long, b long, n long, second long, text_hash long")
    survey = stored(survey, "survey")
    total = survey.filter("kind = 2").agg(F.sum("b")).first()[0] or 0
    often = survey.filter("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).filter(F.col("c") >= max(2, FREQUENT / 2 * total))
    # at most 2 / FREQUENT entries, as their counts add up to `total` at most
    table = sorted((a % (1 << 64), c) for a, c in often.collect())
    frequent = spark.sparkContext.broadcast((np.array([a for a, _ in table], U64), np.array([c for _, c in table], np.int64)))
    # different sets of one first hash: n * n / 2 ** 65 of n classes, so none or a few
    clash = [r[0] for r in survey.filter("kind = 0 and n > 0").groupBy("b").agg((F.min("second") < F.max("second")).alias("clash")).filter("clash").collect()]
    shared = spark.sparkContext.broadcast(np.array([c % (1 << 64) for c in clash], U64))
    own_class = F.when(F.col("b").isin(clash), F.col("second")).otherwise(F.col("b")) if clash else F.col("b")
    every = survey.filter("kind = 0").select(F.col("a").alias("doc_id"), own_class.alias("class"), F.col("n").alias("n_shingles"), "text_hash")
    classes = work.stored(every.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("class_id")), "classes")

    postings = base.mapInArrow(_postings(words, percent, leaf, frequent, shared), "deal long, s long, x long, n int, at int, wide boolean")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = postings.repartition(parts, "deal").sortWithinPartitions("wide", "s", "n", "x").select("s", "x", "n", "at", "wide")
    cells = work.stored(cells.mapInArrow(_cells(percent, leaf), "kind int, x long, other long, n int, at int"), "cells")
    large = cells.filter("kind = 1").select(F.col("other").alias("s"), "x", "n", "at")

    # one text of each class that takes part, with its histogram
    taking = cells.select("x").union(cells.filter("kind = 0").select("other")).distinct().withColumnRenamed("x", "class").join(classes, "class")
    wanted = bloom.built(work.stored(taking.select(F.col("class").bitwiseXOR(F.coalesce("class_id", F.lit(0)))), "wanted"))
    texts = base.mapInArrow(_described(words, shared, wanted), "class long, text binary, n long, bins binary")
    texts = work.stored(texts.repartition(parts, "class").dropDuplicates(["class"]), "texts")
    join = _Join(work, texts, words, percent, cells.count() // ROWS_A_FILE + 1)

    pairs = cells.filter("kind = 0").select("x", F.col("other").alias("y"))
    first = _first_pivots(large, work)
    # pivots of one family of cells are mostly the same: distinct pairs are few
    stars = large.join(first, "s").select("x", "n", "at", F.explode("pivots").alias("p")).filter((F.col("x") != F.col("p.x")) & _fits(F.col("n"), F.col("p.n"), F.col("at"), F.col("p.at"), percent))
    near = work.stored(join.near(pairs.union(stars.select(F.least("x", "p.x"), F.greatest("x", "p.x")))), "near")
    # each document's best partner first, then what no label connects yet
    ends = near.select("x", "y", "most").union(near.select("y", "x", "most"))
    best = ends.groupBy("x").agg(F.max(F.struct("most", F.xxhash64("y"), "y")).alias("b")).select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y")).distinct()
    labels, tested = join.extended(None, best)
    rest = join.apart(near.select("x", "y").join(tested, ["x", "y"], "left_anti"), labels)
    labels, more = join.extended(labels, rest)
    tested = tested.union(more)
    if not large.isEmpty():
        labels = _large_cells(large, first, labels, tested, join)

    of_class = classes.join(labels, classes["class"] == labels["x"], "left").select("class", "class_id", F.coalesce("label", "class").alias("label"))
    least = work.stored(of_class.groupBy("label").agg(F.min("class_id").alias("component")), "least")
    of_class = stored(of_class.join(least, "label").select("class", "class_id", "component", "label"), "components")
    work.drop()
    has_set = F.col("n_shingles") > 0
    own = lambda c: F.when(has_set, F.col(c)).otherwise(F.col("doc_id"))
    return every.join(of_class, "class", "left").select("doc_id", "n_shingles", own("component").alias("component_id"), own("class_id").alias("class_id"), "text_hash", F.when(has_set, F.col("label")).alias("label"))


class _Join:
    """Measures candidate pairs of classes and extends labels by the links found."""

    def __init__(self, work: Scratch, texts: DataFrame, words: int, percent: int, parts: int):
        self.work, self.texts, self.words, self.percent, self.parts = work, texts, words, percent, parts

    def small(self, df: DataFrame, name: str) -> DataFrame:
        """A table of rows of a few numbers: a file for every ROWS_A_FILE rows of the cells."""
        return self.work.stored(df.coalesce(self.parts), name)

    def _needed(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Columns of the classes that a stored table of pairs names, and of a few others that pass the filter."""
        ids = self.small(pairs.select("x").union(pairs.select("y")).distinct(), "ids")
        return self.texts.select("class", *columns).filter(bloom.passes(bloom.built(ids), F.col("class")))

    def near(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs whose histograms are near enough."""
        pairs = self.work.stored(pairs.distinct().coalesce(8 * self.parts), "pairs")
        t = self._needed(pairs, "n", "bins")
        side = lambda i: t.select(F.col("class").alias(i), F.col("n").alias(f"n_{i}"), F.col("bins").alias(f"bins_{i}"))
        binned = pairs.join(side("x"), "x").join(side("y"), "y")
        return binned.select("x", "y", "n_x", "n_y", "bins_x", "bins_y").mapInArrow(_near(self.percent), "x long, y long, most double")

    def measured(self, near: DataFrame) -> DataFrame:
        """(x, y, d, linked) of stored pairs, by their whole texts."""
        t = self._needed(near, "text")
        side = lambda i: t.select(F.col("class").alias(i), F.col("text").alias(f"text_{i}"))
        both = near.join(side("x"), "x").join(side("y"), "y")
        found = both.select("x", "y", "text_x", "text_y").mapInArrow(_measured(self.words), "x long, y long, common long, united long")
        return self.work.stored(found.select("x", "y", (1 - F.col("common") / F.col("united")).alias("d"), (100 * F.col("common") >= self.percent * F.col("united")).alias("linked")), "measured")

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends have different labels."""
        for end in ("x", "y"):
            pairs = pairs.join(labels.select(F.col("x").alias(end), F.col("label").alias(f"l{end}")), end, "left")
        return pairs.filter(F.coalesce("lx", "x") != F.coalesce("ly", "y")).select("x", "y")

    def against(self, alive: DataFrame, pivots: DataFrame, probes: int | None) -> DataFrame:
        """The distinct pairs of pivots and documents of their cells that may link. Cells are cut into parts, and each part has all pivots of its cell."""
        parts = F.ceil(F.col("size") / PART)
        columns = ["s", "part", "pivot", "x", "n", "at", "label"]
        rows = alive.withColumns({"part": F.pmod(F.xxhash64("x"), parts), "pivot": F.lit(False)}).select(columns)
        rows = rows.union(pivots.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)), "pivot": F.lit(True)}).select(columns))
        t = self._needed(alive.select("x", F.col("x").alias("y")), "bins")
        rows = rows.join(t.withColumnRenamed("class", "x"), "x").select(*columns, "bins")
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "s", "part").sortWithinPartitions("s", "part", F.desc("pivot"), "x")
        return rows.mapInArrow(_against(self.percent, probes), "x long, y long").distinct()

    def extended(self, labels: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Labels (x, label) after the links among these near pairs, and the measured pairs. Only links between labels go into the contraction."""
        tested = self.measured(self.work.stored(pairs.select("x", "y").coalesce(8 * self.parts), "near"))
        links = tested.filter("linked").select(F.col("x").alias("u"), F.col("y").alias("v"))
        if labels is None:
            return self.small(components(links, self.work).select(F.col("node").alias("x"), F.col("component").alias("label")), "labels"), tested
        for end in ("u", "v"):
            at = labels.select(F.col("x").alias(end), F.col("label").alias(f"l{end}"))
            links = links.join(at, end, "left").withColumn(end, F.coalesce(f"l{end}", end)).drop(f"l{end}")
        moved = self.small(components(links, self.work), "moved")
        new = labels.join(moved.select(F.col("node").alias("label"), "component"), "label", "left").select("x", F.coalesce("component", "label").alias("label"))
        fresh = moved.join(labels.select(F.col("x").alias("node")), "node", "left_anti").select(F.col("node").alias("x"), F.col("component").alias("label"))
        return self.small(new.union(fresh), "labels"), tested


def _first_pivots(large: DataFrame, work: Scratch) -> DataFrame:
    """(s, pivots): the documents of each larger cell that are lowest by some hashes."""
    drawn = [F.min(F.struct(F.xxhash64("x", F.lit(-i)).alias("h"), "x", "n", "at")).alias(f"p{i}") for i in range(FIRST_PIVOTS)]
    one = [F.struct(f"p{i}.x", f"p{i}.n", f"p{i}.at") for i in range(FIRST_PIVOTS)]
    return work.stored(large.groupBy("s").agg(*drawn).select("s", F.array_distinct(F.array(*one)).alias("pivots")), "first")


def _large_cells(large: DataFrame, first: DataFrame, labels: DataFrame, tested: DataFrame, join: _Join) -> DataFrame:
    """The labels after joining the larger cells, in rounds of document pivots."""
    chosen = first.select("s", F.explode("pivots").alias("p")).select("s", F.col("p.x").alias("x"))
    ends = tested.select("x", "y", "d").union(tested.select("y", "x", "d")).join(chosen.select(F.col("x").alias("y")).distinct(), "y", "left_semi")
    distances = join.small(ends.groupBy("x").agg(F.map_from_entries(F.collect_list(F.struct("y", "d"))).alias("to")), "distances")
    alive, number = large, 0
    while True:
        alive = alive.join(chosen, ["s", "x"], "left_anti").join(labels, "x", "left").select("s", "x", "n", "at", F.coalesce("label", "x").alias("label"))
        alive = join.small(alive, "alive")
        open_ = alive.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", F.xxhash64("x", F.lit(number // 2))).alias("main"), F.count("*").alias("size"))
        open_ = join.small(open_.filter("lo <> hi").select("s", "main", "size"), "open")
        if open_.isEmpty():
            return labels
        alive = join.small(alive.join(open_, "s"), "alive")
        drawn = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("x", F.lit(number // 2)), "x"))
        pivots = alive.filter("label <> main").withColumn("rank", drawn).filter(F.col("rank") <= PIVOTS).drop("rank")
        pivots = join.small(pivots, "pivots")
        # a probe measures each pivot's best candidates, which joins most to their class; pivots leave once all of theirs are measured
        probe = number % 2 == 0
        labels, _ = join.extended(labels, _in_window(join.against(alive, pivots, PROBES if probe else None), distances))
        chosen, alive = pivots.filter(F.lit(not probe)).select("s", "x"), alive.select("s", "x", "n", "at")
        number += 1


def _in_window(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """The pairs that no first pivot rules out: |d(x,p) - d(y,p)| <= RADIUS for each p that both were measured against."""
    one, two = distances.select("x", F.col("to").alias("dx")), distances.select(F.col("x").alias("y"), F.col("to").alias("dy"))
    apart = F.exists(F.map_keys("dx"), lambda p: F.abs(F.element_at("dx", p) - F.try_element_at("dy", p)) > RADIUS + 1e-9)
    return pairs.join(one, "x", "left").join(two, "y", "left").filter(~F.coalesce(apart, F.lit(False))).select("x", "y")
