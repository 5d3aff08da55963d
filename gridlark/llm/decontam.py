"""Benchmark decontamination: one Aho-Corasick automaton, one scan of each text.

The test items are normalised to lower-case words; each run of WINDOW of their
words (a shorter item whole) is a pattern.  A document is normalised the same way,
as its words with single spaces between and around them, and scanned once; a match
names the word it ends on, which the spans of the words lead back to the original
text.

The automaton holds the benchmark only, not the corpus.  A benchmark of more than
ITEM_CHARS characters is dealt by item: each part has its automaton and its scan, whose
hits the next scan takes over, so that memory stays bounded whatever the benchmark.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.stores import Scratch
from gridlark.llm.text import ALNUM_WORD, LOWER, string_chunks, with_text, word_spans

WINDOW = 13
#: Characters of test items in one automaton: their windows have about 13 times as many, of 60 bytes each at most in a worker.
ITEM_CHARS = 1_000_000
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

_NORMAL = bytes(LOWER[b] if ALNUM_WORD[LOWER[b]] else 0x20 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _patterns(items: list[tuple[int, bytes]], window: int) -> list[tuple[str, int, tuple[int, ...]]]:
    """(pattern, words, items) of every distinct window."""
    owners: dict[bytes, set[int]] = {}
    for item, text in items:
        words = normal_words(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            owners.setdefault(b" ".join(words[i : i + k]), set()).add(item)
    return [(f" {p.decode('latin-1')} ", p.count(b" ") + 1, tuple(sorted(own))) for p, own in sorted(owners.items())]


def _automaton(patterns):
    a = ahocorasick.Automaton()
    for pattern, words, own in patterns:
        a.add_word(pattern, (words, own))
    a.make_automaton()
    return a


def _spans(data: np.ndarray, firsts: list[int], stops: list[int]) -> list[dict]:
    """Code-point spans in the original text of runs of words."""
    starts, ends, _ = word_spans(LOWER[data], np.array([0, len(data)]), ALNUM_WORD)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(firsts, stops)]


def _scan(shared, kept: int, text_at: int, earlier: int | None, last: bool):
    """One scan: kept columns, then runs of hit words and items; the last one tells words, hits and spans instead of runs."""

    def run(batches):
        automaton = _automaton(shared.value)
        for batch in batches:
            for lo, hi, data, offsets in string_chunks(batch.column(text_at)):
                n_words, runs, items, spans = [], [], [], []
                raw = data.tobytes()
                before = batch.slice(lo, hi - lo)
                had = [before.column(earlier + i).to_pylist() for i in (0, 1)] if earlier is not None else [[[]] * (hi - lo)] * 2
                for a, b, old_runs, old_items in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *had):
                    words = normal_words(raw[a:b])
                    text = f" {b' '.join(words).decode('latin-1')} " if words else ""
                    found = list(automaton.iter(text)) if len(automaton) else []
                    n_words.append(len(words))
                    if not found and not old_items:
                        runs.append([])
                        items.append([])
                        spans.append([])
                        continue
                    ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
                    change = np.zeros(len(words) + 1, np.int64)
                    own: set[int] = set(old_items)
                    for r in old_runs:
                        change[r["first"]] += 1
                        change[r["last"] + 1] -= 1
                    for end, (k, who) in found:
                        to = int(np.searchsorted(ends, end))
                        change[to - k + 1] += 1
                        change[to + 1] -= 1
                        own.update(who)
                    edge = np.diff(np.r_[0, (np.cumsum(change[:-1]) > 0).astype(np.int8), 0])
                    firsts, stops = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                    runs.append([{"first": f, "last": s - 1} for f, s in zip(firsts, stops)])
                    items.append(sorted(own))
                    if last:
                        spans.append(_spans(data[a:b], firsts, stops))
                out = [*(before.column(i) for i in range(kept))]
                if last:
                    out += [pa.array(n_words, pa.int64()), pa.array([sum(r["last"] - r["first"] + 1 for r in rs) for rs in runs], pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                else:
                    out += [] if text_at < kept else [before.column(text_at)]
                    out += [pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, [f"o{i}" for i in range(len(out))])

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_cols: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, item_chars: int = ITEM_CHARS) -> DataFrame:
    """id_cols, n_words, n_hit, items (those with a window in the text, in order) and spans (hit runs of words, code points) of each row.

    Null and empty texts, and items, have no words and no windows.  Repeated rows each
    give a row.  An item without an id is left out.  An empty table gives no rows.
    Other columns are ignored; id_cols named like an added column give way to it.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null")
    parts = int(tests.agg(F.sum(F.length("t"))).first()[0] or 0) // item_chars + 1
    base, kept, at, schema = with_text(docs, id_cols, text_col, ("n_words", "n_hit", "items", "spans"))
    work = Scratch(spark, "benchmark") if parts > 1 else None
    carried = ", ".join(x for x in [schema, "text string" if at == len(kept) else "", "runs array<struct<first:long,last:long>>, items array<long>"] if x)
    for part in range(parts):
        some = tests.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else tests
        shared = spark.sparkContext.broadcast(_patterns([(r.i, r.t.encode()) for r in some.collect()], window))
        last = part == parts - 1
        out = ", ".join(x for x in [schema, "n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"] if x) if last else carried
        base = base.mapInArrow(_scan(shared, len(kept), at, None if part == 0 else len(base.columns) - 2, last), out)
        if not last:
            base = work.stored(base, f"part-{part}")
    return base


def contaminated():
    """The rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
