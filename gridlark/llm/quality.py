"""Quality rules as a short-circuit cascade.

A rule rejects a document by one measure of its text.  Measures fall into groups
that one pass over the words, the lines or the symbols yields; their cost differs
by an order of magnitude.  Each task estimates the cost and the rejection rate of
each rule on its first SAMPLE_ROWS documents, which all rules measure; it then puts the
rules in order of rejections per second, and measures each further document only until
a rule rejects it.  So nothing is read twice and no sample travels.  The order changes
how long the job takes, never a verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlark.llm.text import SPACE_WORD, string_chunks, window_hashes, with_text, word_hashes, word_spans

#: Documents of each task on which costs and rejections are estimated.
SAMPLE_ROWS = 256
#: Share of a chunk's texts still to be judged from which on those are copied together.
SHRINK = 0.75

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LEADS = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_NEWLINE = np.arange(256) == 0x0A
_LETTER = (np.arange(256) >= 0x80) | (((np.arange(256) | 0x20) >= 0x61) & ((np.arange(256) | 0x20) <= 0x7A))


class Texts:
    """Some texts of a chunk, and what has been measured of them so far."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.measures: dict[str, np.ndarray] = {}
        self._words = self._hashes = None

    def words(self):
        if self._words is None:
            self._words = word_spans(self.data, self.offsets, SPACE_WORD)
        return self._words

    def hashes(self):
        if self._hashes is None:
            starts, ends, _ = self.words()
            self._hashes = word_hashes(self.data, starts, ends)
        return self._hashes

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a number for each byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def some(self, which: np.ndarray) -> Texts:
        """Those that a mask picks."""
        if which.all():
            return self
        lengths = np.diff(self.offsets)[which]
        parts = [self.data[a:b] for a, b in zip(self.offsets[:-1][which], self.offsets[1:][which])]
        out = Texts(np.concatenate(parts) if parts else self.data[:0], np.r_[0, np.cumsum(lengths)])
        out.measures = {k: v[which] for k, v in self.measures.items()}
        return out


def _measure_words(t: Texts) -> dict:
    starts, ends, first = t.words()
    leads = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_LEADS[t.data], out=leads[1:])
    chars = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(leads[ends] - leads[starts], out=chars[1:])
    return {"n_words": np.diff(first), "word_chars": chars[first[1:]] - chars[first[:-1]]}


def _measure_symbols(t: Texts) -> dict:
    return {"n_symbols": t.per_text(_SYMBOL[t.data])}


def _measure_lines(t: Texts) -> dict:
    """Lines with a word, and those of them equal to an earlier one."""
    starts, ends, _ = word_spans(t.data, t.offsets, ~_NEWLINE)
    words = t.words()[0]
    filled = np.searchsorted(words, ends, "left") > np.searchsorted(words, starts, "left")
    starts, ends = starts[filled], ends[filled]
    owner = np.searchsorted(t.offsets, starts, "right") - 1
    hashes = word_hashes(t.data, starts, ends)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return {"n_lines": np.bincount(owner, minlength=t.n), "n_dup_lines": np.bincount(o[again], minlength=t.n)}


def _measure_repeats(t: Texts) -> dict:
    """Words inside 3-word windows that the text holds twice or more."""
    starts, ends, first = t.words()
    owner = np.repeat(np.arange(t.n), np.diff(first))
    windows = window_hashes(t.hashes(), 3)
    of = owner[: len(windows)]
    inside = np.flatnonzero(of == owner[2:]) if len(windows) else np.zeros(0, np.int64)
    order = inside[np.lexsort((windows[inside], of[inside]))]
    h, o = windows[order], of[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    often = order[same[1:] | same[:-1]]
    hit = np.zeros(len(owner), bool)
    for k in range(3):
        hit[often + k] = True
    return {"n_repeat_words": np.bincount(owner[hit], minlength=t.n)}


def _measure_letters(t: Texts) -> dict:
    """Words with a letter (A to Z or beyond ASCII)."""
    starts, ends, first = t.words()
    letters = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_LETTER[t.data], out=letters[1:])
    lettered = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(letters[ends] > letters[starts], out=lettered[1:])
    return {"n_lettered": lettered[first[1:]] - lettered[first[:-1]]}


def _measure_variety(t: Texts) -> dict:
    """Distinct words."""
    starts, ends, first = t.words()
    owner = np.repeat(np.arange(t.n), np.diff(first))
    h = t.hashes()
    order = np.lexsort((h, owner))
    h, o = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return {"n_distinct": np.bincount(o[fresh], minlength=t.n)}


def _measure_characters(t: Texts) -> dict:
    """Code points, and how often the commonest one stands. The commonest byte stands at least as often: its count will do where it is no more than half."""
    n_chars = t.per_text(_LEADS[t.data])
    owner = np.repeat(np.arange(t.n), np.diff(t.offsets))
    top = np.bincount(owner * 256 + t.data, minlength=256 * t.n).reshape(-1, 256).max(axis=1, initial=0)
    for i in np.flatnonzero(2 * top > n_chars):
        points = np.frombuffer(t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        top[i] = np.unique(points, return_counts=True)[1].max(initial=0)
    return {"n_chars": n_chars, "n_top_char": top}


GROUPS: dict[str, tuple[Callable[[Texts], dict], tuple[str, ...]]] = {
    "words": (_measure_words, ("n_words", "word_chars")),
    "symbols": (_measure_symbols, ("n_symbols",)),
    "lines": (_measure_lines, ("n_lines", "n_dup_lines")),
    "repeats": (_measure_repeats, ("n_repeat_words",)),
    "letters": (_measure_letters, ("n_lettered",)),
    "variety": (_measure_variety, ("n_distinct",)),
    "characters": (_measure_characters, ("n_chars", "n_top_char")),
}
#: Groups whose measures are given for every document on request; the others are measured as far as the cascade needs them.
BASE = ("words", "symbols", "lines", "repeats")


@dataclass(frozen=True)
class Rule:
    """Rejects where `rejects` holds of the measures of the named groups."""

    name: str
    groups: tuple[str, ...]
    rejects: Callable[[dict], np.ndarray]


RULES = (
    Rule("few_words", ("words",), lambda m: m["n_words"] < 50),
    Rule("repeated_words", ("words", "repeats"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", ("words", "symbols"), lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    Rule("repeated_lines", ("lines",), lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("letterless_words", ("words", "letters"), lambda m: 100 * m["n_lettered"] < 40 * m["n_words"]),
    Rule("few_distinct_words", ("words", "variety"), lambda m: 100 * m["n_distinct"] < 5 * m["n_words"]),
    Rule("one_character", ("characters",), lambda m: 100 * m["n_top_char"] > 50 * m["n_chars"]),
    Rule("word_length", ("words",), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
)


def _need(t: Texts, groups: tuple[str, ...]) -> None:
    for g in groups:
        f, names = GROUPS[g]
        if names[0] not in t.measures:
            t.measures |= f(t)


def _judged_whole(t: Texts, rules: tuple[Rule, ...], found: dict[str, list[float]]) -> np.ndarray:
    """The first of the rules that rejects each text (-1: none), all rules measured from the start, and in `found` each rule's seconds and rejections."""
    by = np.full(t.n, -1)
    for k, rule in enumerate(rules):
        alone = Texts(t.data, t.offsets)
        began = time.perf_counter()
        _need(alone, rule.groups)
        rejected = rule.rejects(alone.measures)
        of = found.setdefault(rule.name, [0.0, 0.0])
        of[0] += time.perf_counter() - began
        of[1] += float(rejected.sum())
        by[(by < 0) & rejected] = k
        t.measures = {**alone.measures, **t.measures}
    return by


def in_order(rules: tuple[Rule, ...], found: dict[str, list[float]]) -> list[int]:
    """The numbers of the rules by rejections per second."""
    gain = [(found[r.name][1] + 0.5) / max(found[r.name][0], 1e-9) for r in rules]
    return sorted(range(len(rules)), key=lambda k: -gain[k])


def _judged_lazily(t: Texts, rules: tuple[Rule, ...], order: list[int]) -> np.ndarray:
    by, alive, left = np.full(t.n, -1), np.arange(t.n), t
    for k in order:
        _need(left, rules[k].groups)
        rejected = rules[k].rejects(left.measures) & (by[alive] < 0)
        by[alive[rejected]] = k
        going = by[alive] < 0
        if not going.any():
            break
        if going.mean() < SHRINK:  # texts are copied only where enough of them drop out
            alive, left = alive[going], left.some(going)
    return by


def _cascade(rules: tuple[Rule, ...], kept: int, text_at: int, measured: bool, sample_rows: int):
    everything = [n for g in BASE for n in GROUPS[g][1]]
    names = np.array([*(r.name for r in rules), None], object)

    def run(batches):
        seen, found, order = 0, {}, None
        for batch in batches:
            # the first documents come as a part of their own
            cut = min(sample_rows, batch.num_rows) if order is None else 0
            for part in filter(lambda b: b.num_rows, (batch.slice(0, cut), batch.slice(cut))):
                if order is None and seen >= sample_rows:
                    order = in_order(rules, found)
                for lo, hi, data, offsets in string_chunks(part.column(text_at)):
                    t = Texts(data, offsets)
                    if measured:
                        _need(t, BASE)
                    by = _judged_whole(t, rules, found) if order is None else _judged_lazily(t, rules, order)
                    columns = [part.column(i).slice(lo, hi - lo) for i in range(kept)]
                    columns += [pa.array(t.measures[n].astype(np.int64)) for n in everything] if measured else []
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(by < 0), pa.array(names[by], pa.string())], [f"c{i}" for i in range(len(columns))] + ["kept", "rejected_by"])
                seen += part.num_rows

    return run


def judged(docs: DataFrame, id_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES, measured: bool = False, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id_cols, kept and rejected_by (the first rule of the task's cascade that rejects; null if kept) of each row, and with `measured` the base measures.

    A null text is an empty one: it has no words and is rejected.  Repeated rows each
    get the same verdict.  An empty table gives no rows.  Other columns are ignored;
    id_cols named like an added column give way to it.
    """
    names = [n for g in BASE for n in GROUPS[g][1]] if measured else []
    base, kept, at, schema = with_text(docs, id_cols, text_col, (*names, "kept", "rejected_by"))
    schema = ", ".join(x for x in [schema, *(f"{n} long" for n in names), "kept boolean, rejected_by string"] if x)
    return base.mapInArrow(_cascade(rules, len(kept), at, measured, sample_rows), schema)
