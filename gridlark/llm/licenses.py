"""License scans by a generalised suffix automaton over the words of templates.

The automaton holds every run of words of every template.  A text streams through
it; at each word the state and the length say the longest run ending there that
some template holds: the matching statistics.  A run that the next word does not
extend is maximal; long maximal runs (MIN_RUN words or more, LONG_RUN in templates of
LONG words or more) are placed in the templates they occur in, chained in template
order within a text, and a template is found when the chain covers enough of it and
lies in no larger one that is found.  Base phrases are templates too; each place
where one ends is read off the state and its suffix links.

Words outside the templates, and pairs of words that no template has, are ruled out
for a whole batch at once; only what is left walks the automaton.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.license_texts import TEMPLATES, whole_texts
from gridlark.llm.text import ALNUM_WORD, LOWER, string_chunks, window_hashes, with_text, word_hashes, word_spans

#: Phrases and the labels they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of the shortest maximal run that is chained, of that in long templates, from how many words on a template is long, and the share of a template that a chain must cover.
MIN_RUN, LONG_RUN, LONG, COVERED = 3, 6, 60, 0.75


def words_of(text: str) -> list[bytes]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM_WORD)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


def _hash(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return word_hashes(data, np.r_[0, ends[:-1] + 1], ends)


@dataclass
class Automaton:
    """States of a suffix automaton over word numbers, and where runs end in the templates.

    The states below one in the tree of suffix links hold its runs as suffixes.  The tree is walked
    once: the ends (template, place after the run's last word) of all runs of a state are a slice.
    """

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    own: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    ends: list[tuple[int, int]] = field(default_factory=list)
    slices: list[tuple[int, int]] = field(default_factory=list)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.own.append([])
        return len(self.step) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of q whose longest run is one word more than p's."""
        new = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            q = self.step[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for place, c in enumerate(words, 1):
            last = self._extend(last, c)
            self.own[last].append((template, place))

    def spread(self) -> None:
        """Lays out the ends in the order of the tree."""
        below: list[list[int]] = [[] for _ in self.step]
        for s in range(1, len(self.step)):
            below[self.link[s]].append(s)
        self.ends, self.slices = [], [(0, 0)] * len(self.step)
        todo = [(0, -1)]
        while todo:
            s, began = todo.pop()
            if began >= 0:
                self.slices[s] = (began, len(self.ends))
                continue
            todo.append((s, len(self.ends)))
            self.ends += self.own[s]
            todo += [(c, -1) for c in below[s]]
        self.own = []

    def ends_of(self, s: int) -> list[tuple[int, int]]:
        return self.ends[slice(*self.slices[s])]

    def find(self, words: list[int]) -> int:
        s = 0
        for c in words:
            s = self.step[s].get(c, -1)
            if s < 0:
                return -1
        return s


@dataclass
class Scanner:
    """What a task needs: the automaton, the words' numbers by hash, pairs of words that occur, and where phrases end."""

    templates: tuple[tuple[str, str], ...]
    phrases: dict[str, str]

    def __post_init__(self):
        texts = [words_of(t) for _, t in self.templates] + [words_of(p) for p in self.phrases]
        self.vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = _hash(self.vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        numbered = [[number[w] for w in t] for t in texts]
        self.sizes = [len(t) for t in texts]
        self.least = min([MIN_RUN, *(n for n in self.sizes[: len(self.templates)] if n)])
        self.automaton = a = Automaton()
        for k, t in enumerate(numbered):
            a.add(k, t)
        a.spread()
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *(window_hashes(_hash(t), 2) for t in texts if len(t) > 1)]))
        single = [t[0] for t in texts if len(t) == 1]
        self.singles = np.unique(_hash(single)) if single else np.zeros(0, np.uint64)
        at = {a.find(t): (k, len(t)) for k, t in enumerate(numbered[len(self.templates) :])}
        self.phrase_ends: list[list[tuple[int, int]]] = []
        for s in range(len(a.step)):
            own, q = [], s
            while q > 0:
                if q in at:
                    own.append(at[q])
                q = a.link[q]
            self.phrase_ends.append(own)

    def scan(self, words: list[int], start: int):
        """Of a stretch of template words: phrase places (start, phrase), and maximal runs (start, words, state)."""
        a, s, n = self.automaton, 0, 0
        places, runs = [], []
        for i, c in enumerate(words):
            if c not in a.step[s]:
                if n >= self.least:
                    runs.append((start + i - n, n, s))
                while s and c not in a.step[s]:
                    s = a.link[s]
                    n = a.length[s]
            s = a.step[s].get(c, 0)
            n = n + 1 if s else 0
            for phrase, k in self.phrase_ends[s]:
                if k <= n:
                    places.append((start + i - k + 1, phrase))
        if n >= self.least:
            runs.append((start + len(words) - n, n, s))
        return places, runs

    def chained(self, runs) -> dict[int, tuple[int, int, int]]:
        """For each template: words covered by its best chain of runs in order, and the chain's first and last word in the text."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, s in runs:
            for template, place in self.automaton.ends_of(s):
                if template < len(self.templates) and n >= min(self.sizes[template], LONG_RUN if self.sizes[template] >= LONG else MIN_RUN):
                    by.setdefault(template, []).append((start, place - n, n))
        out = {}
        for template, found in by.items():
            chains: list[tuple[int, int, int, int]] = []  # covered, end in the template, first word, last word
            window = 3 * self.sizes[template]
            for start, at, n in sorted(found):
                chains = [c for c in chains if start - c[3] <= window]
                best = (n, at + n, start, start + n - 1)
                for covered, end, first, last in chains:
                    fresh = n - max(0, end - at)
                    if at + n > end and start > last - max(0, end - at) and fresh > 0 and covered + fresh > best[0]:
                        best = (covered + fresh, at + n, first, start + n - 1)
                chains.append(best)
                if template not in out or best[0] > out[template][0]:
                    out[template] = (best[0], best[2], best[3])
        # a found template within a larger found one is part of it
        found = {t for t, (covered, _, _) in out.items() if covered >= COVERED * self.sizes[t]}
        inner = {t for t in found for u in found if out[u][0] > out[t][0] and out[u][1] <= out[t][1] and out[t][2] <= out[u][2]}
        return {t: x for t, x in out.items() if t not in inner}


def _among(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _scan(scanner, kept: int, text_at: int):
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))

    def run(batches):
        sc: Scanner = scanner.value
        phrase_labels = list(sc.phrases.values())
        for batch in batches:
            for lo, hi, data, offsets in string_chunks(batch.column(text_at)):
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets, ALNUM_WORD)
                hashes = word_hashes(data, starts, ends)
                pair = window_hashes(hashes, 2)
                near = _among(sc.pairs, pair)
                inside = np.ones(len(near), bool)
                cut = first[1:-1]
                inside[cut[(cut > 0) & (cut <= len(near))] - 1] = False  # pairs across two texts
                near &= inside
                edge = np.diff(np.r_[0, near.astype(np.int8), 0])
                begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # words begins..stops-1
                if len(sc.singles):
                    alone = _among(sc.singles, hashes)
                    alone &= ~(np.r_[near, False] | np.r_[False, near])[: len(alone)]
                    begins, stops = np.r_[begins, np.flatnonzero(alone)], np.r_[stops, np.flatnonzero(alone) + 1]
                owner = np.searchsorted(first, begins, side="right") - 1
                found: dict[int, tuple[list, list]] = {}
                for d, b, e in zip(owner.tolist(), begins.tolist(), stops.tolist()):
                    numbers = sc.numbers[np.searchsorted(sc.hashes, hashes[b:e])].tolist()
                    places, runs = sc.scan(numbers, b - int(first[d]))
                    if places or runs:
                        have = found.setdefault(d, ([], []))
                        have[0].extend(places)
                        have[1].extend(runs)
                n = hi - lo
                out = {"n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [[]] * n, "spans": [[]] * n}
                for d, (places, runs) in found.items():
                    if places:
                        out["n_base"][d] = len(places)
                        out["first_word"][d], out["last_word"][d] = min(places)[0], max(places)[0]
                        out["base_labels"][d] = sorted({phrase_labels[p] for _, p in places})
                    out["spans"][d] = [
                        {"label": sc.templates[t][0], "first": f, "last": l, "covered": covered / sc.sizes[t]} for t, (covered, f, l) in sorted(sc.chained(runs).items())
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, n) for i in range(kept)),
                        pa.array(np.diff(first).astype(np.int64)),
                        *(pa.array(out[k], pa.int64()) for k in ("n_base", "first_word", "last_word")),
                        pa.array(out["base_labels"], pa.list_(pa.string())),
                        pa.array(out["spans"], span),
                    ],
                    [*(f"c{i}" for i in range(kept)), "n_words", *out],
                )

    return run


def scanned(docs: DataFrame, id_cols: list[str], text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] | None = None) -> DataFrame:
    """id_cols, n_words, n_base, first_word, last_word, base_labels and spans (label, first and last word, share covered) of each row.

    spans has each template's best chain, whatever it covers; COVERED is the share
    from which a template counts as found.  A null or empty text has no words and no
    spans.  Repeated rows each give a row; an empty table gives none.  Other columns
    are ignored; id_cols named like an added column give way to it.  The templates are a parameter of the job, not data: the automaton
    does not grow with docs.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(tuple(templates), phrases or PHRASES))
    base, kept, at, schema = with_text(docs, id_cols, text_col, ("n_words", "n_base", "first_word", "last_word", "base_labels", "spans"))
    schema = ", ".join(x for x in [schema, "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label:string,first:long,last:long,covered:double>>"] if x)
    return base.mapInArrow(_scan(scanner, len(kept), at), schema)


def labels():
    """Base labels and those of the templates found."""
    found = F.transform(F.filter("spans", lambda s: s["covered"] >= COVERED), lambda s: s["label"])
    return F.array_sort(F.array_distinct(F.concat("base_labels", found)))


def score():
    """The largest share of a template that is covered; 1 with a base phrase."""
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(best, F.lit(1.0)))
