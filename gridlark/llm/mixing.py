"""Mixing sources to target weights by soft membership.

A document belongs to several domains at once: a logistic classifier of hashed words
and punctuation, fitted on a bounded sample of a labelled table, gives posteriors
over domains.  Nonnegative rates, one for each
document, are fitted by projected gradient steps to

    minimise  1/2 sum_k ((sum_d r_d t_d p_dk - T_k) / S)^2 + RIDGE/2 sum_d (t_d / S) (r_d - 1)^2,   0 <= r <= MOST

where t are tokens, p posteriors, S all tokens and T_k target tokens: expected
totals of the domains come near their targets with rates as even as that allows.  The
gradient of a rate needs the K residuals of the step only, so a step is one sum over
the documents, and the driver keeps K numbers for each step.  Momentum makes the
steps few.  Every document takes part in every step.

The ridge holds rates short of the targets, most of all in small domains.  So a last
step takes, instead of its residuals, the K multipliers with which its projected rates
meet the targets: Newton steps find them, each again one sum over the documents, of
K totals and K x K curvatures.  A target beyond MOST times what its domain has cannot be
met: it takes no part in the last step, so that it distorts nothing, and is reported.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.stores import stored
from gridlark.llm.text import ALNUM_WORD, LOWER, U64, string_chunks, with_text, word_hashes, word_spans

#: Labelled rows that the classifier is fitted on, at most, and the share of them held out to calibrate it.
MAX_LABELLED, HELD_OUT = 6_000, 0.2
#: Hashed features, the steps of the fit, its rate and the weight of its penalty.
BUCKETS, ROUNDS, RATE, PENALTY = 1 << 14, 120, 0.1, 2e-5
#: Temperatures tried: posteriors are softmax(scores / temperature).
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 8.0)
_MARKS = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F) & ~ALNUM_WORD
RIDGE, STEPS = 0.005, 50
#: The largest rate: further repeats of a text teach a model little.
MOST = 4.0
#: The share of its target from which a domain's miss is reported; the multipliers' penalty: a domain misses its target by that times its multiplier; the precision of the multipliers as a share of the targets, Newton steps at most, and the lengths of a step tried in one pass.
MET = 0.01
SLACK, CLOSE, NEWTON, LENGTHS = 1e-6, 1e-4, 60, (1.0, 0.5, 0.2, 0.05, 0.005)


@dataclass(frozen=True)
class Classifier:
    """Weights of hashed features by domain (BUCKETS x K), biases, and the temperature."""

    words: np.ndarray
    biases: np.ndarray
    temperature: float = 1.0

    def scores(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts by their features: each text's features share a weight of one by the root of their number."""
        n, k = len(bounds) - 1, self.words.shape[1]
        size = np.diff(bounds)
        owner = np.repeat(np.arange(n), size)
        weights = self.words[buckets]
        total = np.stack([np.bincount(owner, weights[:, j], minlength=n) for j in range(k)], axis=1)
        return total / np.sqrt(np.maximum(size, 1))[:, None] + self.biases

    def posteriors(self, scores: np.ndarray) -> np.ndarray:
        z = scores / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        return z / z.sum(axis=1, keepdims=True)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashed words and runs of punctuation of each text, the bounds of each text's part, and how many words it has."""
    data = LOWER[data]
    found, tokens = [], None
    for is_word in (ALNUM_WORD, _MARKS):
        starts, ends, first = word_spans(data, offsets, is_word)
        size = np.diff(first)
        tokens = size if tokens is None else tokens
        found.append(np.repeat(np.arange(len(size)), size) * BUCKETS + (word_hashes(data, starts, ends) % U64(BUCKETS)).astype(np.int64))
    distinct = np.unique(np.concatenate(found))
    return distinct % BUCKETS, np.searchsorted(distinct, np.arange(len(offsets)) * BUCKETS), tokens


def _fit(buckets: np.ndarray, bounds: np.ndarray, kinds: np.ndarray, k_domains: int) -> Classifier:
    """Multinomial logistic regression, all rows in each step, with adaptive step sizes."""
    n, size = len(kinds), np.diff(bounds)
    biases = np.log((np.bincount(kinds, minlength=k_domains) + 1) / (n + k_domains))
    words = np.zeros((BUCKETS, k_domains))
    if not n:
        return Classifier(words, biases)
    truth = np.eye(k_domains)[kinds]
    share = 1 / np.sqrt(np.maximum(size, 1))
    m, v = np.zeros_like(words), np.zeros_like(words)
    for step in range(1, ROUNDS + 1):
        model = Classifier(words, biases)
        off = (model.posteriors(model.scores(buckets, bounds)) - truth) * share[:, None] / n
        g = np.stack([np.bincount(buckets, np.repeat(off[:, j], size), minlength=BUCKETS) for j in range(k_domains)], axis=1) + PENALTY * words
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        words = words - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Classifier(words, biases)


def domain_of(domains: tuple[tuple[str, str], ...]) -> Column:
    """The number of the first domain whose condition (SQL) holds of a labelled row; null if none does."""
    out = F.lit(None).cast("int")
    for k, (_, condition) in reversed(list(enumerate(domains))):
        out = F.when(F.expr(condition), F.lit(k)).otherwise(out)
    return out


def classifier(docs: DataFrame, labels: DataFrame, domains: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fits on at most max_labelled labelled rows, those first by hash of the id, and calibrates the temperature on a held-out share.

    Rows without a domain or id are left out; without labelled rows all posteriors are even.
    Of an id with several labels the first domain counts, of one with several texts the
    least by hash.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("i"), domain_of(domains).alias("k")).filter("i is not null and k is not null")
    # at most max_labelled pairs of numbers reach the driver
    of = {r.i: r.k for r in rows.groupBy("i").agg(F.min("k").alias("k")).orderBy(F.xxhash64("i"), "i").limit(max_labelled).collect()}
    ids = np.array(sorted(of), np.int64)
    known = docs.sparkSession.sparkContext.broadcast((ids, np.array([of[i] for i in ids.tolist()], np.int32)))

    def features(batches):
        ids, kinds = known.value
        for batch in batches:
            column = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, column), len(ids) - 1)
            rows = np.flatnonzero((ids[at] == column) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
            part = batch.take(pa.array(rows))
            for lo, hi, data, offsets in string_chunks(part.column(1)):
                buckets, bounds, _ = _features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(buckets.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), part.column(2).slice(lo, hi - lo), pa.array(kinds[at[rows[lo:hi]]]), lists], ["i", "h", "k", "f"])

    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    # as many rows as there are labelled ones in the sample, of at most BUCKETS numbers each
    found = base.mapInArrow(features, "i long, h long, k int, f array<int>").groupBy("i").agg(F.min_by(F.struct("k", "f"), F.col("h")).alias("x")).select("i", "x.k", "x.f").toArrow().sort_by("i").combine_chunks()
    kinds = found["k"].to_numpy()
    size = np.array([len(x) for x in found["f"]], np.int64) if len(kinds) else np.zeros(0, np.int64)
    flat = found["f"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(kinds) else np.zeros(0, np.int64)
    held = np.zeros(len(kinds), bool)
    held[:: round(1 / HELD_OUT)] = len(kinds) > 10

    def part(which):
        return flat[np.repeat(which, size)], np.r_[0, np.cumsum(size[which])], kinds[which]

    model = _fit(*part(~held), len(domains))
    buckets, bounds, truth = part(held)
    scores = model.scores(buckets, bounds)
    losses = [-np.log(np.maximum(replace(model, temperature=t).posteriors(scores)[np.arange(len(truth)), truth], 1e-12)).sum() for t in TEMPERATURES]
    return replace(model, temperature=TEMPERATURES[int(np.argmin(losses))] if len(truth) else 1.0)


def _rates(p: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """The rates that follow the residuals of the steps so far, each projected to 0 to MOST, with momentum."""
    r = np.ones(len(p))
    y, t = r, 1.0
    for e in residuals:
        new = np.clip(y - (p @ e + RIDGE * (y - 1)) / (1 + RIDGE), 0.0, MOST)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - r)
        r, t = new, t_new
    return np.stack([r, y])


def _closings(p: np.ndarray, tokens: np.ndarray, residuals: np.ndarray, tried: np.ndarray) -> list[np.ndarray]:
    """For each multipliers tried as the last step's residuals: the rates' part of the height by tokens, the K totals, and the K x K curvatures."""
    y = _rates(p, residuals)[1]
    out = []
    for e in tried:
        free = y - (p @ e + RIDGE * (y - 1)) / (1 + RIDGE)
        r = np.clip(free, 0.0, MOST)
        out.append(np.r_[(tokens * (free * r - r * r / 2)).sum(), (r * tokens) @ p, (p.T @ (p * (tokens * (r == free))[:, None])).ravel()])
    return out


def fitted(memberships: DataFrame, n_domains: int, shares: list[float], budget: float | None = None, steps: int = STEPS) -> tuple[np.ndarray, list[float], list[float]]:
    """Residuals of each step, the last row the multipliers, the target totals and the totals reached, for memberships (tokens, p). budget: target tokens in all; None: as many as there are.

    Where no rates meet the targets, the totals reached come as near to them as rates can.
    """
    narrow, k = memberships.select("tokens", "p"), n_domains

    def summed(of):
        def run(batches):
            total = 0.0
            for batch in batches:
                tokens = batch.column(0).to_numpy(zero_copy_only=False)
                total = total + of(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k), tokens)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

        return np.array([r.s for r in narrow.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])

    everything = float(narrow.agg(F.sum("tokens")).first()[0] or 0)
    size = max(everything, 1.0)
    target = np.array(shares) / sum(shares) * (everything if budget is None else budget)
    residuals = np.zeros((0, k))
    if not everything:
        return residuals, target.tolist(), [0.0] * k
    for _ in range(steps):
        residuals = np.vstack([residuals, (summed(lambda p, tokens: (_rates(p, residuals)[1] * tokens) @ p) - target) / size])
        if len(residuals) > 1 and np.abs(residuals[-1] - residuals[-2]).max() < 1e-6:
            break

    # all rates are one in the first step, so its residuals tell what each domain has
    have = residuals[0] * size + target
    within = target <= MOST * have
    goal = np.where(within, target, have)

    def tried(e: np.ndarray):
        """Of the multipliers in the rows of e the best: it, its height, slope and curvature, and its totals."""
        found = summed(lambda p, tokens: np.concatenate(_closings(p, tokens, residuals, e))).reshape(len(e), -1) / size
        heights = (1 + RIDGE) * found[:, 0] + e @ goal / size + SLACK / 2 * (e * e).sum(axis=1)
        i = int(np.argmin(heights))
        totals = found[i, 1 : k + 1]
        slope = np.where(within, goal / size - totals + SLACK * e[i], 0.0)
        curve = np.where(np.outer(within, within), found[i, k + 1 :].reshape(k, k) / (1 + RIDGE), 0.0)
        return e[i], heights[i], slope, curve + np.diag(np.where(within, SLACK, 1.0)), totals * size

    best = tried(np.where(within, residuals[-1:], 0.0))
    for _ in range(NEWTON):
        e, height, slope, curve, totals = best
        if (np.abs(slope) * size <= CLOSE * np.maximum(target, CLOSE * size)).all():
            break
        found = tried(e - np.outer(LENGTHS, np.linalg.solve(curve, slope)))
        if not found[1] < height:
            break
        best = found
    return np.vstack([residuals, best[0]]), target.tolist(), best[4].tolist()


def memberships(docs: DataFrame, model: Classifier, text_col: str = "text", residuals: np.ndarray | None = None, columns: list[str] | None = None) -> DataFrame:
    """The given columns (None: all but the text), tokens (words), p (posteriors by domain), and with residuals each row's rate.

    A null or empty text has no tokens and the prior's posteriors; its rate moves no
    total.  Repeated rows have equal rates.  Columns named tokens, p or rate are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, residuals))
    rated = residuals is not None
    base, kept, at, schema = with_text(docs, [c for c in docs.columns if c != text_col] if columns is None else columns, text_col, ("tokens", "p", "rate"))
    schema = ", ".join(x for x in [schema, "tokens long, p array<double>", "rate double" if rated else ""] if x)
    return base.mapInArrow(_membership(shared, [*range(len(kept))], at, rated), schema)


def _membership(shared, kept: list[int], text_at: int, rated: bool):
    def run(batches):
        model, residuals = shared.value
        for batch in batches:
            for lo, hi, data, offsets in string_chunks(batch.column(text_at)):
                buckets, bounds, tokens = _features(data, offsets)
                p = model.posteriors(model.scores(buckets, bounds))
                out = [*(batch.column(i).slice(lo, hi - lo) for i in kept), pa.array(tokens.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))]
                if rated:
                    out.append(pa.array(_rates(p, residuals)[0]))
                yield pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))])

    return run


def mixed(docs: DataFrame, labels: DataFrame, domains: tuple[tuple[str, str], ...], shares: list[float], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """(id, tokens, p, rate) of each row of docs, and the fit: target and reached totals, the domains whose totals are off by more than MET of their targets (no rates can meet them), temperature.

    An empty table gives no rows.
    """
    model = classifier(docs, labels, domains, id_col, text_col)
    found = stored(memberships(docs.select(id_col, text_col), model, text_col), "memberships")
    residuals, target, reached = fitted(found, len(domains), shares)
    unmet = [name for (name, _), t, r in zip(domains, target, reached) if abs(r - t) > MET * t]
    shared = docs.sparkSession.sparkContext.broadcast(residuals)
    k = len(domains)

    def run(batches):
        for batch in batches:
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_rates(p, shared.value)[0])], [*batch.schema.names, "rate"])

    kind = docs.schema[id_col].dataType.simpleString()
    return found.mapInArrow(run, f"`{id_col}` {kind}, tokens long, p array<double>, rate double"), {"target": target, "reached": reached, "unmet": unmet, "temperature": model.temperature, "residuals": residuals, "model": model}


def copies(rate: Column, *keys: Column) -> Column:
    """How often a row of this rate is taken: the rate rounded up or down by a hash of the keys, so that it is right on average."""
    unit = F.pmod(F.xxhash64(*keys, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + unit).cast("int")
