"""Bloom filters of bounded size: which rows may be needed, before any are shuffled.

A filter lets all its keys pass and few others.  It narrows a table within its scan;
an exact join or test of what passes follows.  Its size grows with the keys up to
MAX_WORDS; beyond, more rows pass, and the exact step has more to do.  So one plan
serves every size, and what is broadcast stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bits of each key within one word of 64 bits, keys for each word, and words of a filter, at most (64 MB).
BITS, KEYS_A_WORD, MAX_WORDS = 4, 4, 1 << 23


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit keys over all bits (splitmix)."""
    h = h.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> U64(shift)
        h *= U64(factor)
    return h ^ (h >> U64(31))


def _places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key and its bits there."""
    h = mixed(keys.view(U64) if keys.dtype == np.int64 else keys)
    bits = np.zeros(len(h), U64)
    for i in range(BITS):
        bits |= U64(1) << ((h >> U64(6 * i)) & U64(63))
    return (h >> U64(32)).astype(np.int64) % words, bits


def built(keys: DataFrame, max_words: int = MAX_WORDS) -> Broadcast:
    """The filter of a stored table of one column of longs. Words are put together by the executors; the driver takes at most max_words of them."""
    n = keys.count()
    words = min(max_words, 1 << max(6, int(n / KEYS_A_WORD).bit_length()))

    def run(batches):
        for batch in batches:
            word, bits = _places(batch.column(0).to_numpy(zero_copy_only=False), words)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(words, U64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return keys.sparkSession.sparkContext.broadcast(table)


def may_hold(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bits = _places(keys, len(table))
    return (table[word] & bits) == bits


def passes(shared: Broadcast, key: Column) -> Column:
    """Whether a long may be one of the filter's keys; only the key goes through Python."""

    @F.arrow_udf("boolean")
    def test(keys: pa.Array) -> pa.Array:
        return pa.array(may_hold(shared.value, keys.to_numpy(zero_copy_only=False)))

    return test(key)
