"""Words and word hashes of UTF-8 text, a whole Arrow batch at a time.

The text operators of this subpackage share these helpers.  A Spark task hands
over Arrow string columns; their byte buffers are read as numpy arrays, so no
Python object is made per word.  Separators are ASCII bytes only, and no byte of
a multi-byte UTF-8 character is ASCII, so byte runs are code-point runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text worked on at once: the numpy scratch arrays take about 60 times that.
CHUNK_BYTES = 1 << 19

_BYTES = np.arange(256)
#: `[^\x20\x09-\x0D]+`
SPACE_WORD = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
#: Lower-cases A-Z and nothing else.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def with_text(docs: DataFrame, id_cols: list[str], text_col: str, added: tuple[str, ...]) -> tuple[DataFrame, list[str], int, str]:
    """What a text operator sends to its tasks: id_cols (but for those named like added columns, which replace them) and the text; their names; where the text stands; and their schema.

    The text is sent once where it is one of the id_cols.
    """
    kept = [c for c in id_cols if c not in added]
    base = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), *([] if text_col in kept and dict(docs.dtypes)[text_col] == "string" else [F.col(f"`{text_col}`").cast("string").alias("text")]))
    at = len(kept) if len(base.columns) > len(kept) else kept.index(text_col)
    return base, kept, at, ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(kept, base.schema.fields))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (splitmix)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_SEED = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next chunk."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def string_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of an Arrow string column; a null is an empty text.

    A chunk has at most `limit` bytes, or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all texts of a chunk, and for each text (and the end) its first word's index."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    m = is_word[data]
    before = np.empty(len(m) + 1, bool)
    before[0] = False
    before[1:] = m
    edges = offsets[:-1][offsets[:-1] < len(m)]
    left = before[:-1].copy()
    left[edges] = False
    starts = np.flatnonzero(m & ~left)
    right = np.zeros(len(m), bool)
    right[:-1] = m[1:]
    right[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(m & ~right) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over random byte values, finalised with the length."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(_SEED[data] * _powers(_BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix64(h ^ ((ends - starts).astype(U64) * U64(0xA0761D6478BD642F)))


#: Multipliers that make a sequence's hash depend on the order of its words.
_PLACES = mix64(np.arange(1, 65, dtype=U64) * U64(0xE7037ED1A0B428DB)) | U64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive entries."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for i in range(k):
        h += words[i : i + n] * _PLACES[i]
    return mix64(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, as one array of hashes and the bounds of each text's part (sorted).

    Texts with fewer than k words, but one at least, have their whole sequence as the one shingle.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACE_WORD)
    words = word_hashes(data, starts, ends)
    n_words = np.diff(first)
    n = len(offsets) - 1
    every = window_hashes(words, k)
    doc_of_word = np.repeat(np.arange(n), n_words)
    if len(every):
        inside = doc_of_word[: len(every)] == doc_of_word[k - 1 :]
        hashes, owner = every[inside], doc_of_word[: len(every)][inside]
    else:
        hashes, owner = every, np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        one = np.array([mix64((words[first[d] : first[d + 1]] * _PLACES[: n_words[d]]).sum(keepdims=True) + U64(n_words[d]))[0] for d in short], U64)
        hashes, owner = np.concatenate([hashes, one]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(n + 1), side="left")
