"""Words of whole text columns, as numpy arrays over Arrow buffers.

A batch of texts is one byte buffer with offsets.  Words are maximal runs of
word bytes (a 256-entry table says which), found with array operations over
pieces of about ``PIECE`` bytes that are cut between words, so temporary
memory does not follow the length of a text.  A word is represented by a
64-bit polynomial hash of its bytes.
"""
from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 20

#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trimmed(run):
    """``run`` over Arrow batches, after which freed memory goes back to the system:
    Spark keeps Python workers, and what one task has freed should not weigh on the next."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)
    return whole


def word_bytes(separators: list[tuple[int, int]]) -> np.ndarray:
    """Table of word bytes: all but the given inclusive ranges."""
    table = np.ones(256, bool)
    for a, b in separators:
        table[a:b + 1] = False
    return table


#: Words between blanks and control white space.
BLANKS = word_bytes([(0x20, 0x20), (0x09, 0x0D)])
#: Runs of digits, lower-case letters and bytes beyond ASCII (texts are lower-cased first).
ALNUM = word_bytes([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 4096), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is-null) of an Arrow string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    null = np.asarray(column.is_null())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0], null


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
    """All words of a batch: (start, end, hash, words before each text).

    ``start`` and ``end`` are byte positions in ``raw``; text ``d`` owns the
    words ``first[d]:first[d + 1]``.
    """
    total = len(raw)
    inner = offsets[1:-1]
    starts, ends, hashes = [], [], []
    at = 0
    while at < total:
        to = min(total, at + PIECE)
        while to < total and table[LOWER[raw[to]]] and table[LOWER[raw[to - 1]]]:
            more = np.flatnonzero(~table[LOWER[raw[to:to + PIECE]]])
            to = to + int(more[0]) if len(more) else min(total, to + PIECE)
        piece = LOWER[raw[at:to]]
        is_word = np.zeros(len(piece) + 2, bool)
        is_word[1:-1] = table[piece]
        begin = is_word[1:-1] & ~is_word[:-2]
        stop = is_word[1:-1] & ~is_word[2:]
        cuts = inner[np.searchsorted(inner, at, "right"):np.searchsorted(inner, to, "left")] - at
        if len(cuts):
            both = cuts[is_word[cuts + 1] & is_word[cuts]]
            begin[both] = True
            stop[both - 1] = True
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if hashed and len(s):
            power = _powers(_BASE, len(piece))
            total_hash = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * power, out=total_hash[1:])
            h = (total_hash[e] - total_hash[s]) * _powers(_INVERSE, len(piece))[s]
            hashes.append(mix(h ^ (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return start, end, h, np.searchsorted(start, offsets, "left")


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (order matters); len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return out


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo:hi]] * _powers(_BASE, hi - lo), out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        h = (total[e] - total[s]) * _powers(_INVERSE, hi - lo)[s]
        out[i:j] = mix(h ^ (e - s).astype(np.uint64))
        i = j
    return out
