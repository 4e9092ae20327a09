"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 5).

Words are runs of ``[0-9a-z]`` and bytes beyond ASCII after lower-casing A-Z.
A window is ``window`` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window.  A document word inside any occurrence of
a window is hit, and the item of that window occurs in the document.

The search: windows of one length form a class with its own tables.  A shift
table, indexed by the hash of a block of two words, says how far a cursor may
jump from a block; most blocks stand in no window and skip almost a whole
window.  Where the shift is zero, the bucket of that block (the windows' last
words) gives candidates; they must agree in their first words' hash and then
in all words, compared directly.  The cursors of a batch move together as
array operations: the batch's words are one sequence with a separator between
texts, divided into lanes.

Benchmark windows are broadcast in blocks of about ``BLOCK_CHARS`` characters
(some 200 MB of tables in a worker); a larger benchmark takes more blocks, through
which the documents pass one after the other in the same stage, without a shuffle.
The shift table has four slots or more for each block of two words, up to
2 ** ``SHIFT_BITS[1]`` bytes, so that it still skips where a block is full.

Null or empty texts have no words.  Items with a null id still mark words, but
have no id to report; repeated documents give repeated rows; repeated items
count once.  Only the kept columns are read.
"""
from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm import wordscan
from seqlab.llm.scratch import with_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of benchmark text (and 20 for each id) in one broadcast block.
BLOCK_CHARS = 4_000_000
#: Least and greatest logarithm of the size of a shift table.
SHIFT_BITS = (18, 24)
#: Cursors that move together over a batch.
LANES = 2048
#: Bytes of text that a task searches at a time.
GROUP = 2 << 20


class Windows:
    """Tables for the windows of one length."""

    def __init__(self, size: int, phrases: list[bytes]):
        raw = np.frombuffer(b"\n".join(phrases), np.uint8)
        _, _, h, _ = wordscan.words(raw, np.array([0, len(raw)]), wordscan.ALNUM)
        self.size, self.phrases = size, phrases
        self.hashes = h.reshape(len(phrases), size)
        self.block = min(2, size)
        most = size - self.block + 1
        self.bits = min(max(SHIFT_BITS[0], (4 * most * len(phrases)).bit_length()), SHIFT_BITS[1])
        self.shift = np.full(1 << self.bits, min(most, 255), np.uint8)
        for j in range(most):
            last = self._block(self.hashes[:, j + self.block - 2] if self.block > 1 else None, self.hashes[:, j + self.block - 1])
            np.minimum.at(self.shift, self._slot(last), np.uint8(min(most - 1 - j, 255)))
        self.order = np.argsort(last, kind="stable")
        self.last = last[self.order]

    @staticmethod
    def _block(one: np.ndarray | None, two: np.ndarray) -> np.ndarray:
        """Hash of a block of two words, or of one."""
        return two if one is None else wordscan.mix(one * np.uint64(0x9E3779B97F4A7C15) + two)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray, body: bytes, start: np.ndarray, end: np.ndarray):
        """(first word, window number) of every occurrence; h holds a 0 between texts."""
        n, m, b = len(h), self.size, self.block
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(1, -(-(n - m + 1) // LANES))
        at = np.arange(m - 1, n, step)
        stop = np.minimum(at + step, n)
        zero = []
        while len(at):
            block = self._block(h[at - 1] if b > 1 else None, h[at])
            jump = self.shift[self._slot(block)].astype(np.int64)
            zero.append((at[jump == 0], block[jump == 0]))
            at = at + np.maximum(jump, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        at = np.concatenate([z for z, _ in zero])
        block = np.concatenate([z for _, z in zero])
        lo, hi = np.searchsorted(self.last, block, "left"), np.searchsorted(self.last, block, "right")
        many = hi - lo
        first = np.repeat(at - m + 1, many)
        which = self.order[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        for j in range(m):  # the first words' hash, then the others
            ok = h[first + j] == self.hashes[which, j]
            first, which = first[ok], which[ok]
        ok = [body[start[i]:end[i + m - 1]].lower() == self.phrases[w] or
              all(body[start[i + j]:end[i + j]].lower() == p for j, p in enumerate(self.phrases[w].split(b" ")))
              for i, w in zip(first.tolist(), which.tolist(), strict=True)]
        return first[ok], which[ok]


def _pattern_block(rows, window: int):
    """Window classes and, for each class, the item ids of every window."""
    classes: dict[int, dict[bytes, tuple]] = {}
    for text, ids in rows:
        ids = tuple(sorted(ids))  # one tuple for all windows of the item
        raw, offsets, _ = wordscan.text_buffer(pa.array([text], pa.string()))
        start, end, _, _ = wordscan.words(raw, offsets, wordscan.ALNUM, hashed=False)
        body = raw.tobytes()
        words = [body[a:b].lower() for a, b in zip(start, end, strict=True)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            own, phrase = classes.setdefault(size, {}), b" ".join(words[i:i + size])
            own[phrase] = ids if own.get(phrase, ids) is ids else tuple(sorted({*own[phrase], *ids}))
    return [(size, list(found), list(found.values())) for size, found in sorted(classes.items())]


def _search(raw, offsets, tables, items):
    """Number of words, hit words (packed bits) and sorted item ids of every text."""
    start, end, h, first = wordscan.words(raw, offsets, wordscan.ALNUM)
    n = np.diff(first)
    texts = len(n)
    owner = np.repeat(np.arange(texts), n)
    spread = np.arange(len(h)) + owner  # one separator after each text
    sequence = np.zeros(len(h) + texts, np.uint64)
    sequence[spread] = h
    s, e = np.zeros(len(sequence), np.int64), np.zeros(len(sequence), np.int64)
    s[spread], e[spread] = start, end
    owners = np.zeros(len(sequence), np.int64)
    owners[spread] = owner
    cover = np.zeros(len(sequence) + 1, np.int64)
    found: dict[int, set] = {}
    body = raw.tobytes()
    for t, ids in zip(tables, items, strict=True):
        at, which = t.find(sequence, body, s, e)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + t.size, -1)
        for d, w in np.unique(np.stack([owners[at], which], 1), axis=0).tolist() if len(at) else ():
            found.setdefault(d, set()).update(ids[w])
    hit = (np.cumsum(cover)[:-1] > 0)[spread]
    return n, [np.packbits(hit[first[d]:first[d + 1]]).tobytes() for d in range(texts)], \
        [found.get(d, set()) for d in range(texts)]


def contaminated_words(documents: DataFrame, benchmark: DataFrame, keep: list[str], window: int = 10,
                       text: str = "text") -> DataFrame:
    """The kept columns with ``n_words``, ``n_hit`` (long) and ``items`` (sorted array<string>)."""
    out = ("n_words", "n_hit", "items")
    keep = [c for c in keep if c not in out]
    items = benchmark.where("text is not null").groupBy("text").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    chars = items.agg(F.sum(F.length("text") + 20 * F.size("ids")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    df, place = with_text(documents, keep, text)
    carried = df.columns
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    schema = f"{fields}, __hit binary, n_words long, n_hit long, items array<string>"
    df = df.select(*carried, F.lit(None).cast("binary").alias("__hit"), F.lit(0).cast("long").alias("n_words"),
                   F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()  # about BLOCK_CHARS characters
        held = documents.sparkSession.sparkContext.broadcast(_pattern_block([tuple(r) for r in rows], window))

        def run(batches, held=held):
            tables = [Windows(size, phrases) for size, phrases, _ in held.value]
            names = [ids for _, _, ids in held.value]
            k = len(carried)
            for batch in batches:
                raw, offsets, _ = wordscan.text_buffer(batch.column(place))
                at = 0
                while at < batch.num_rows:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
                    part = batch.slice(at, to - at)
                    n, hits, found = _search(raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], tables, names)
                    before = part.column(k).to_pylist()
                    hits = [h if b is None else (np.frombuffer(h, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()
                            for h, b in zip(hits, before, strict=True)]
                    names_now = [sorted({*old, *new}) for old, new in zip(part.column(k + 3).to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i) for i in range(k)), pa.array(hits, pa.binary()), pa.array(n.astype(np.int64)),
                         pa.array([int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in hits], pa.int64()),
                         pa.array(names_now, pa.list_(pa.string()))], [*carried, "__hit", "n_words", "n_hit", "items"])
                    at = to

        df = df.mapInArrow(wordscan.trimmed(run), schema)
    return df.select(*keep, "n_words", "n_hit", "items")
