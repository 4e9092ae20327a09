"""Target-distribution importance resampling over hashed word runs (operator 13).

Features of a text are all its runs of one to three words (``[0-9a-z]`` and
bytes beyond ASCII, A-Z lower-cased first) joined by one blank, repeats
counted; a feature's bucket is the crc32 of its bytes modulo ``BUCKETS``.

1. *Head.*  Each task keeps the frequent words of its texts, and the frequent
   pairs of words, in sketches of ``SLOTS`` slots, where a word stays while it
   has the majority of its slot; the counts of all tasks are added up by Spark.
   The ``HEAD`` most frequent words of up to 16 bytes with their CRC states, and
   the most frequent pairs of them with theirs (which give the pair's bucket and
   go on to its triples), are broadcast in direct-mapped tables of fixed size.
   A word is looked up by its bytes, so a hit is exact.  The head decides what
   is looked up, never what is counted.
2. *Tail.*  Other words take the direct CRC of their bytes, many words at a
   time.  Other runs take theirs from the words' states: crc(a b) is crc(a)
   moved on by the length of b, which is linear and so a few table lookups,
   xor crc(b).
3. *Totals* of all buckets over all documents, and over the target's texts:
   one row of counts for each task and bucket, added up by Spark.  A bucket's
   gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))).
4. *Weights.*  A document's weight is the sum of its features' gains; its score
   adds Gumbel noise of the hash of its id, so the highest scores are a draw
   without replacement in proportion to exp(weight / 1000).
5. *Ranks* of the drawn come from counts by score: in ranges of 4,096, within a
   range, and within a score, so no task orders more than rows of one score,
   and rows of one id are numbered by the partition they were written from.

Defined results: a null text has no words, no features and weight 0; empty texts
and texts without a word alike.  A document without id has no score and is
neither drawn nor counted among those drawn from.  Rows with one id each count;
ranks among equal scores go by id, and rows of one id with equal scores are
interchangeable.  An empty target or an empty table gives totals of 0.  Texts
are read in pieces of about ``PIECE`` bytes, cut between words.  Columns other than id
and text are ignored.
"""
from __future__ import annotations

import hashlib
import math
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.llm import wordscan
from seqlab.llm.scratch import bounded_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
#: Words and pairs of the broadcast head, slots of a table of them, and what a task reports of each.
HEAD, SLOTS, REPORTED = 1 << 15, 1 << 17, 1 << 13
#: Bytes of a piece of text, and of the longest word whose CRC is taken beside others'.
PIECE, LONG = 1 << 20, 64
#: Ranks: scores are counted in ranges of 2 ** COARSE.
COARSE = 12

def _byte_moves() -> np.ndarray:
    """What a CRC becomes when a zero byte follows, for each byte value at each of its four places."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> np.uint32(1)) ^ np.uint32(0xEDB88320), low >> np.uint32(1))
    places = [np.arange(256, dtype=np.uint32) << np.uint32(8 * p) for p in (1, 2, 3)]
    return np.stack([low, *(p >> np.uint32(8) for p in places)])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for p in (1, 2, 3):
        out = out ^ table[p][(crc >> np.uint32(8 * p)) & np.uint32(255)]
    return out


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Tables for 0 to 63 following bytes, and for 64, 128, 256, ... of them."""
    one = _byte_moves()
    small = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * p) for p in range(4)])]
    while len(small) < 65:
        small.append(_apply(one, small[-1]))
    large = [small.pop()]
    while len(large) < 26:
        large.append(_apply(large[-1], large[-1]))
    return np.stack(small), np.stack(large)


_SMALL, _LARGE = _moves()
_TABLE = _byte_moves()[0]
_BLANK = zlib.crc32(b" ")
#: Which bytes of eight belong to a word of that length.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def moved_on(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs (of anything) followed by n bytes, before the xor with the CRC of those bytes."""
    flat, at = _SMALL.reshape(-1), (n & 63) << 10
    out = flat[at + (crc & np.uint32(255))]
    for p in (1, 2, 3):
        out ^= flat[at + (p << 8) + ((crc >> np.uint32(8 * p)) & np.uint32(255))]
    rest, k = n >> 6, 0
    while rest.any():
        some = np.flatnonzero(rest & 1)
        out[some] = _apply(_LARGE[k], out[some])
        rest, k = rest >> 1, k + 1
    return out


def _place(key: np.ndarray) -> np.ndarray:
    """A slot for each 64-bit key."""
    return (wordscan.mix(key) >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


def spelled(low: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 and the next 8 bytes of words, zeros after their end (no word holds a zero byte)."""
    padded = np.concatenate([low, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    return eight[start] & _MASK[np.minimum(n, 8)], eight[start + 8 * (n > 8)] & _MASK[np.clip(n - 8, 0, 8)]


def direct(low: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs of words, byte by byte over many of them."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.flatnonzero(n <= LONG)
    left = left[np.argsort(-n[left], kind="stable")]  # the longest first, so those still running are a prefix
    lengths = -n[left]
    k, c, at = 0, crc[left], start[left]
    while True:
        running = int(np.searchsorted(lengths, -k, "left"))  # words of more than k bytes
        if not running:
            break
        c[:running] = _TABLE[(c[:running] ^ low[at[:running] + k]) & np.uint32(255)] ^ (c[:running] >> np.uint32(8))
        k += 1
    crc[left] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(n > LONG):
        crc[i] = zlib.crc32(low[start[i]:start[i] + n[i]])
    return crc


def pieces(column):
    """(first text, whether it goes on, lower-case bytes, offsets) of ranges of texts.

    A range holds about ``PIECE`` bytes; a longer text is cut between words, into ranges
    of which all but the first go on with the text before them.
    """
    raw, offsets, _ = wordscan.text_buffer(column)
    d = 0
    while d < len(offsets) - 1:
        to = max(d + 1, int(np.searchsorted(offsets, offsets[d] + PIECE, "right")) - 1)
        at, end, goes_on = int(offsets[d]), int(offsets[to]), False
        while True:
            cut = end
            if to == d + 1 and end - at > PIECE:
                cut = at + PIECE
                while cut < end and wordscan.ALNUM[wordscan.LOWER[raw[cut]]]:
                    stop = np.flatnonzero(~wordscan.ALNUM[wordscan.LOWER[raw[cut:min(end, cut + PIECE)]]])
                    cut = cut + int(stop[0]) if len(stop) else min(end, cut + PIECE)
            inner = offsets[d:to + 1] - at if cut == end and not goes_on else np.array([0, cut - at])
            yield d, goes_on, wordscan.LOWER[raw[at:cut]], inner
            at, goes_on = cut, True
            if at >= end:
                break
        d = to


class Words:
    """Words of a range of texts, after up to two words of the text that it goes on.

    ``owner`` is the text of each word, ``new`` whether it is counted here, ``n`` its bytes, ``crc`` its CRC and
    ``slot`` its place in the head's table, or -1; ``key`` holds its spelling.
    """

    def __init__(self, first: int, low: np.ndarray, offsets: np.ndarray, known=None, held=None):
        start, end, _, count = wordscan.words(low, offsets, wordscan.ALNUM, hashed=False)
        n = end - start
        self.owner = first + np.repeat(np.arange(len(offsets) - 1), np.diff(count))
        self.key = spelled(low, start, n)
        slot = _place(self.key[0] ^ wordscan.mix(self.key[1]))
        if known is None:
            crc = np.zeros(len(n), np.uint32)
        else:
            lo, hi, states = known
            hit = (lo[slot] == self.key[0]) & (hi[slot] == self.key[1]) & (n <= 16)
            crc = states[slot]
            tail = np.flatnonzero(~hit)
            crc[tail] = direct(low, start[tail], n[tail])
            slot[tail] = -1
        self.n, self.crc, self.slot, self.new = n, crc, slot, np.ones(len(n), bool)
        if held is not None and len(held.n):
            self.owner = np.concatenate([np.full(len(held.n), first), self.owner])
            self.new = np.concatenate([np.zeros(len(held.n), bool), self.new])
            for part in ("n", "crc", "slot"):
                setattr(self, part, np.concatenate([getattr(held, part), getattr(self, part)]))
            self.key = tuple(np.concatenate(k) for k in zip(held.key, self.key))

    def last(self):
        """The last two words, for the range that goes on."""
        out = object.__new__(Words)
        for part in ("n", "crc", "slot"):
            setattr(out, part, getattr(self, part)[-2:])
        out.key = tuple(k[-2:] for k in self.key)
        return out


def texts_words(column, known=None):
    """The ``Words`` of all ranges of a text column."""
    words = None
    for first, goes_on, low, offsets in pieces(column):
        words = Words(first, low, offsets, known, words.last() if goes_on else None)
        yield words


def runs(words: Words, pairs=None):
    """(texts, CRCs) of all runs of one, two and three words that end in a new word."""
    owner, crc, n, new = words.owner, words.crc, words.n, words.new
    yield owner[new], crc[new]
    two = np.flatnonzero(owner[:-1] == owner[1:]) + 1
    if not len(two):
        return
    after = moved_on(np.full(len(n), _BLANK, np.uint32), n) ^ crc  # of a blank and the word
    pair = np.zeros(len(n), np.uint32)  # by last word
    tail = two
    if pairs is not None:
        keys, states = pairs
        first, second = words.slot[two - 1], words.slot[two]
        key = first * SLOTS + second
        place = _place(key.astype(np.uint64))
        hit = (keys[place] == key) & (first >= 0) & (second >= 0)
        pair[two[hit]] = states[place[hit]]
        tail = two[~hit]
    pair[tail] = moved_on(crc[tail - 1], n[tail] + 1) ^ after[tail]
    at = two[new[two]]
    yield owner[at], pair[at]
    three = np.flatnonzero((owner[:-2] == owner[2:]) & new[2:]) + 2
    yield owner[three], moved_on(pair[three - 1], n[three] + 1) ^ after[three]


class Frequent:
    """Frequent keys of several 64-bit columns: each slot keeps the key that has the majority of it."""

    def __init__(self, columns: int):
        self.key = np.zeros((columns, SLOTS), np.uint64)
        self.lead, self.seen = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)

    def _count(self, slot, key):
        match = np.ones(len(slot), bool)
        for own, k in zip(self.key, key, strict=True):
            match &= own[slot] == k
        return match, np.bincount(slot[match], minlength=SLOTS)

    def add(self, slot: np.ndarray, key: list[np.ndarray]) -> None:
        match, hits = self._count(slot, key)
        others = np.flatnonzero(~match)
        self.seen += hits
        self.lead += hits - np.bincount(slot[others], minlength=SLOTS)
        lost = self.lead < 0
        if lost.any():
            one = np.zeros(SLOTS, np.int64)
            one[slot[others]] = others
            for own, k in zip(self.key, key, strict=True):
                own[lost] = k[one[lost]]
            _, hits = self._count(slot, key)
            self.seen[lost] = self.lead[lost] = hits[lost]

    def top(self, most: int) -> np.ndarray:
        at = np.flatnonzero(self.seen)
        return at[np.argsort(-self.seen[at], kind="stable")[:most]]


def _bytes(lo, hi) -> bytes:
    return (int(lo) | int(hi) << 64).to_bytes(16, "little").rstrip(b"\0")


def _head_counter():
    """Texts -> a task's frequent words and pairs of up to 16 bytes a word, with their counts."""
    def run(batches):
        words, pairs = Frequent(2), Frequent(4)
        for batch in batches:
            for w in texts_words(batch.column(0)):
                at = np.flatnonzero(w.new & (w.n <= 16))
                words.add(w.slot[at], [k[at] for k in w.key])
                two = np.flatnonzero((w.owner[:-1] == w.owner[1:]) & w.new[1:] & (w.n[:-1] <= 16) & (w.n[1:] <= 16)) + 1
                place = _place((w.slot[two - 1] * SLOTS + w.slot[two]).astype(np.uint64))
                pairs.add(place, [*(k[two - 1] for k in w.key), *(k[two] for k in w.key)])
        often, both = words.top(REPORTED), pairs.top(REPORTED)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(_bytes(*words.key[:, i]) for i in often), *(_bytes(*pairs.key[:2, i]) for i in both)], pa.binary()),
             pa.array([*([None] * len(often)), *(_bytes(*pairs.key[2:, i]) for i in both)], pa.binary()),
             pa.array(np.concatenate([words.seen[often], pairs.seen[both]]))], ["word", "then", "n"])
    return run


def head(texts: DataFrame):
    """Tables of the most frequent words (spelling, CRC state) and of the most frequent pairs of them (slots, CRC state)."""
    found = written(texts.mapInArrow(wordscan.trimmed(_head_counter()), "word binary, then binary, n long")
                    .groupBy("word", "then").agg(F.sum("n").alias("n")), "head")

    def top(rows):
        return rows.orderBy(F.desc("n"), "word", "then").limit(HEAD).collect()[::-1]  # at most HEAD short rows

    def slot_of(word):
        lo, hi = (np.array([int.from_bytes(word[i:i + 8], "little")], np.uint64) for i in (0, 8))
        return int(_place(lo ^ wordscan.mix(hi))[0]), lo[0], hi[0]

    lo, hi, states = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32)
    for r in top(found.where("then is null")):  # the rarest first: of words that share a slot the most frequent one stays
        word = bytes(r["word"])
        slot, *key = slot_of(word)
        lo[slot], hi[slot], states[slot] = *key, zlib.crc32(word)
    keys, pair_states = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.uint32)
    for r in top(found.where("then is not null")):
        one, two = bytes(r["word"]), bytes(r["then"])
        (a, *spelling_a), (b, *spelling_b) = slot_of(one), slot_of(two)
        if [lo[a], hi[a]] == spelling_a and [lo[b], hi[b]] == spelling_b:
            key = a * SLOTS + b
            place = int(_place(np.array([key], np.uint64))[0])
            keys[place], pair_states[place] = key, zlib.crc32(one + b" " + two)
    return (lo, hi, states), (keys, pair_states)


def bucket_totals(texts: DataFrame, known) -> np.ndarray:
    """How many features of all texts (one string column) fall into each bucket."""
    def run(batches):
        words, pairs = known.value
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for w in texts_words(batch.column(0), words):
                for _, crc in runs(w, pairs):
                    total += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(wordscan.trimmed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # a row for each bucket
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    whole, aim = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * aim)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(documents: DataFrame, target: DataFrame, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document, against the texts of ``target``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    known = spark.sparkContext.broadcast(head(documents.select(text)))
    gain = spark.sparkContext.broadcast(gains(bucket_totals(documents.select(text), known), bucket_totals(target.select(text), known)))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("spelled"), F.col(text).alias("text"))

    def run(batches):
        words, pairs = known.value
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for w in texts_words(batch.column(2), words):
                n += np.bincount(w.owner[w.new], minlength=len(n))
                for owner, crc in runs(w, pairs):
                    np.add.at(weight, owner, gain.value[crc % np.uint32(BUCKETS)])
            score = [None if i is None else w + noise(i, seed) for i, w in zip(batch.column(1).to_pylist(), weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)), pa.array(weight),
                 pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(wordscan.trimmed(run), f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """The scored rows with ``rank``: 1, 2, 3... for the highest floor(percent * N / 100) scores of the N rows
    with a score and enough words, ties to the smaller id; null for the others."""
    rows = written(scored.withColumn("part", F.spark_partition_id()).withColumn(
        "coarse", F.when((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.shiftright("score", COARSE))), "scores")
    columns = [*scored.columns]
    sizes = rows.where("coarse is not null").groupBy("coarse").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(F.desc("coarse")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of scores
    sizes = written(sizes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "ranges")
    drawn = percent * (sizes.agg(F.sum("n")).first()[0] or 0) // 100
    sizes = sizes.where(F.col("before") < drawn)
    lowest = sizes.agg(F.min("coarse")).first()[0]
    if lowest is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    top = rows.where(F.col("coarse") >= lowest)
    counts = top.groupBy("coarse", "score", "doc_id", "part").agg(F.count("*").alias("n"))
    by_score = Window.partitionBy("coarse").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    by_id = Window.partitionBy("score").orderBy("doc_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    above = (counts.groupBy("coarse", "score").agg(F.sum("n").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(by_score), F.lit(0)))
             .join(sizes.select("coarse", "before"), "coarse").select("score", (F.col("before") + F.col("above")).alias("above")))
    places = (counts.withColumn("first", F.coalesce(F.sum("n").over(by_id), F.lit(0))).join(above, "score")
              .select("score", "doc_id", "part", (F.col("first") + F.col("above")).alias("first")))
    number = F.row_number().over(Window.partitionBy("score", "doc_id", "part").orderBy("n_features"))
    placed = top.withColumn("number", number).join(places, ["score", "doc_id", "part"]).withColumn("rank", F.col("first") + F.col("number"))
    return placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        rows.where(F.coalesce(F.col("coarse") < lowest, F.lit(True))).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; a rank where it is drawn."""
    return ranked(scores(documents, target, seed, doc_id, text), percent, least_words)
