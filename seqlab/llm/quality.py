"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal (operator 8).

A text's tokens are its runs of letters and digits (bytes beyond ASCII count
as letters) and its runs of other non-blank bytes, of the whole text with A-Z
lower-cased.  Features are the hashes of single tokens and of token pairs, of
the shape of each token (its kind, length and whether it was in capitals) and
of shape pairs, in ``2 ** BITS`` places; a feature counts 1 + log(occurrences),
and each of the two families is scaled to length 1.  A score is the logistic
function of the sparse dot product with the weights.

Weights are learned with follow-the-regularised-leader updates, row by row, in
``SHARDS`` tasks whose states are averaged after every round and start the
next one.  Training sees about ``rows`` labels, chosen by hash from all
(a documented bound of the fit).

A null text counts as empty; an empty text has no features and is scored by
the bias alone.  Null labels are not learned from; without any labelled row
every score is 0.5.  Repeated rows are repeated evidence; columns that are not
kept are ignored.
"""
from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm import wordscan
from seqlab.llm.scratch import bounded_batches, with_text, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 18
SHARDS = 8
#: Bytes of text whose features are made together.
GROUP = 1 << 20

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), 0x20]] = True
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1


@dataclass
class Weights:
    weight: np.ndarray  # float64, 2 ** BITS and one for the bias


def features(raw: np.ndarray, offsets: np.ndarray):
    """Sparse rows of a batch: (row offsets, slots, values)."""
    rows = len(offsets) - 1
    kind = np.where(_BLANK[raw], 0, np.where(_ALNUM[raw], 1, 2)).astype(np.int8)
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    new[inner] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(raw)]
    keep = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    h = wordscan.span_hash(wordscan.LOWER[raw], start, end)
    upper = np.r_[0, np.cumsum(_UPPER[raw])]
    length = end - start
    caps = np.minimum(upper[end] - upper[start], 2)
    # punctuation is its own shape; of words only length and capitals count
    shape = np.where(kind[start] == 2, h >> np.uint64(1), wordscan.mix((np.minimum(length, 12) * 4 + caps).astype(np.uint64)))
    owner = np.searchsorted(offsets, start, "right") - 1
    follows = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pair = wordscan.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[follows]
    shapes = wordscan.mix(shape[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + shape[1:])[follows]
    who, slot, value = [], [], []
    for own, code in (([owner, owner[1:][follows]], [h, pair]), ([owner, owner[1:][follows]], [wordscan.mix(shape), shapes])):
        o = np.concatenate(own)
        s = (np.concatenate(code) >> np.uint64(64 - BITS)).astype(np.int64)
        key, times = np.unique(o * (1 << BITS) + s, return_counts=True)
        o, s = key >> BITS, key & ((1 << BITS) - 1)
        v = 1 + np.log(times)
        norm = np.sqrt(np.bincount(o, v * v, minlength=rows))
        who.append(o)
        slot.append(s)
        value.append(v / norm[o])
    who, slot, value = map(np.concatenate, (who, slot, value))
    order = np.argsort(who, kind="stable")
    return np.searchsorted(who[order], np.arange(rows + 1)), slot[order], value[order]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> None:
    """FTRL-proximal over (slots, values, label) rows; updates the state (z, n) in place."""
    for slot, value, label in rows:
        zi, ni = z[slot], n[slot]
        w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
        g = (_sigmoid(w @ value) - label) * value
        z[slot] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
        n[slot] = ni + g * g


def _slices(offsets: np.ndarray):
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
        yield at, to
        at = to


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "label", text: str = "text",
          rows: int = 20_000, rounds: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5) -> Weights:
    """Fit weights on the texts of about ``rows`` keys with a 0/1 label.

    The keys are chosen from the labels alone, so the texts of all other documents are never shuffled.
    """
    bounded_batches(documents.sparkSession)
    given = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    total = given.count()
    size = 1 << BITS
    if not total:
        return Weights(np.zeros(size + 1))
    chosen = given.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) < min(1.0, rows / total) * 1_000_000)
    if chosen.count() <= 4 * rows + 1000:  # else one key bears a great part of the labels
        chosen = F.broadcast(chosen)
    picked = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")

    def extract(batches):
        for batch in batches:
            raw, offsets, _ = wordscan.text_buffer(batch.column(1))
            for lo, hi in _slices(offsets):
                first, slot, value = features(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                     pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                    ["label", "shard", "slots", "vals"])

    shard = F.pmod(F.xxhash64("text", F.lit(13)), F.lit(SHARDS)).cast("int").alias("shard")
    made = written(picked.select("label", "text", shard).repartition(SHARDS).mapInArrow(
        wordscan.trimmed(extract), "label int, shard int, slots binary, vals binary"), "features")
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def learner(z: np.ndarray, n: np.ndarray, turn: int):
        def learn(table: pa.Table) -> pa.Table:
            zs, ns = z.copy(), n.copy()
            sample = list(zip(table["label"].to_pylist(), table["slots"].to_pylist(), table["vals"].to_pylist(), strict=True))
            sample.sort(key=lambda r: (zlib.crc32(r[1], turn), r[1], r[0]))
            ftrl(((np.r_[np.frombuffer(s, np.int32), size], np.r_[np.frombuffer(v, np.float32), 1.0].astype(float), y)
                  for y, s, v in sample), zs, ns, alpha, beta, l1, l2)
            return pa.table({"z": pa.array([zs.tobytes()], pa.binary()), "n": pa.array([ns.tobytes()], pa.binary()),
                             "k": pa.array([len(sample)], pa.int64())})
        return learn

    for turn in range(rounds):
        states = (made.groupBy("shard").applyInArrow(learner(z, n, turn), "z binary, n binary, k long")
                  .collect())  # SHARDS rows of fixed size
        k = sum(s["k"] for s in states)
        z = sum((np.frombuffer(s["z"]) * (s["k"] / k) for s in states), np.zeros(size + 1))
        n = sum((np.frombuffer(s["n"]) * (s["k"] / k) for s in states), np.zeros(size + 1))
    return Weights(np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)))


def score(documents: DataFrame, model: Weights, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``score``, the probability of label 1."""
    keep = [c for c in keep if c != "score"]
    rows, place = with_text(documents, keep, text)
    held = documents.sparkSession.sparkContext.broadcast(model.weight)  # 2 ** BITS + 1 numbers

    def run(batches):
        w = held.value
        for batch in batches:
            raw, offsets, _ = wordscan.text_buffer(batch.column(place))
            out = np.zeros(batch.num_rows)
            for lo, hi in _slices(offsets):
                first, slot, value = features(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                total = np.r_[0, np.cumsum(w[slot] * value)]
                out[lo:hi] = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(_sigmoid(out + w[-1]))],
                                             [*keep, "score"])

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return rows.mapInArrow(wordscan.trimmed(run), schema)
