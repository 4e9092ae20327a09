"""Importance resampling against a brute force by definition, and its parts against zlib."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import edge_documents, edge_texts, no_documents, words
from pyspark.sql import functions as F

from seqlab.llm import resample as R

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def crcs(text):
    w = split(text)
    return [zlib.crc32(b" ".join(w[i:i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, sorted."""
    source, aim = (Counter(c % 10000 for t in texts for c in crcs(t)) for texts in ([t for _, t in docs], target))
    s, t = sum(source.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[k] + 1) * (t and 1 or 1) * (s + 10000) / ((source[k] + 1) * (t + 10000)))) for k in range(10000)]
    rows = []
    for i, text in docs:
        found = crcs(text)
        weight = sum(gain[c % 10000] for c in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(split(text))])
    order = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for place, r in enumerate(order[:percent * len(order) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_for(seed=4):
    rnd = random.Random(seed)
    rows = edge_texts() + [(100 + i, words(rnd, rnd.randint(0, 80))) for i in range(120)]
    rows += [(300 + i, "copy " + "of one text " * 12) for i in range(60)] + [(None, words(rnd, 25)) for _ in range(20)]
    rows += [(400, "the same id and text " * 6)] * 30
    return rows


TARGET = ["the same id and text of a benchmark", "one text", None, "", "!!"]


@pytest.mark.parametrize("percent, least", [(5, 20), (60, 1), (100, 0), (0, 20)])
def test_equals_brute_force(spark, percent, least):
    rows = rows_for()
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = R.resample(edge_documents(spark, rows).withColumn("rank", F.lit("clash")), target, percent, least).drop("n_words").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, TARGET, percent, least)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(r.rank is not None for r in got)))


def test_empty_tables(spark):
    none = no_documents(spark).select("text")
    assert R.resample(no_documents(spark), none).collect() == []
    rows = rows_for()[:20]
    got = R.resample(edge_documents(spark, rows), none, 50, 1).drop("n_words").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, [], 50, 1)


def test_crc_moves_on_by_any_length():
    rnd = random.Random(1)
    states = np.array([0, zlib.crc32(b"abc"), 2**32 - 1], np.uint32)
    for n in (0, 1, 2, 63, 64, 65, 127, 128, 1000, 70_000):
        tail = bytes(rnd.randrange(256) for _ in range(n))
        got = R.moved_on(states, np.full(3, n)) ^ np.uint32(zlib.crc32(tail))
        assert got.tolist() == [zlib.crc32(tail, int(s)) for s in states]


def found(texts, known=None, pairs=None):
    known = known or tuple(np.zeros(R.SLOTS, k) for k in (np.uint64, np.uint64, np.uint32))
    out = [[] for _ in texts]
    for w in R.texts_words(pa.array(texts, pa.string()), known):
        for owner, crc in R.runs(w, pairs):
            for d, c in zip(owner.tolist(), crc.tolist()):
                out[d].append(c)
    return [sorted(x) for x in out]


@pytest.mark.parametrize("piece, long", [(1 << 20, 64), (40, 64), (1, 3), (300, 0), (64, 1)])
def test_runs_cross_pieces(monkeypatch, piece, long):
    monkeypatch.setattr(R, "PIECE", piece)
    monkeypatch.setattr(R, "LONG", long)
    rnd = random.Random(6)
    texts = [words(rnd, 150), None, "", "one", "One, two", "a b c", words(rnd, 3) + " " + "x" * 500, "日本語 é" * 30, "-- ", words(rnd, 40),
             "exactly16letters exactly8 exactly17letterss", "z" * 200]
    assert found(texts) == [sorted(crcs(t)) for t in texts]


def test_head_is_looked_up_and_changes_nothing(spark):
    rnd = random.Random(8)
    texts = [words(rnd, 50) + " often seen words often seen words" for _ in range(60)]
    (lo, hi, states), pairs = R.head(spark.createDataFrame([(t,) for t in texts], "text string"))
    spelled = {R._bytes(a, b): int(s) for a, b, s in zip(lo, hi, states) if a}
    assert {b"often", b"seen", b"words"} <= set(spelled) and all(zlib.crc32(w) == s for w, s in spelled.items())
    assert (pairs[0] >= 0).sum() > 100
    assert found(texts, (lo, hi, states), pairs) == found(texts)
    # a wrong state shows, so known words and pairs do come from the tables
    assert found(texts, (lo, hi, states ^ np.uint32(1))) != found(texts)
    assert found(texts, (lo, hi, states), (pairs[0], pairs[1] ^ np.uint32(1))) != found(texts)


def test_frequent_words_stay_in_crowded_slots(monkeypatch):
    monkeypatch.setattr(R, "SLOTS", 64)
    rnd = random.Random(3)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"the cat the cat {words(rnd, 3)}"] * 3)], ["text"]) for _ in range(40)]
    out = next(R._head_counter()(iter(batches))).to_pylist()
    n = {(r["word"], r["then"]): r["n"] for r in out}
    assert n[(b"the", None)] >= 200 and n[(b"cat", None)] >= 200 and n[(b"the", b"cat")] >= 200
