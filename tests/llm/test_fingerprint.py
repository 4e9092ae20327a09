"""Document fingerprints against a brute force by definition, over many ranges and awkward rows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from edge import edge_documents, edge_texts, no_documents, words
from pyspark.sql import functions as F

from seqlab.llm import fingerprint as P


def brute_fingerprint(text: str) -> str:
    b = [0, 0, *text.encode(), 0, 0]
    counts = Counter((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * P.HASH % 2**32 // 2**24 for i in range(len(b) - 2))
    ranked = sorted(counts.get(k, 0) for k in range(256))
    digits = [sum(counts.get(k, 0) > ranked[q] for q in (63, 127, 191)) for k in range(256)]
    m = len(text.encode()) + 1
    step = 8 * m.bit_length() + (m * 8 // 2 ** (m.bit_length() - 1)) % 8
    return f"{step:03x}" + "".join(f"{4 * digits[i] + digits[i + 1]:x}" for i in range(0, 256, 2))


def brute_likeness(a: str, b: str) -> float:
    def read(f):
        return int(f[:3], 16), [q for d in f[3:] for q in divmod(int(d, 16), 4)]
    (la, qa), (lb, qb) = read(a), read(b)
    return 1 - min(320, sum(abs(x - y) for x, y in zip(qa, qb)) + min(5 * abs(la - lb), 50)) / 320


def brute(rows):
    """Result rows of (doc_id, text) rows, sorted."""
    md5 = {t: hashlib.md5(t.encode()).hexdigest() for t in {t or "" for _, t in rows}}
    ranked = sorted(((i is None, i or 0, md5[t or ""]), i, t or "") for i, t in rows)
    out = []
    for k, (_, i, t) in enumerate(ranked):
        after = ranked[(k + 1) % len(ranked)][2]
        q = len(t) // 4
        e = t[:len(t) - q] + after[:q]
        f, g, h = (brute_fingerprint(x) for x in (t, e, after))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, brute_likeness(f, g), brute_likeness(f, h)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_awkward_rows_equal_brute_force(spark, partitions):
    rnd = random.Random(11)
    rows = edge_texts() + [(100 + i, words(rnd, rnd.randint(0, 60))) for i in range(40)]
    rows += [(None, words(rnd, 5)) for _ in range(30)] + [(200, words(rnd, 4)) for _ in range(30)]  # hot ids
    rows += [(300, "the same text")] * 30 + [(301, "a"), (302, "é"), (303, "ab"), (304, "\0")]
    df = edge_documents(spark, rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = P.edited_fingerprints(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert len({r.fingerprint for r in got if r.doc_id in (301, 302, 303, 304)}) == 4
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_empty_table_and_single_row(spark):
    assert P.edited_fingerprints(no_documents(spark)).collect() == []
    one = P.edited_fingerprints(edge_documents(spark, [(5, "abcdefgh")])).collect()
    assert [tuple(r) for r in one] == brute([(5, "abcdefgh")]) and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(2)
    texts = [words(rnd, 700).encode(), b"", b"x" * 1001, words(rnd, 3).encode()]
    whole = P.bucket_counts(texts)
    monkeypatch.setattr(P, "PIECE", 64)
    assert (P.bucket_counts(texts) == whole).all()
    assert whole.sum(1).tolist() == [len(t) + 2 for t in texts]


def test_operator_keeps_columns_and_compares(spark):
    df = edge_documents(spark).withColumn("fingerprint", F.lit("clash"))
    got = P.fingerprints(df, keep=["doc_id", "text", "score", "fingerprint"]).collect()
    assert sorted(r.fingerprint for r in got) == sorted(brute_fingerprint(t or "") for _, t in edge_texts())
    pairs = spark.createDataFrame([(brute_fingerprint("one text"), brute_fingerprint("one test")), (None, brute_fingerprint("x"))], "a string, b string")
    near = [r.n for r in pairs.select(P.likeness(F.col("a"), F.col("b")).alias("n")).collect()]
    assert near == [brute_likeness(brute_fingerprint("one text"), brute_fingerprint("one test")), None]


def test_edited_texts_are_nearer_than_other_documents(spark):
    rows = P.edited_fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    told = [r for r in rows if r.n_chars >= 100]
    assert np.mean([r.near_edited > r.near_next for r in told]) > 0.98
    assert np.mean([r.near_edited for r in told]) > 0.65 and np.mean([r.near_next for r in told]) < 0.25
