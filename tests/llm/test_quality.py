import random

import numpy as np
import pyarrow as pa
from edge import edge_documents, edge_texts, no_documents, words

from seqlab.llm import quality, wordscan


def labelled(spark, rnd, n=600):
    rows = []
    for i in range(n):
        text = words(rnd, rnd.choice([8, 40, 100]))
        bad = rnd.random() < 0.3
        rows.append((i, text.replace(" ", "### ") if bad else text, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_learns_and_scores_edges(spark):
    rnd = random.Random(8)
    known = labelled(spark, rnd)
    model = quality.train(known.drop("label"), known.drop("text"))
    test = labelled(spark, rnd, 300)
    truth = {r.doc_id: r.label for r in test.collect()}
    rows = quality.score(test, model, keep=["doc_id"]).collect()
    assert sum((r.score >= 0.5) == (truth[r.doc_id] == 1) for r in rows) >= 0.95 * len(rows)
    edges = quality.score(edge_documents(spark), model, keep=["doc_id", "score", "text"]).collect()
    assert len(edges) == len(edge_texts()) and all(0 <= r.score <= 1 for r in edges)
    assert len({r.score for r in edges if not (r.text or "").strip()}) == 1
    assert quality.score(no_documents(spark), model, keep=["doc_id"]).count() == 0


def test_without_labels_every_score_is_half(spark):
    none = spark.createDataFrame([(1, "text", None), (2, None, 5)], "doc_id long, text string, label int")
    model = quality.train(none, none)
    assert {r.score for r in quality.score(none, model, keep=["doc_id"]).collect()} == {0.5}


def test_score_does_not_depend_on_the_batch():
    texts = [t for _, t in edge_texts()]
    raw, offsets, _ = wordscan.text_buffer(pa.array(texts, pa.string()))
    first, slot, value = quality.features(raw, offsets)
    for i, t in enumerate(texts):
        r, o, _ = wordscan.text_buffer(pa.array([t], pa.string()))
        f, s, v = quality.features(r, o)
        a, b = first[i], first[i + 1]
        assert sorted(zip(slot[a:b], np.round(value[a:b], 9), strict=True)) == sorted(zip(s, np.round(v, 9), strict=True))


def test_ftrl_step_by_hand():
    z, n = np.zeros(3), np.zeros(3)
    quality.ftrl([(np.array([0, 2]), np.array([1.0, 0.5]), 1)], z, n, 0.5, 1.0, 0.0, 0.0)
    assert np.allclose(z, [-0.5, 0, -0.25]) and np.allclose(n, [0.25, 0, 0.0625])
    # weights now: -z / ((1 + sqrt(n)) / 0.5)
    w = np.array([0.5 / (1.5 / 0.5), 0, 0.25 / (1.25 / 0.5)])
    quality.ftrl([(np.array([0, 2]), np.array([1.0, 0.5]), 0)], z, n, 0.5, 1.0, 0.0, 0.0)
    p = 1 / (1 + np.exp(-(w[0] + 0.5 * w[2])))
    g = np.array([p, 0, 0.5 * p])
    n0 = np.array([0.25, 0, 0.0625])
    assert np.allclose(n, n0 + g * g)
    assert np.allclose(z, np.array([-0.5, 0, -0.25]) + g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / 0.5 * w)


def test_query_on_held_out_labels(spark):
    from seqlab.llm.queries import op8_quality_classifier
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality_classifier(spark, sf).collect()
    assert len(rows) == 1000 and all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([a > b for a in good for b in bad]) >= 0.95
