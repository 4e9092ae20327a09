from edge import edge_documents, edge_texts, no_documents
from pyspark.sql import functions as F

from seqlab.llm import langid
from seqlab.llm.queries import op7_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op7_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    for held in (True, False):
        part = [r for r in rows if r.held_out == held]
        assert part and sum(truth[r.doc_id] == r.lang_pred for r in part) >= 0.98 * len(part)


def test_edges(spark):
    docs = edge_documents(spark)
    model = langid.train(docs, F.lit(True))
    assert model.labels == ["de", "en"]
    rows = langid.classify(docs, model, keep=["doc_id", "text", "score", "row"]).collect()
    assert len(rows) == len(edge_texts())
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and (letter or r.rejected) and 0 <= r.score <= 1
    assert langid.classify(no_documents(spark), model, keep=["doc_id"]).count() == 0


def test_without_training_rows_all_is_undetermined(spark):
    model = langid.train(no_documents(spark), F.lit(True))
    assert {r.lang_pred for r in langid.classify(edge_documents(spark), model, keep=["doc_id"]).collect()} == {"und"}


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    other = spark.createDataFrame([(1, "ωψχφυτσρ ποξνμλκιθ ηζεδγβα"), (2, "The ing of erand was")], "doc_id long, text string")
    far = {r.doc_id: r.rejected for r in langid.classify(other, model, keep=["doc_id"], max_distance=0.9).collect()}
    assert far == {1: True, 2: False}
