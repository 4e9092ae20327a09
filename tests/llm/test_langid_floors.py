"""The training sample, and rejection with the production floors, without a distance given by the caller."""
import base64
import random

from pyspark.sql import functions as F

from seqlab.llm import langid

SF = "/root/testdata/sf0.01"


def far_texts():
    rnd = random.Random(4)
    letters = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(80))
    noise = bytes(rnd.randrange(256) for _ in range(900))
    return ["Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί", "Съешь же ещё этих мягких французских булок, да выпей чаю",
            "天地玄黄宇宙洪荒日月盈昃辰宿列张", "สวัสดีชาวโลก ภาษาไทยเป็นภาษาที่สวยงาม", "Ελλάδα", letters,
            base64.b64encode(noise).decode(), noise.hex()]


def near_texts():
    return ["This is the house.", "Die Kinder gehen mit der Mutter nach Hause.", "Das ist das Haus und der Garten."]


def test_far_texts_are_rejected_and_clean_ones_kept_by_default(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs, F.lit(True))
    rows = [(i, t) for i, t in enumerate(far_texts() + near_texts())]
    got = {r.doc_id: (r.rejected, r.lang_pred, r.score) for r in langid.classify(
        spark.createDataFrame(rows, "doc_id long, text string"), model, keep=["doc_id"]).collect()}
    n = len(far_texts())
    assert all(got[i][0] for i in range(n)), got
    assert not any(got[i][0] for i in range(n, len(rows))), got
    short = docs.where("length(text) > 100").withColumn("text", F.substring("text", 1, 30))
    cut = langid.classify(short, model, keep=["doc_id"])
    assert cut.where("rejected").count() <= 0.01 * short.count()
    own = langid.classify(docs.where("text is not null"), model, keep=["text"]).where("rejected").collect()
    lettered = [r for r in own if any(c.isalpha() for c in r.text)]
    assert len(lettered) <= 0.002 * docs.count(), [(r.text[:60], r.score) for r in lettered]


def test_copies_neither_starve_nor_flood_the_sample(spark, monkeypatch):
    texts = [("en", f"the house number {i} stands there") for i in range(60)]
    rows = texts + [("en", "a hot text that was copied very often")] * 30_000 + [("de", f"das haus nummer {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    sampled, keep = [], langid.written
    monkeypatch.setattr(langid, "written", lambda df, name: sampled.append(out := keep(df, name)) or out)
    model = langid.train(docs, F.lit(True), rows_per_label=30)
    seen = {r["label"]: r["count"] for r in next(d for d in sampled if "counts" in d.columns).groupBy("label").count().collect()}
    assert model.labels == ["de", "en"] and seen["de"] == 5 and 10 <= seen["en"] <= 50


def many(spark, labels):
    rnd = random.Random(8)
    words = {f"l{i:03d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(labels)}
    rows = [(k, " ".join(rnd.choice(w) for _ in range(20))) for k, w in words.items() for _ in range(4)]
    return spark.createDataFrame(rows, "lang string, text string")


def test_every_label_is_learned(spark):
    docs = many(spark, 230)
    model = langid.train(docs, F.lit(True))
    assert len(model.labels) == 230
    got = langid.classify(docs, model, keep=["lang"]).collect()
    assert {r.lang for r in got if r.lang_pred == r.lang} == set(model.labels)


def test_blocks_change_nothing(spark, monkeypatch):
    docs = many(spark, 7)
    model = langid.train(docs, F.lit(True))
    found = []
    for size in (200, 2):
        monkeypatch.setattr(langid, "BLOCK_LABELS", size)
        found.append(sorted((r.text, r.lang_pred, round(r.score, 5), r.rejected) for r in langid.classify(docs, model, keep=["text"]).collect()))
    assert found[0] == found[1]


def test_unlabelled_corpus_stays_in_the_pipeline(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "some text", None), (2, "more text", None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language_id(spark, docs, "").count() == 2
