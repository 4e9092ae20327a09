"""The pipeline against a plain Python version of its stages, and on awkward tables."""
import hashlib
import os
import shutil

import public_tokenizers
import pytest
import tiktoken
from edge import edge_documents, no_documents
from pyspark.sql import functions as F
from test_bpe import RANKS
from test_decontam import brute as hits
from test_jaccard import shingles
from test_secrets import everything

import corpus_pipeline
from seqlab.llm import bpe, langid
from seqlab.llm.scratch import written

SF = "/root/testdata/sf0.001"


def plain(docs, bench, spark_docs):
    """doc_id -> the last stage's row, for tables with one row for each doc_id."""
    model = langid.train(spark_docs, F.lit(True))
    far = {r.doc_id for r in langid.classify(spark_docs, model, keep=["doc_id"]).where("rejected").collect()}
    docs = sorted((i, t) for i, t in docs if i not in far)
    sets = {i: shingles(t, 5) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                u, v = find(ids[a]), find(ids[b])
                root[max(u, v)] = min(u, v)
    docs = [(i, t) for i, t in docs if find(i) == i]
    docs = [(i, t) for i, t in docs if not hits(t, bench)[1]]
    ranks = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for i, t in docs:
        clean, at = "", 0
        for s, _, e in everything(t):
            if s >= at or at == 0:
                clean += t[at:s] + "[SECRET]"
                at = e
            else:
                at = max(at, e)
        clean += t[at:]
        tokens = library.encode_ordinary(clean)
        out[i] = (len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    return out


def test_run_matches_plain_python(spark, tmp_path):
    for t in ("documents", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain(docs, bench, df)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 0 < len(got) < len(docs)


@pytest.mark.parametrize("make", [edge_documents, no_documents])
def test_stages_take_awkward_tables(spark, tmp_path, make):
    spark.createDataFrame([(1, "a test passage of a few words")], "item_id long, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    docs = make(spark)
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.count() <= n
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert (docs.count() > 0) == (n > 0)
