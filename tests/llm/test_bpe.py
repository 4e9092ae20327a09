import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from edge import edge_documents, edge_texts, no_documents

from seqlab.llm import bpe, wordscan

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def run(codec, texts):
    raw, offsets, _ = wordscan.text_buffer(pa.array(texts, pa.string()))
    ids, at, decoded, decoded_at = codec.texts(raw, offsets)
    return [(ids[at[i]:at[i + 1]].tolist(), decoded[decoded_at[i]:decoded_at[i + 1]].tobytes()) for i in range(len(texts))]


def strange(seed, n):
    rnd = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'ll", " '", "é", "ß", "中", "文", "😀", "1", "23", "!", "\t", "\x1c", "\x85", "\xa0",
             "don't", "x" * 300, "<|endoftext|>", "́", "٣", "½", "\r\n", ".", "　", " a", " b", " ", "aé!", "\x00"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_same_ids_as_the_library(codec, library):
    texts = strange(1, 3000) + ["", None, "x" * 5000, "aé" * 3000, " " * 700 + "a"]
    for text, (ids, decoded) in zip(texts, run(codec, texts), strict=True):
        assert ids == library.encode_ordinary(text or "") and decoded == (text or "").encode()


def test_equal_hashes_are_noticed(codec, library, monkeypatch):
    monkeypatch.setattr(wordscan, "span_hash", lambda raw, start, end: np.zeros(len(start), np.uint64))
    texts = strange(2, 50)
    assert [i for i, _ in run(codec, texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_full_cache_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    texts = strange(3, 200)
    assert [i for i, _ in run(codec, texts)] == [library.encode_ordinary(t) for t in texts]


def test_bytes_of_ids_take_memory_in_proportion_to_the_text(codec, monkeypatch):
    (ids, decoded), = run(codec, ["some words of a text, and 12345 more! " * 20_000])
    ids = np.array(ids, np.int32)
    tracemalloc.start()
    try:
        found, at = codec.bytes_of(ids)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.tobytes() == decoded and len(at) == len(ids) + 1
    assert peak < 12 * len(decoded)
    monkeypatch.setattr(bpe, "RUNS", 7)
    assert codec.bytes_of(ids[:100])[0].tobytes() == b"".join(codec.tokens[i] for i in ids[:100])
    assert [len(x) for x in codec.bytes_of(ids[:0])] == [0, 1]


def test_a_resting_codec_holds_no_connection(codec, library):
    texts = strange(4, 100)
    want = [library.encode_ordinary(t) for t in texts]
    assert [i for i, _ in run(codec, texts)] == want and codec.db is not None
    codec.rest()
    assert codec.connection is None
    codec.pieces.clear()
    assert [i for i, _ in run(codec, texts)] == want


def test_encode_and_decode_tables(spark, library):
    rows = edge_texts()
    df = bpe.encode(edge_documents(spark, rows), RANKS, public_tokenizers.PATTERN, keep=["doc_id", "ids", "source"])
    assert df.columns == ["doc_id", "source", "ids", "decoded"]
    found = df.collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in found) == sorted((library.encode_ordinary(t or ""), (t or "").encode()) for _, t in rows)
    back = bpe.decode(df, RANKS, public_tokenizers.PATTERN, keep=["doc_id"]).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(no_documents(spark), RANKS, public_tokenizers.PATTERN, keep=["doc_id"]).count() == 0


def test_decoded_bytes_are_those_of_the_ids(codec, monkeypatch):
    good = run(codec, ["some text", "and more"])
    monkeypatch.setattr(codec, "_segments", lambda segments: [np.array([codec.ranks[b"x"]], np.int32).tobytes()] * len(segments))
    (ids, decoded), _ = run(codec, ["some text", "and more"])
    assert decoded == b"x" * len(ids) and decoded != good[0][1]


def test_decode_refuses_unknown_ids(codec):
    assert codec.decode([[], [0, 1]])[0] == b""
    with pytest.raises(ValueError):
        codec.decode([[10 ** 6]])


def test_query_on_whole_table(spark, library):
    from seqlab.llm.queries import op4_byte_bpe
    import hashlib
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
