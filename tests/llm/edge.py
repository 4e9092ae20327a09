"""Rows with the awkward cases, and small brute-force helpers shared by the tests."""
from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for outputs or inside
    T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("row", T.StringType()),
    T.StructField("sig", T.StringType()), T.StructField("key", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("ids", T.StringType()), T.StructField("n", T.LongType()), T.StructField("component_id", T.LongType()),
])
EXTRA = (0.5, 7, "r", "s", "k", "sp", "i", 3, 99)


def words(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))


def edge_texts(seed: int = 5) -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, ties, copies, near copies, a very long text, odd characters."""
    rnd = random.Random(seed)
    base = words(rnd, 120)
    near = base.split(" ")
    near[60] = "changed"
    long = words(rnd, 40_000)
    rows = [(1, base), (2, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"),
            (9, "One two"), (10, long), (None, base), (None, None), (11, "x" * 50_000), (12, "日本語 テキスト 😀 née"),
            (13, base.upper()), (14, words(rnd, 120)), (7, "another text under the same id " + words(rnd, 30)),
            (15, "!!! ??? ### 123"), (16, long + " tail")]
    return rows


def edge_documents(spark, rows=None):
    rows = edge_texts() if rows is None else rows
    lang = ["en", None, "de", "en"]
    return spark.createDataFrame([(i, t, lang[k % 4], None if k % 5 == 0 else "src", None if t is None else len(t), *EXTRA)
                                  for k, (i, t) in enumerate(rows)], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
