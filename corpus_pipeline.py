"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of their input;
extra columns stay, whatever their names.  ``run`` writes every stage's result
to the shared folder and reads it again for the next one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm.bpe import encode
from seqlab.llm.decontam import contaminated_words
from seqlab.llm.jaccard import one_of_each_group
from seqlab.llm.langid import classify, train
from seqlab.llm.queries import bpe_digests, table
from seqlab.llm.scratch import written
from seqlab.llm.secrets import find_secrets, redacted


def _packed(docs: DataFrame) -> DataFrame:
    """The text beside all other columns in one struct, so none can clash with an operator's outputs."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("doc"), "text")


def _unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    new = {"text": F.col("text")} | new
    return df.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language identifier rejects: no letter, or far from every language.

    Where no row has a language there is nothing to learn from, and every document stays.
    """
    model = train(docs, F.lit(True))
    if not model.labels:
        return docs
    return _unpacked(classify(_packed(docs), model, keep=["doc", "text"]).where("not rejected"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return one_of_each_group(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    found = contaminated_words(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["doc", "text"])
    return _unpacked(found.where("n_hit = 0"), docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text; ``n_chars``, where there is one, follows the text."""
    found = find_secrets(_packed(docs), keep=["doc", "text"])
    found = found.select("doc", redacted(F.col("text"), F.col("spans")).alias("text"), (F.size("spans") > 0).alias("masked"))
    if "n_chars" not in docs.columns:
        return _unpacked(found, docs.columns)
    kind = docs.schema["n_chars"].dataType
    length = F.when(F.col("masked"), F.length("text").cast(kind)).otherwise(F.col("doc.n_chars"))
    return _unpacked(found, docs.columns, n_chars=length)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text: number of tokens, digests of the ids and of the decoded bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"]))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("byte-level BPE", tokenize),
]

#: The first stage learns its model from the table, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
