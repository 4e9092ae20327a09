"""Document fingerprints by a quartile bucket digest (operator 12).

A text's UTF-8 bytes, with two zero bytes before and after them, are read as
overlapping triplets; each is hashed into one of ``BUCKETS`` buckets and
counted.  The digest states for every bucket in which quarter its count lies
among all counts (two bits), and the length in bytes on a scale of eight steps
for each doubling: three hex digits of length and ``BUCKETS`` / 2 of quarters.
Equal texts have equal fingerprints; texts of one or two bytes differ by the
triplets that touch the zero bytes.

Two digests differ by the sum of their quarters' differences, plus five for
each step of length (at most ``LENGTH_MOST``).  Independent digests reach
``MOST`` = 5/4 of the buckets on average, where the difference is bounded;
the likeness is 1 - difference / MOST, between 0 and 1.

``edited_fingerprints`` compares each document with an edited text, whose end
comes from the next document in order of id.  Documents are dealt by ranges of
(id, digest of the text) and sorted, so a task streams through its range and
meets a document's successor on the next row; texts are shuffled once.  A
range's last document waits: it is written with its text, beside the first of
the following range, and finished by a small join.

A null text is an empty one.  Documents without id come last; those with one
id are ordered by the md5 of their texts, and equal rows are interchangeable.
The last document's successor is the first; a single document follows itself.
Very long texts are counted in pieces of ``PIECE`` bytes.  Other columns are
ignored; an empty table gives an empty one.
"""
from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from seqlab.llm import wordscan
from seqlab.llm.scratch import bounded_batches, with_text, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 256
#: Multiplier of the triplet hash; a bucket is the upper 8 of 32 bits.
HASH = 2654435761
LENGTH_STEP, LENGTH_MOST, MOST = 5, 50, 320
PIECE = 1 << 20


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte triplets, a row for each text."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    owners: list[int] = []
    pieces: list[bytes] = []

    def count():
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
        bucket = ((code * np.uint32(HASH)) >> np.uint32(24)).astype(np.int64)
        inside = owner[:-2] == owner[2:]
        found = np.bincount((owner[:-2] * BUCKETS + bucket)[inside], minlength=len(pieces) * BUCKETS)
        np.add.at(out, owners, found.reshape(-1, BUCKETS))
        owners.clear()
        pieces.clear()

    held = 0
    for i, t in enumerate(texts):
        padded = b"\0\0" + t + b"\0\0"
        for lo in range(0, len(padded) - 2, PIECE):  # pieces share two bytes, so no triplet is lost or counted twice
            owners.append(i)
            pieces.append(padded[lo:lo + PIECE + 2])
            held += len(pieces[-1])
            if held >= PIECE:
                count()
                held = 0
    if pieces:
        count()
    return out


def digests(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    c = bucket_counts(texts)
    ranked = np.sort(c, 1)
    quarter = sum((c > ranked[:, [q * BUCKETS // 4 - 1]]).astype(np.uint8) for q in (1, 2, 3))
    packed = quarter.reshape(len(texts), -1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return [f"{length_step(len(t)):03x}{p.tobytes().hex()}" for t, p in zip(texts, packed, strict=True)]


def length_step(n: int) -> int:
    """Eight steps for each doubling of n + 1."""
    bits = (n + 1).bit_length()
    return 8 * bits + ((n + 1) * 8 >> (bits - 1) & 7)


def _read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and quarters of fingerprints."""
    raw = np.frombuffer(bytes.fromhex("".join("0" + f for f in fingerprints)), np.uint8).reshape(len(fingerprints), 2 + BUCKETS // 4)
    quarters = (raw[:, 2:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return raw[:, 0].astype(int) * 256 + raw[:, 1], quarters.reshape(len(fingerprints), BUCKETS).astype(np.int16)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """The likeness of each pair of fingerprints."""
    (length_a, quarter_a), (length_b, quarter_b) = _read(a), _read(b)
    apart = np.abs(quarter_a - quarter_b).sum(1) + np.minimum(LENGTH_STEP * np.abs(length_a - length_b), LENGTH_MOST)
    return 1 - np.minimum(apart, MOST) / MOST


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprint columns; null where one is null."""
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        at = np.flatnonzero(np.asarray(x.is_valid()) & np.asarray(y.is_valid()))
        if len(at):
            out[at] = likenesses(x.take(pa.array(at)).to_pylist(), y.take(pa.array(at)).to_pylist())
        return pa.array(out, from_pandas=True)

    return arrow_udf(run, "double")(a, b)


def fingerprints(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``fingerprint``."""
    keep = [c for c in keep if c != "fingerprint"]
    rows, place = with_text(documents, keep, text)

    def run(batches):
        for batch in batches:
            found = digests([(t or "").encode() for t in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.string())],
                                             [*keep, "fingerprint"])

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "fingerprint string"])
    return rows.mapInArrow(wordscan.trimmed(run), schema)


def edited(own: str, following: str) -> str:
    """``own`` with its last quarter replaced by as many first characters of ``following``, or all it has."""
    n = len(own) // 4
    return own[:len(own) - n] + following[:n]


def _compared(texts: list[str], own: list[str], following: list[str], next_own: list[str]) -> dict[str, list]:
    """Result columns of texts with their fingerprints, and their successors' texts and fingerprints."""
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    found = digests(changed)
    return {"n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
            "fingerprint": own, "edited_fingerprint": found, "near_edited": likenesses(own, found).tolist(),
            "near_next": likenesses(own, next_own).tolist()}


_KINDS = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
          "near_edited": pa.float64(), "near_next": pa.float64()}
_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _streamed(batches):
    """Rows of one range in order: finished documents, the first one, and the last one, which waits for the next range."""
    held = token = None
    for batch in batches:
        ids, texts, ties = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        if not texts:
            continue
        own = digests([t.encode() for t in texts])
        if token is None:
            token = f"{ids[0].as_py()}:{ties[0]}"
            yield _open(ids.slice(0, 1), texts[0], own[0], ties[0], token, "first")
        if held is not None:
            ids = pa.concat_arrays([held[0], ids])
            texts, own, ties = [held[1], *texts], [held[2], *own], [held[3], *ties]
        if len(texts) > 1:
            done = _compared(texts[:-1], own[:-1], texts[1:], own[1:])
            n = len(texts) - 1
            yield pa.RecordBatch.from_arrays(
                [ids.slice(0, n), *(pa.array(v, _KINDS[c]) for c, v in done.items()), *(pa.nulls(n, pa.string()) for _ in range(3)),
                 pa.array(["done"] * n)], _STREAM)
        held = (ids.slice(len(texts) - 1, 1), texts[-1], own[-1], ties[-1])
    if held is not None:
        yield _open(held[0], held[1], held[2], held[3], token, "last")


_STREAM = ["doc_id", *_KINDS, "text", "tie", "token", "kind"]


def _open(ids, text, own, tie, token, kind):
    none = {c: pa.nulls(1, k) for c, k in _KINDS.items()} | {"fingerprint": pa.array([own])}
    return pa.RecordBatch.from_arrays([ids, *none.values(), pa.array([text], pa.string()), pa.array([tie]), pa.array([token]), pa.array([kind])],
                                      _STREAM)


def _finished(batches):
    for batch in batches:
        c = {n: batch.column(i).to_pylist() for i, n in enumerate(("_", "text", "own", "next_text", "next_own"))}
        done = _compared(c["text"], c["own"], c["next_text"], c["next_own"])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, _KINDS[k]) for k, v in done.items())], ["doc_id", *_KINDS])


def edited_fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    bounded_batches(documents.sparkSession)
    kind = documents.schema[doc_id].dataType.simpleString()
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.md5(F.col("text").cast("binary")))
    order = [F.asc_nulls_last("doc_id"), F.asc("tie")]
    streamed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        wordscan.trimmed(_streamed), f"doc_id {kind}, {_RESULT}, text string, tie string, token string, kind string"), "fingerprints")
    first = streamed.where("kind = 'first'")
    along = Window.orderBy(*order)  # a short row for each range
    following = first.select("token", F.coalesce(
        F.lead("token").over(along),
        F.first("token").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_token"))
    last = (streamed.where("kind = 'last'").select("doc_id", "text", F.col("fingerprint").alias("own"), "token").join(following, "token")
            .join(first.select(F.col("token").alias("next_token"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_own")),
                  "next_token").select("doc_id", "text", "own", "next_text", "next_own"))
    return streamed.where("kind = 'done'").select("doc_id", *_KINDS).unionByName(
        last.mapInArrow(wordscan.trimmed(_finished), f"doc_id {kind}, {_RESULT}"))
