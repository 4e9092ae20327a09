"""Language identification by nearest centroid (operator 7).

A text is a vector of its byte n-grams (two and three bytes of the lower-cased
whole text, every ASCII non-letter read as a blank), hashed into ``DIMS``
places, weighted log(1 + count) * idf and scaled to length 1.  Each language
has several centroids from spherical k-means, so that registers of one
language do not average out.  A text gets the language of the centroid with
the highest cosine and is rejected if that cosine is below a floor that depends on
the text's number of different n-grams: the larger of ``SLACK`` times the
``QUANTILE`` quantile that the language's own training texts, whole and cut
short, reach at that length, and of what a text of so many random n-grams
reaches by chance (mean and ``CHANCE`` deviations).  A ``max_distance``
(1 - cosine), if given, takes the floors' place.

Training sees about ``rows_per_label`` different texts of each label, chosen by
hash from all labelled rows, copies counted once: a documented bound of the model's fit, not of what it is
applied to.  Every label is learned; the centroids are a written table, and
texts are classified against broadcast blocks of ``BLOCK_LABELS`` labels.

A null text or one without a letter gets ``und`` with score 0 and is rejected.
Rows with null labels are never learned from.  Without any training row every
text is ``und``.  Ties between centroids go to the first label in order.
Repeated rows give repeated results; columns that are not kept are ignored.
"""
from __future__ import annotations

import sys
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm import wordscan
from seqlab.llm.scratch import bounded_batches, with_text, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 4096
#: Labels of one broadcast block.
BLOCK_LABELS = 200
UNDETERMINED = "und"
#: Bytes of text whose n-grams are counted together, and most texts in one matrix.
PIECE, ROWS = 1 << 20, 256

#: Bytes after which training texts are cut to learn what short texts reach.
CUTS = (8, 32, 128, 512)
#: Floors: the quantile of the training texts' cosines, the share of it that must be reached, the texts that a
#: quantile needs (the median of the other languages serves below that), and deviations above chance.
QUANTILE, SLACK, ENOUGH, CHANCE = 0.05, 0.25, 50, 3.0
#: Classes of length: powers of 4 of the number of different n-grams, which is at most DIMS.
LEVELS = 7

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


class Centroids(NamedTuple):
    """One block of labels; it is broadcast as a plain tuple, which workers read without this module."""

    labels: np.ndarray  # label of each centroid
    center: np.ndarray  # float32, a row for each centroid, length 1
    idf: np.ndarray
    low: np.ndarray  # least cosine by centroid and class of length, 0 where unknown


@dataclass
class Model:
    labels: list[str]  # in order
    idf: np.ndarray
    low: np.ndarray  # by label and class of length
    table: DataFrame | None  # label, center; None without labels

    def blocks(self):
        for at in range(0, len(self.labels), BLOCK_LABELS):
            names = self.labels[at:at + BLOCK_LABELS]
            found = sorted(tuple(r) for r in self.table.where(
                F.col("label").between(names[0], names[-1])).select("label", "center").collect())  # a block's centroids
            place = {n: at + i for i, n in enumerate(names)}
            yield Centroids(np.array([r[0] for r in found], object), np.stack([np.frombuffer(r[1], np.float32) for r in found]),
                            self.idf, self.low[[place[r[0]] for r in found]])


def levels(n: np.ndarray) -> np.ndarray:
    """Classes of length of texts with n different n-grams."""
    return (np.log2(np.maximum(n, 1)) / 2 + 1e-9).astype(int)


def floors(n: np.ndarray, near: np.ndarray, m: Centroids) -> np.ndarray:
    """The cosine that texts with n different n-grams need to belong to their nearest centroids."""
    # n random places have the weights idf and meet the centroid's values at them
    scale = np.sqrt((m.idf.astype(float) ** 2).mean())
    met = m.center * m.idf
    mean, deviation = met.mean(1) / scale, met.std(1) / scale
    chance = np.sqrt(n) * mean[near] + CHANCE * deviation[near]
    return np.maximum(chance, m.low[near, levels(n)])


def ngram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed 2- and 3-byte n-grams, a row for each text; n-grams do not cross texts."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    code = np.where(_LETTER[raw], raw, 0x20).astype(np.uint32)
    out = np.zeros(rows * DIMS, np.int64)
    gram = code
    for n in (2, 3):
        if len(raw) < n:
            break
        gram = (gram[:-1] << np.uint32(8)) | code[n - 1:]
        slot = ((gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64)
        inside = (owner[:len(gram)] == owner[n - 1:]) & (gram != (0x2020 if n == 2 else 0x202020))
        out += np.bincount((owner[:len(gram)] * DIMS + slot)[inside], minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (of any script)."""
    ascii_letter = np.r_[0, np.cumsum((raw >= 0x61) & (raw <= 0x7A))]
    wide = np.r_[0, np.cumsum(raw >= 0x80)]
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for d in np.flatnonzero(~found & (wide[offsets[1:]] > wide[offsets[:-1]])):
        found[d] = any(c.isalpha() for c in raw[offsets[d]:offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _parts(column):
    """Row ranges of a text column with the lower-cased bytes, offsets and has-letter flags of each.

    A range has about ``PIECE`` bytes and ``ROWS`` rows at most, so what is made
    from it stays small however large the batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, _ = wordscan.text_buffer(column)
    at = 0
    while at < len(column):
        to = min(at + ROWS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1))
        raw, inner, _ = wordscan.text_buffer(pc.utf8_lower(column.slice(at, to - at)))
        yield at, to, raw, inner, _has_letter(raw, inner)
        at = to


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; at most k centroids of length 1."""
    mean = x.mean(0)
    seeds = [x[int(np.argmax(x @ mean))]]
    nearest = x @ seeds[0]
    while len(seeds) < min(k, len(x)) and nearest.min() < 1 - 1e-6:
        seeds.append(x[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, x @ seeds[-1])
    center = np.stack(seeds)
    for _ in range(rounds):
        who = np.argmax(x @ center.T, 1)
        new = np.stack([x[who == j].sum(0) if (who == j).any() else center[j] for j in range(len(center))])
        new /= np.maximum(np.sqrt((new * new).sum(1, keepdims=True)), 1e-12)
        if np.allclose(new, center, atol=1e-6):
            break
        center = new
    return center


def _cut_counts(raw: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
    """For each text, the counts of its first bytes up to every cut that it exceeds: places, then counts, as int32 bytes."""
    out: list[list[bytes]] = [[] for _ in range(len(offsets) - 1)]
    for size in CUTS:
        longer = np.flatnonzero(np.diff(offsets) > size)
        if len(longer):
            part = np.concatenate([raw[offsets[d]:offsets[d] + size] for d in longer])
            for d, c in zip(longer, ngram_counts(part, np.arange(len(longer) + 1) * size), strict=True):
                at = np.flatnonzero(c)
                out[d].append(np.r_[at, c[at]].astype(np.int32).tobytes())
    return out


def _low(x: np.ndarray, cuts: list[list[bytes]], center: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The least cosine of each class of length, from one label's vectors and cut texts; nan where too few are known."""
    known = [((x @ center.T).max(1), levels((x > 0).sum(1)))]
    short = [np.frombuffer(c, np.int32).reshape(2, -1) for row in cuts for c in row]
    for lo in range(0, len(short), ROWS):
        counts = np.zeros((len(short[lo:lo + ROWS]), DIMS), np.int64)
        for row, (at, n) in zip(counts, short[lo:lo + ROWS], strict=True):
            row[at] = n
        some = counts.any(1)  # a cut may hold no letter
        known.append(((vectors(counts, idf) @ center.T).max(1)[some], levels((counts > 0).sum(1))[some]))
    cosine, level = (np.concatenate(k) for k in zip(*known, strict=True))
    return np.array([SLACK * np.quantile(cosine[level == k], QUANTILE) if (level == k).sum() >= ENOUGH else np.nan
                     for k in range(LEVELS)], float)


def _filled(low: np.ndarray) -> np.ndarray:
    """Unknown values become the median of the other labels' values of that length, or else that of shorter texts; 0 without any."""
    out, before = low.copy(), np.zeros(len(low))
    for k in range(LEVELS):
        known = ~np.isnan(low[:, k])
        if not known.all():
            out[~known, k] = np.median(low[known, k]) if known.any() else before[~known]
        before = out[:, k]
    return out


def _nothing() -> Model:
    return Model([], np.zeros(DIMS, np.float32), np.zeros((0, LEVELS)), None)


def train(documents: DataFrame, chosen: Column, label: str = "lang", text: str = "text", rows_per_label: int = 1000,
          centroids: int = 4) -> Model:
    """Fit centroids on about ``rows_per_label`` different texts among the ``chosen`` rows of each label."""
    bounded_batches(documents.sparkSession)
    rows = documents.where(chosen & F.col(label).isNotNull() & F.col(text).isNotNull())
    # copies of a text count once, or they would starve the sample or flood it
    rows = rows.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"),
                       F.xxhash64(text, F.lit(7)).alias("draw"), F.xxhash64(text).alias("same"))
    sizes = written(rows.select("label", "draw", "same").distinct().groupBy("label").agg(F.count("*").alias("n")), "labels")
    n_labels = sizes.count()
    if not n_labels:
        return _nothing()
    picked = (rows.join(sizes, "label").where(F.pmod("draw", F.lit(1 << 40)) < F.least(F.lit(1.0), rows_per_label / F.col("n")) * (1 << 40))
              .dropDuplicates(["label", "draw", "same"]).select("label", "text"))

    def count(batches):
        for batch in batches:
            for lo, hi, raw, offsets, letter in _parts(batch.column(1)):
                counts = ngram_counts(raw, offsets)
                ok = np.flatnonzero(letter)
                short = _cut_counts(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(ok)),
                     pa.array([c.astype(np.int32).tobytes() for c in counts[ok]], pa.binary()),
                     pa.array([short[d] for d in ok], pa.list_(pa.binary()))], ["label", "counts", "cuts"])

    counted = written(picked.mapInArrow(wordscan.trimmed(count), "label string, counts binary, cuts array<binary>").repartition(max(8, n_labels // 8)), "ngrams")

    def document_counts(batches):
        held, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for c in batch.column(0).to_pylist():
                held += np.frombuffer(c, np.int32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([held.tobytes()], pa.binary())], ["n", "held"])

    parts = counted.select("counts").coalesce(8).mapInArrow(wordscan.trimmed(document_counts), "n long, held binary").collect()  # 8 rows
    total = sum(p["n"] for p in parts)
    held = sum((np.frombuffer(p["held"], np.int64) for p in parts), np.zeros(DIMS, np.int64))
    idf = (np.log((1 + total) / (1 + held)) + 1).astype(np.float32)

    def cluster(table: pa.Table) -> pa.Table:
        x = vectors(np.stack([np.frombuffer(c, np.int32) for c in table["counts"].to_pylist()]), idf)
        center = kmeans(x, centroids).astype(np.float32)
        low = _low(x, table["cuts"].to_pylist(), center, idf)
        return pa.table({"label": pa.array([table["label"][0].as_py()] * len(center), pa.string()),
                         "center": pa.array([c.tobytes() for c in center], pa.binary()),
                         "low": pa.array([low.tobytes()] * len(center), pa.binary())})

    found = written(counted.groupBy("label").applyInArrow(cluster, "label string, center binary, low binary"), "centroids")
    lows = sorted(map(tuple, found.select("label", "low").distinct().collect()))  # a few numbers for each label
    if not lows:
        return _nothing()
    return Model([r[0] for r in lows], idf, _filled(np.stack([np.frombuffer(r[1]) for r in lows])), found)


def classify(documents: DataFrame, model: Model, keep: list[str], max_distance: float | None = None,
             text: str = "text") -> DataFrame:
    """The kept columns with ``lang_pred``, ``score`` (the best cosine) and ``rejected``."""
    out = ("lang_pred", "score", "rejected")
    keep = [c for c in keep if c not in out]
    rows, place = with_text(documents, keep, text)
    blocks = [documents.sparkSession.sparkContext.broadcast(tuple(b)) for b in model.blocks()]
    idf = documents.sparkSession.sparkContext.broadcast(model.idf)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            letter, far, score = np.zeros(rows, bool), np.zeros(rows, bool), np.full(rows, -1.0)
            names = np.full(rows, UNDETERMINED, object)
            x, n = np.zeros((rows if blocks else 0, DIMS), np.float32), np.zeros(rows, int)
            for lo, hi, raw, offsets, found in _parts(batch.column(place)):
                letter[lo:hi] = found
                if blocks:
                    counts = ngram_counts(raw, offsets)
                    x[lo:hi], n[lo:hi] = vectors(counts, idf.value), (counts > 0).sum(1)
            for block in blocks:
                m = Centroids(*block.value)
                cosine = x @ m.center.T
                near = np.argmax(cosine, 1)
                most = cosine[np.arange(rows), near]
                below = most < floors(n, near, m) if max_distance is None else 1 - most > max_distance
                more = most > score
                names[more], far[more], score[more] = m.labels[near[more]], below[more], most[more]
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # a worker holds one block at a time
            sure = letter & bool(blocks)
            score = np.where(sure, np.clip(score, 0, 1), 0.0)
            names[~sure] = UNDETERMINED
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(names.tolist(), pa.string()), pa.array(score, pa.float64()),
                 pa.array(~sure | far)], [*keep, *out])

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep),
                        "lang_pred string, score double, rejected boolean"])
    return rows.mapInArrow(wordscan.trimmed(run), schema)
