"""Centroid clustering over an incremental distance matrix (operator 11).

Vectors of exactly ``dims`` finite components become integers floor(scale * x),
so every sum, dot product and squared distance below is exact.  A state table
in the shared folder holds each vector beside its dot products with all
centroids.  A round reads it once and

1. adds to each dot product what the centroid's changed components contribute
   (centroids and components that did not change cost nothing), from which the
   squared distance is ``|x|^2 - 2 x.c + |c|^2``, and takes the least;
2. writes the state anew, and sums the vectors of each cluster: one row of sums
   for each task and cluster, added up by Spark.

The driver holds the centroids alone (``k`` times ``dims`` integers).  The first
state has dot products of 0 with centroids at 0, so the starting centroids enter
as changes like all later ones.  A state replaces the one before it, which is
dropped once the next is complete; rows never move, so there is no shuffle but
that of the sums, and a lost task reads its part of the last state again.

Defined results: a vector that is null, has another number of components, or
holds a null or non-finite one is left out; so is the label and every other
column.  A row without id is clustered but starts no centroid.  Repeated rows
count each; rows with one id and different vectors are ordered by their
integers when they start centroids.  With fewer than ``k`` vectors there are
as many centroids as vectors with an id; with none the result is empty.  Equal
distances go to the smaller number, so of equal starting centroids all but the
first stay empty, and keep their place.  Components beyond ``LARGEST`` after
scaling would leave the 64 bits of a distance and raise an error.
"""
from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlab.llm import wordscan
from seqlab.llm.scratch import bounded_batches, dropped, written_at

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Largest scaled component: a squared distance of 64 such components stays below 2^61.
LARGEST = 1 << 26


def _rows(column, width: int) -> np.ndarray:
    """A list column whose rows all have ``width`` values, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(matrix.ravel()))


def updated(x: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after each centroid's change, from its nonzero components only."""
    out = dots.copy()
    most = int(np.abs(x).max(initial=0)) * int(np.abs(change).max(initial=0)) * max(1, change.shape[1])
    exact = x.astype(np.float64 if most < 1 << 53 else np.int64)  # sums below 2^53 are exact in doubles, and faster
    for j in np.flatnonzero(change.any(1)):
        at = np.flatnonzero(change[j])
        out[:, j] += (exact[:, at] @ change[j, at].astype(exact.dtype)).astype(np.int64)
    return out


def nearest(x: np.ndarray, dots: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid; ties go to the smaller number."""
    d = (centers * centers).sum(1) - 2 * dots
    who = d.argmin(1) if len(x) else np.zeros(0, np.int64)
    x = x.astype(np.int64)
    return who, d[np.arange(len(x)), who] + (x * x).sum(1)


def _stepper(change: np.ndarray, centers: np.ndarray, dims: int):
    """State -> state with dot products, cluster and distance of the changed centroids."""
    k = len(centers)

    def step(batches):
        for batch in batches:
            x = _rows(batch.column(1), dims)
            dots = _rows(batch.column(2), k) if batch.num_columns > 2 else np.zeros((len(x), k), np.int64)
            dots = updated(x, dots, change)
            who, distance = nearest(x, dots, centers)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(dots), pa.array(who.astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "x", "dots", "cluster", "distance"])
    return step


def _summer(k: int, dims: int):
    """(cluster, x) -> one row of counts and sums for each cluster that a task has met."""
    def add(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            who = np.asarray(batch.column(0))
            n += np.bincount(who, minlength=k)
            np.add.at(total, who, _rows(batch.column(1), dims).astype(np.int64))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), _lists(total[at])], ["cluster", "n", "total"])
    return add


def integers(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id and x (integers) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    whole = (F.size(v) == dims) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform(v, lambda c: F.when(F.abs(c * scale) < float(LARGEST), F.floor(c * scale)).otherwise(
        F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling"))).cast("int"))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def first_centroids(x: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors with the least sha256 of ``<seed>:<vec_id>``, in that order (k rows on the driver)."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = x.where("vec_id is not null").select(drawn.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in top], np.int64).reshape(len(top), dims)


def moved(centers: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centroids at the floored means of their vectors; those without vectors stay."""
    found = (sums.select("cluster", "n", F.posexplode("total").alias("place", "part")).groupBy("cluster", "place")
             .agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect())  # a row for each component of a centroid
    out = centers.copy()
    for r in found:
        out[r["cluster"], r["place"]] = r["total"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance of every vector; the final centroids as a k x dims matrix)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[vec_id].dataType
    state, path = written_at(integers(vectors, vec_id, vector, dims, scale), "integers")
    centers = first_centroids(state, k, seed, dims)
    if not len(centers):
        empty = T.StructType([T.StructField("vec_id", kind), T.StructField("x", T.ArrayType(T.IntegerType())),
                              T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return spark.createDataFrame([], empty), centers
    schema = f"vec_id {kind.simpleString()}, x array<int>, dots array<bigint>, cluster int, distance bigint"
    change = centers
    for number in range(rounds + 1):
        old = path
        columns = ["vec_id", "x"] if number == 0 else ["vec_id", "x", "dots"]
        state, path = written_at(state.select(*columns).mapInArrow(wordscan.trimmed(_stepper(change, centers, dims)), schema), "distances")
        dropped(spark, old)
        if number < rounds:
            sums = state.select("cluster", "x").mapInArrow(_summer(len(centers), dims), "cluster int, n bigint, total array<bigint>")
            new = moved(centers, sums)
            change, centers = new - centers, new
    return state.select("vec_id", "x", "cluster", "distance"), centers


def clustered(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    found, centers = cluster(vectors, **how)
    spark = vectors.sparkSession
    spelled = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centers)]
    names = spark.createDataFrame(spelled, "cluster int, centroid_sha256 string")
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = own.agg(F.sum("cluster_inertia").alias("inertia")).scalar()
    known = own.join(names, "cluster").withColumn("inertia", total)
    return found.drop("x").join(F.broadcast(known), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
