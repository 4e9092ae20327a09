"""Embedding near-duplicates by an exact metric range join (operator 6).

Vectors with the same non-null label link when their cosine, in double
precision, is at least ``least``.  For vectors of length 1 that is a Euclidean
distance of at most ``r = sqrt(2 - 2 * least)``, so metric pruning is exact:

1. Equal vectors of a label collapse into one class with a count.
2. A label of more than ``CELL`` classes is partitioned by pivots (chosen
   farthest first from a bounded hash sample; they only affect speed).  A
   vector's home is the cell of its nearest pivot.
3. It is replicated to the cells in which a partner could be at home: by the
   triangle inequality the pivot there is at most ``2 r`` further than its own,
   and the plane halfway between the two pivots is at most ``r`` away.
4. Cells join independently, in pairs of blocks of at most about ``BLOCK``
   vectors.  A block pair gives each home vector's number of links and a
   spanning forest of its links, never the links themselves.
5. Counts are added up; components of the forest give the ids.

A vector that is null, of length zero, or holds a null or non-finite number
links with nothing, nor does a row without label or id; vectors of different
dimensions do not link.  Repeated rows count as several vectors.  Other
columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm import wordscan
from seqlab.llm.components import components
from seqlab.llm.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Classes of a label from which on it is partitioned, most pivots of a label, and most vectors in a block.
CELL, PIVOTS, BLOCK = 1024, 64, 2048
#: Rows up to which the table of large labels is broadcast (under 100 bytes each).
BROADCAST_ROWS = 100_000


def _classes(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label (as text), cls (digest of label and vector; null if it can't link), vec (its bytes, in double precision)."""
    def run(batches):
        for batch in batches:
            labels, vecs = batch.column(1).to_pylist(), batch.column(2)
            vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
            cls, out = [], []
            for own, v in zip(labels, vecs, strict=True):
                body = None
                if v.is_valid and own is not None and v.values is not None and len(v.values) and not v.values.null_count:
                    x = np.asarray(v.values, np.float64)
                    if np.isfinite(x).all() and x.any():
                        body = x.tobytes()
                out.append(body)
                cls.append(body and hashlib.blake2b(own.encode() + b"\0" + body, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(out, pa.binary())],
                ["vec_id", "label", "cls", "vec"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    df = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    df = df.withColumn("label", F.when(F.col("vec_id").isNotNull(), F.col("label")))
    return df.mapInArrow(wordscan.trimmed(run), f"vec_id {kind}, label string, cls binary, vec binary")


def _unit(bodies: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b) for b in bodies])
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pick_pivots(table: pa.Table) -> pa.Table:
    """Farthest-first pivots of one label (and dimension) from its sample."""
    x, k = _unit(table["vec"].to_pylist()), table["pivots"][0].as_py()
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < k and near.max() > 1e-9:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return pa.table({"label": pa.array([table["label"][0].as_py()], pa.string()), "dim": pa.array([table["dim"][0].as_py()], pa.int32()),
                     "places": pa.array([x[chosen].tobytes()], pa.binary())})


def _assigner(r: float):
    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        cols: dict[str, list] = {"label": [], "cell": [], "cls": [], "m": [], "vec": [], "home": []}
        if rows.num_rows:
            x = _unit(rows["vec"].to_pylist())
            p = np.frombuffer(pivots["places"][0].as_py()).reshape(-1, x.shape[1])
            d2 = np.maximum(2 - 2 * x @ p.T, 0)
            apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-12))
            home = d2.argmin(1)
            own = d2[np.arange(len(x)), home]
            slack = 1e-9
            near = (np.sqrt(d2) <= np.sqrt(own)[:, None] + 2 * r + slack) & (
                (d2 - own[:, None]) / (2 * apart[home]) <= r + slack)
            near[np.arange(len(x)), home] = True
            at, cell = np.nonzero(near)
            take = rows.take(pa.array(at))
            return pa.table({"label": take["label"], "cell": pa.array(cell.astype(np.int32)), "cls": take["cls"],
                             "m": take["m"], "vec": take["vec"], "home": pa.array(cell == home[at])})
        return pa.table({"label": pa.array([], pa.string()), "cell": pa.array([], pa.int32()), "cls": pa.array([], pa.binary()),
                         "m": pa.array([], pa.int64()), "vec": pa.array([], pa.binary()), "home": pa.array([], pa.bool_())})
    return assign


def _joiner(least: float):
    def join(table: pa.Table) -> pa.Table:
        left, right = np.asarray(table["is_left"]), np.asarray(table["is_right"])
        cls, m = table["cls"].to_pylist(), np.asarray(table["m"])
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        key, links, other = [], [], []
        if len(a) and len(b):
            x = _unit(table["vec"].to_pylist())
            same = {c: j for j, c in enumerate(cls[i] for i in b)}
            link = np.zeros((len(a), len(b)), bool)
            for lo in range(0, len(a), 512):
                link[lo:lo + 512] = x[a[lo:lo + 512]] @ x[b].T >= least
            for i, c in enumerate(cls[i] for i in a):
                if c in same:
                    link[i, same[c]] = False
            n = link @ m[b]
            for i in np.flatnonzero(n):
                key.append(cls[a[i]])
                links.append(int(n[i]))
                other.append(None)
            # a spanning forest of the links between the two sides; equal classes of both sides are one vertex
            todo_a, todo_b = np.ones(len(a), bool), np.ones(len(b), bool)
            in_a = {c: i for i, c in enumerate(cls[i] for i in a)}
            for s in np.flatnonzero(n):
                if not todo_a[s]:
                    continue
                todo_a[s] = False
                if (j := same.get(cls[a[s]])) is not None:
                    todo_b[j] = False
                wave = [int(s)]
                while wave:
                    i = wave.pop()
                    for j in np.flatnonzero(link[i] & todo_b):
                        todo_b[j] = False
                        key.append(cls[a[i]])
                        links.append(0)
                        other.append(cls[b[j]])
                        back = np.flatnonzero(link[:, j] & todo_a).tolist()
                        if (k := in_a.get(cls[b[j]])) is not None and todo_a[k]:
                            todo_a[k] = False
                            wave.append(k)
                        for k in back:
                            if todo_a[k]:
                                todo_a[k] = False
                                if (t := same.get(cls[a[k]])) is not None:
                                    todo_b[t] = False
                                key.append(cls[a[k]])
                                links.append(0)
                                other.append(cls[b[j]])
                                wave.append(k)
        return pa.table({"cls": pa.array(key, pa.binary()), "links": pa.array(links, pa.int64()), "other": pa.array(other, pa.binary())})
    return join


def near_duplicates(vectors: DataFrame, least: float, vec_id: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    r = math.sqrt(max(0.0, 2 - 2 * least))
    rows = written(_classes(vectors, vec_id, vector, label), "vectors")
    classes = rows.where("cls is not null").groupBy("label", "cls").agg(
        F.count("*").alias("m"), F.min("vec_id").alias("rep"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("dim", (F.length("vec") / 8).cast("int")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > CELL).withColumn(
        "pivots", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL)).cast("int")), "large")
    if large.count() <= BROADCAST_ROWS:  # else a shuffled join, which AQE can split
        large = F.broadcast(large)
    here = classes.join(large, ["label", "dim"], "left")
    alone = here.where("n is null").select("label", "dim", F.lit(0).alias("cell"), "cls", "m", "vec", F.lit(True).alias("home"))
    crowd = here.where("n is not null").withColumn("salt", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / (2 * BLOCK))))
    sample = crowd.where(F.pmod(F.xxhash64("cls", F.lit(5)), F.col("n")) < 8 * F.col("pivots"))
    places = sample.groupBy("label", "dim").applyInArrow(_pick_pivots, "label string, dim int, places binary")
    salted = (places.join(large.select("label", "dim", "n"), ["label", "dim"])
              .select("label", "dim", "places", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / (2 * BLOCK)) - 1)).alias("salt")))
    cells = (crowd.select("label", "dim", "salt", "cls", "m", "vec").groupBy("label", "dim", "salt")
             .cogroup(salted.groupBy("label", "dim", "salt"))
             .applyInArrow(_assigner(r), "label string, cell int, cls binary, m long, vec binary, home boolean"))
    cells = written(cells.withColumn("dim", (F.length("vec") / 8).cast("int")).unionByName(alone), "cells")
    at = ["label", "dim", "cell"]
    blocks = cells.groupBy(*at).agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).alias("nl"), F.ceil(F.count("*") / BLOCK).alias("nr")).where("nl > 0")
    dealt = cells.join(blocks, at)
    one = dealt.where("nl = 1 and nr = 1").select(*at, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "cls", "m", "vec",
                                                  F.col("home").alias("is_left"), F.lit(True).alias("is_right"))
    more = dealt.where("nl > 1 or nr > 1")
    hashed = F.xxhash64("cls", F.lit(3))
    lefts = more.where("home").select(*at, F.pmod(hashed, F.col("nl")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"),
                                      "cls", "m", "vec", F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    rights = more.select(*at, F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), F.pmod(hashed, F.col("nr")).alias("j"),
                         "cls", "m", "vec", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"))
    found = written(one.unionByName(lefts).unionByName(rights).groupBy(*at, "i", "j")
                    .applyInArrow(_joiner(least), "cls binary, links long, other binary"), "found")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(found.where("other is not null").select("cls", "other"), "cls", "other", "linked").withColumnRenamed("vertex", "cls")
    named = classes.select("cls", "m", "rep").join(counts, "cls", "left").join(linked, "cls", "left").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "rep", F.coalesce("root", "cls").alias("root"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "root").select("cls", "n_links", "component_id")
    out = rows.select("vec_id", "cls")
    done = (out.where("cls is not null").join(named, "cls").select("vec_id", "n_links", "component_id")
            .unionByName(out.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
