"""Connected components of an edge table by alternating large and small stars.

Every round re-points edges to the smallest neighbour with two grouped minima
(combined before the shuffle) and two joins on the vertex, which AQE can split
when one vertex has very many edges.  Rounds are written to the shared folder,
and the loop ends at the fixed point, where every vertex points at its root.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.scratch import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` holds edges from a larger vertex ``a`` to a smaller ``b``."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "cc") -> DataFrame:
    """(vertex, root) for every vertex that has an edge to another one; root is the component's smallest vertex.

    Self-loops, repeated edges, edges in both directions and edges with a null
    end are allowed and change nothing.
    """
    e = (edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")))
    e = written(e.distinct(), label)
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark["n"] == 0 or (seen is not None and mark == seen):
            break
        seen = mark
        e = written(_small_star(_large_star(e)), label)
    return (e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
            .unionByName(e.select(F.col("b").alias("vertex"), F.col("b").alias("root"))).distinct())
