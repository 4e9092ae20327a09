"""S-08: a row sample of an exact size, without replacement.

Every row has a 60-bit number from the md5 of a seed and its key; the sample is
the round(fraction * n) rows with the smallest numbers.  The number at that rank
is found digit by digit (four digits of 15 bits, one histogram of at most
32,768 counts each), so no task orders rows; rows that share the last number
(equal keys) are counted by the partition they were written from.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.session import written

DIGITS, BITS = 4, 15


def key_number(keys: list[str], seed: int) -> Column:
    """The first 15 hex digits of md5(``seed:key1:key2...``) as a number."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sample_exact(df: DataFrame, keys: list[str], fraction: float = 1 / 3, seed: int = 42) -> DataFrame:
    """Exactly round(fraction * n) rows of ``df`` (S-08); the same rows for the same keys and seed.

    Null keys count as the text ``null``.  Which of several rows with equal keys are taken is open.
    """
    rows = written(df.withColumns({"_number": key_number(keys, seed), "_part": F.spark_partition_id()}), "sample-rows")
    n = rows.count()
    wanted = round(n * fraction)
    if wanted <= 0:
        return rows.drop("_number", "_part").limit(0)
    if wanted >= n:
        return rows.drop("_number", "_part")
    left, prefix = wanted, 0
    for place in range(DIGITS):
        low = BITS * (DIGITS - 1 - place)
        here = rows.filter(F.shiftright("_number", low + BITS) == prefix)
        bins = here.groupBy(F.shiftright("_number", low).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        below = F.sum("_c").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))  # at most 32,768 counts
        at = bins.withColumn("_before", F.coalesce(below, F.lit(0))).filter(
            (F.col("_before") < left) & (F.col("_before") + F.col("_c") >= left)).first()
        prefix, left = at["_d"], left - at["_before"]
    # rows below the number at the rank, and as many of the rows with that number as are missing
    ties = rows.filter(F.col("_number") == prefix)
    counts = ties.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.lit(1)))
    some = (ties.withColumn("_place", place).join(counts.select("_part", before.alias("_before")), "_part")
            .filter(F.col("_before") + F.col("_place") <= left))
    return rows.filter(F.col("_number") < prefix).select(*df.columns).unionByName(some.select(*df.columns))
