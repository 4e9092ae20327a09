"""Exact quantiles by radix selection, without holding a whole group in one task.

``percentile`` keeps every distinct value of a group in one aggregation
buffer; with groups like "arm" that is a quarter of the data.  Here the 64 bits
of a double are read as an integer that orders as the doubles do, and the
wanted ranks of all groups are found digit by digit (``DIGITS`` digits of 16
bits):

* a pass counts, for all groups and ranks together, the values under each digit
  below the prefix found so far (one aggregate, combined before the shuffle, of
  at most 65,536 counts for a prefix);
* running sums over those counts give the digit that holds each rank.

After the last digit the prefix is the value.  The number of passes is fixed;
no pass depends on how values are distributed, and no task ever orders values.
The narrow (group, value) table is written once and read once a pass, with the
prefixes of the pass before joined on group and prefix.

The result equals ``percentile`` / ``quantile_cont`` (linear interpolation between
the order statistics at floor and ceil of (n - 1) q).  Null values are ignored,
null group keys form groups like any other, and NaN orders above all numbers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.session import written

DIGITS, BITS = 4, 16


def ordered_bits(value: Column) -> Column:
    """The bits of a double (0.0 for -0.0) as a signed integer that orders as the doubles do."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def _digit(bits: Column, place: int) -> Column:
    """Digit ``place`` (0 is the highest, and signed) of ordered bits."""
    shifted = F.shiftright(bits, BITS * (DIGITS - 1 - place))
    return (shifted if place == 0 else shifted.bitwiseAND(F.lit((1 << BITS) - 1))).cast("int")


def exact_quantiles(df: DataFrame, value: str, by: list[str], qs=(0.5,), names: list[str] | None = None,
                    count_name: str | None = None) -> DataFrame:
    """One row per group of ``by`` (groups with no non-null value are absent);
    ``count_name`` also returns the number of non-null values."""
    names = names or [f"q{int(round(q * 100))}" for q in qs]
    # a struct compares its null fields as equal, so it is a null-safe join key
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    x = df.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    x = x.withColumn("_v", F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(F.col("_v")))
    x = written(x.withColumn("_bits", ordered_bits(F.col("_v"))), "quantile-values")

    def position(q, n):
        return (n - 1) * float(q) + 1

    prefix: list[str] = []
    found = None  # the prefixes that hold ranks: _g, digits, values before the prefix, values of the group, ranks
    for place in range(DIGITS):
        keys, digit = ["_g", *prefix], f"_d{place}"
        rows = x.withColumns({f"_d{k}": _digit(F.col("_bits"), k) for k in range(place + 1)})
        counts = [F.count(F.lit(1)).alias("_c")]
        if found is not None:
            rows = rows.join(found, keys)
            counts += [F.first(c).alias(c) for c in ("_before", "_n", "_ranks")]
        if place == DIGITS - 1:
            counts.append(F.first("_v").alias("_value"))  # a full prefix is one value
        bins = rows.groupBy(*keys, digit).agg(*counts)
        whole = Window.partitionBy(*keys)
        below = whole.orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_c").over(below), F.lit(0))
        if found is None:
            n = F.sum("_c").over(whole)
            bins = bins.select("*", before.alias("_before"), n.alias("_n"))
            ranks = F.array_distinct(F.array(*[f(position(q, F.col("_n"))) for q in qs for f in (F.floor, F.ceil)]))
            bins = bins.withColumn("_ranks", ranks)
        else:
            bins = bins.withColumn("_before", F.col("_before") + before)
        bins = bins.withColumn("_ranks", F.filter(
            "_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_c")))).filter(F.size("_ranks") > 0)
        prefix.append(digit)
        found = bins.drop("_c")

    at = found.select("_g", "_n", "_value", F.explode("_ranks").alias("_rank"))
    picked = []
    for i, q in enumerate(qs):
        h = position(q, F.col("_n"))
        picked += [F.max(F.when(F.col("_rank") == F.floor(h), F.col("_value"))).alias(f"_lo{i}"),
                   F.max(F.when(F.col("_rank") == F.ceil(h), F.col("_value"))).alias(f"_hi{i}")]
    g = at.groupBy("_g", "_n").agg(*picked)
    out = []
    for i, (q, name) in enumerate(zip(qs, names)):
        h = position(q, F.col("_n"))
        share, lo, hi = h - F.floor(h), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append(F.when(share == 0, lo).otherwise(lo + share * (hi - lo)).alias(name))
    extra = [F.col("_n").cast("long").alias(count_name)] if count_name else []
    return g.select(*[F.col("_g")[b].alias(b) for b in by], *out, *extra)
