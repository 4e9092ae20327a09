"""Summary tables (G-06..G-21, T-01..T-05, F-06..F-16).

Each is a single aggregate (partial on the map side) or a small second pass
over an aggregate; results are a handful of rows per group.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.functions.scalar import answer_letter
from seqlab.operators.quantiles import exact_quantiles


def frequency(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """G-06: rows per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def crosstab(df: DataFrame, row: str, col: str, values: list, names: list[str] | None = None) -> DataFrame:
    """G-07: counts of ``row`` x ``col`` with the known column values, 0 where empty."""
    names = names or [str(v) for v in values]
    p = df.groupBy(row).pivot(col, values).count().na.fill(0)
    return p.select(row, *[F.col(str(v)).cast("long").alias(n) for v, n in zip(values, names)])


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """G-08: count, mean, sample std, min, quartiles (linear interpolation), max.
    Quartiles come from the skew-safe exact quantile operator."""
    g = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                            F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"),
                            F.max(value).cast("double").alias("max"))
    q = exact_quantiles(df, value, by, (0.25, 0.5, 0.75), ["p25", "p50", "p75"])
    g, q = g.withColumn("_g", F.struct(*by)), q.select(F.struct(*by).alias("_g"), "p25", "p50", "p75")
    j = g.join(q, on="_g", how="left")  # a struct key: null groups match
    return j.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """G-12: ``bins`` equal-width bins over [min, max], last bin closed.  The range
    enters as two scalar subqueries (evaluated once, no join, no driver loop)."""
    lo = df.select(F.min(value).cast("double")).scalar()
    hi = df.select(F.max(value).cast("double")).scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(1)).otherwise(F.least(F.floor((F.col(value) - lo) / width) + 1, F.lit(bins))).cast("int")
    g = df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", (lo + (F.col("bin") - 1) * (hi - lo) / bins).alias("lo"),
                    (lo + F.col("bin") * (hi - lo) / bins).alias("hi"), "n")


def box_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """G-13: quartiles, 1.5 IQR whiskers (most extreme values inside the fences)
    and the number of outliers per group."""
    q = exact_quantiles(df, value, by, (0.25, 0.5, 0.75), ["q1", "median", "q3"])
    q = q.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    q = q.select(F.struct(*by).alias("_g"), "q1", "median", "q3", "_lo", "_hi")
    j = df.select(*by, value, F.struct(*by).alias("_g")).join(q, on="_g", how="inner")
    inside = (F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi"))
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).cast("double").alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def linear_trend(curve: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """G-14: least-squares slope and intercept of ``y`` on ``x``."""
    return curve.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def letter_share(df: DataFrame, keys: list[str], answer: str = "answer", letter: str = "A") -> DataFrame:
    """G-15: per group, share of answers whose letter (third character) is ``letter``;
    an answer without text counts as another letter."""
    hit = F.coalesce(answer_letter(answer) == letter, F.lit(False))
    return df.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("a_share"))


def column_profile(df: DataFrame) -> DataFrame:
    """G-18: non-null count per column, one aggregate pass, unpivoted."""
    g = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return g.select(F.expr(f"stack({len(df.columns)}, {stack}) as (column_name, non_null)"))


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """T-03: first n rows by an explicit total order (the limit is the feature)."""
    return df.orderBy(*order).limit(n)


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """T-04: sorted distinct labels."""
    return df.select(col).distinct().orderBy(col)


def union_labelled(frames: list[tuple[DataFrame, str | None]], col: str = "experiment_mode") -> DataFrame:
    """T-05: bag union of cohorts; a cohort with a label has its arm replaced by it."""
    parts = [f.withColumn(col, F.lit(lab) if lab is not None else F.col(col).cast("string")) for f, lab in frames]
    return reduce(lambda a, b: a.unionByName(b), parts)


def positional_pattern(wide_or_long: DataFrame, pattern: dict[int, int], keys: list[str], pos: str = "spos",
                       value: str = "difficulty_level") -> DataFrame:
    """F-08: keys whose ``value`` at each 1-based position equals the pattern."""
    cond = reduce(lambda a, b: a | b, [(F.col(pos) == p) & (F.col(value) == v) for p, v in pattern.items()])
    return wide_or_long.groupBy(*keys).agg(F.count_if(cond).alias("_hits")).filter(
        F.col("_hits") == len(pattern)).drop("_hits")


def homogeneity(df: DataFrame, keys: list[str], col: str = "section_id") -> DataFrame:
    """F-12: session is homogeneous when every section equals the first (a null equals a null)."""
    n, filled = F.count(F.lit(1)), F.count(F.col(col))
    return df.groupBy(*keys).agg(((filled == 0) | ((n == filled) & (F.min(col) == F.max(col)))).alias("is_homo"))
