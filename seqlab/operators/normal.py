"""Least squares from one row of sums: the normal equations of k regressors, k < 20.

A model is a one-row (or one-row-per-group) table with the upper triangle of
the cross-products of the regressors and the outcome, which one distributed
aggregate gives.  ``solve`` sweeps the matrix pivot by pivot with column
expressions, so the slopes, the inverse and the residual sum of squares stay in
the plan.  A regressor that is a linear combination of those before it is left
out: its coefficient is null and it does not count as a parameter.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot below this share of its regressor's own sum of squares counts as 0.
COLLINEAR = 1e-10
MOST = 20


def name(i: int, j: int) -> str:
    """Column of the cross-product of variables i and j (the outcome is the last)."""
    return f"_a{min(i, j)}_{max(i, j)}"


def names(k: int) -> list[str]:
    return [name(i, j) for i in range(k + 1) for j in range(i, k + 1)]


def check(k: int) -> None:
    if not 0 < k < MOST:
        raise ValueError(f"{k} regressors: the normal equations are solved in one row for 1 to {MOST - 1}")


def centred_sums(xs: list[str], y: str) -> list[Column]:
    """Aggregates of a group: n, means ``_m<i>``, and cross-products about the means."""
    n = F.count(F.lit(1))
    cols = [*xs, y]
    return [n.alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
            *[(F.covar_pop(cols[i], cols[j]) * n).alias(name(i, j)) for i in range(len(cols)) for j in range(i, len(cols))]]


def solve(df: DataFrame, k: int, own: list[str] | None = None) -> DataFrame:
    """Sweep regressors 0..k-1 of rows that hold ``names(k)``.

    ``own`` names the columns of the regressors' own sums of squares, by default the
    diagonal (e.g. those before effects were taken out).  Adds ``_b<i>`` (slopes; null if left out), ``_v<i>_<j>`` (inverse of the
    cross-products of the regressors that stay; 0 for the others), ``_rss`` and ``_rank``.
    """
    check(k)
    others = [c for c in df.columns if c not in set(names(k)) | set(own or [])]
    df = df.select(*others, *names(k), *[F.col(own[i] if own else name(i, i)).alias(f"_own{i}") for i in range(k)])
    for p in range(k):
        df = df.withColumn(f"_ok{p}", F.col(name(p, p)) > COLLINEAR * F.col(f"_own{p}"))
        d = F.col(name(p, p))
        swept = []
        for i in range(k + 1):
            for j in range(i, k + 1):
                a = F.col(name(i, j))
                if i == j == p:
                    new, skipped = -1 / d, F.lit(0.0)
                elif p in (i, j):
                    new, skipped = a / d, F.lit(0.0)
                else:
                    # rows swept before hold slopes, whose sign turns the cross-product around
                    new, skipped = a - F.col(name(i, p)) * F.col(name(p, j)) / d, a
                swept.append(F.when(F.col(f"_ok{p}"), new).otherwise(skipped).alias(name(i, j)))
        df = df.select(*others, *swept, *[f"_own{i}" for i in range(k)], *[f"_ok{i}" for i in range(p + 1)])
    ok = [F.col(f"_ok{i}") for i in range(k)]
    return df.select(
        *others, *[F.when(ok[i], F.col(name(i, k))).alias(f"_b{i}") for i in range(k)],
        *[(-F.col(name(i, j))).alias(f"_v{i}_{j}") for i in range(k) for j in range(i, k)],
        F.greatest(F.col(name(k, k)), F.lit(0.0)).alias("_rss"), sum((o.cast("int") for o in ok), F.lit(0)).alias("_rank"))


def inverse(i: int, j: int) -> Column:
    return F.col(f"_v{min(i, j)}_{max(i, j)}")


def quadratic(u: list[Column]) -> Column:
    """u' V u with the inverse V of ``solve``."""
    return sum((inverse(i, j) * a * b for i, a in enumerate(u) for j, b in enumerate(u)), F.lit(0.0))
