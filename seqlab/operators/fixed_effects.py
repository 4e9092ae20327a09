"""Models with several fixed effects (I-08, I-09), fitted on collapsed tables.

The rows are read once, into a table of sums for each combination of levels (a
*cell*: e.g. section and user).  Taking the effects out of every variable is
a weighted least-squares problem in the effects alone.  The largest effect (the
*inner* one, e.g. users) is eliminated exactly, level by level; the others (the
*outer* ones) are found by conjugate gradients with a diagonal preconditioner,
for all variables at once.  An iteration joins the search direction to the
cells, sums it by inner level, and sums what is left by outer level: two
aggregates.  What iterates is the table of outer levels, written each time to
the shared folder; neither rows nor cells are rewritten.  The driver sees a few
scalars an iteration and k x k sums, never effects.

I-08 ``y ~ x1 + ... + xk | fe1 + fe2``: slopes from the cross-products of the
variables without effects (kept centred inside each cell, so nothing cancels).
Standard errors: iid, with N - k - (levels1 + levels2 - connected components of
the level graph) degrees of freedom; and clustered by the first effect, as the
published summary prints them, with the factor G / (G - 1) * (N - 1) / (N - K),
K = k + levels of the effect that is not nested in the clusters, and G - 1
degrees of freedom for t.

I-09 ``y ~ x1 + ... + xk | fe1 + ... + fem`` (logit): levels whose outcomes are all
equal are dropped, repeatedly; rows collapse to the combinations of levels and
regressor values; iteratively reweighted least squares, each round with the
weighted solver above.  Rounds that raise the deviance are halved.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.distributions import p_value, z_p_value
from seqlab.operators import normal as N
from seqlab.session import checkpoint_dir, written


def _cell_sums(variables: list[Column], weight: Column | None = None) -> list[Column]:
    """Aggregates of a cell: weight ``_w``, sums ``_s<v>`` and cross-products about the cell's means."""
    k = len(variables) - 1
    w = F.lit(1.0) if weight is None else weight
    out = [F.sum(w).alias("_w"), *[F.sum(w * v).alias(f"_s{i}") for i, v in enumerate(variables)]]
    for i in range(k + 1):
        for j in range(i, k + 1):
            a, b = variables[i], variables[j]
            if weight is None:
                inside = F.covar_pop(a, b) * F.count(F.lit(1))
            else:
                inside = F.sum(w * a * b) - F.try_divide(F.sum(w * a) * F.sum(w * b), F.sum(w))
            out.append(inside.alias(N.name(i, j)))
    return out


def _keyed(cells: DataFrame, outer: list[str]) -> DataFrame:
    """Cells with the key of each outer level: its effect's number and its value."""
    return cells.withColumns({f"_k{j}": F.concat(F.lit(f"{j}:"), F.col(c).cast("string")) for j, c in enumerate(outer)})


def _with_effects(cells: DataFrame, effects: DataFrame, outer: list[str], columns: list[str], out: str) -> DataFrame:
    """Add ``<out><v>``: the sum over the outer effects of the level's value in ``columns[v]``."""
    for j in range(len(outer)):
        own = effects.select(F.col("key").alias(f"_k{j}"), *[F.col(c).alias(f"_e{j}_{v}") for v, c in enumerate(columns)])
        cells = cells.join(own, f"_k{j}")
    added = cells.withColumns({f"{out}{v}": sum((F.col(f"_e{j}_{v}") for j in range(len(outer))), F.lit(0.0))
                               for v in range(len(columns))})
    return added.drop(*[f"_e{j}_{v}" for j in range(len(outer)) for v in range(len(columns))])


def _by_outer(cells: DataFrame, outer: list[str], values: list[Column], names: list[str]) -> DataFrame:
    """Sums of ``values`` by outer level."""
    return (cells.select(F.explode(F.array(*[f"_k{j}" for j in range(len(outer))])).alias("key"), *[v.alias(n) for v, n in zip(values, names)])
            .groupBy("key").agg(*[F.sum(n).alias(n) for n in names]))


def absorb(cells: DataFrame, inner: str, outer: list[str], k: int, tol: float = 1e-10, max_rounds: int = 500):
    """Effects of the k + 1 variables of a cell table (``_cell_sums`` by the levels of ``inner`` and ``outer``).

    Returns (outer effects: key, th<v>; inner effects: inner, t<v>; rounds).
    """
    m = range(k + 1)
    cells = _keyed(cells, outer)

    def without_inner(df: DataFrame, total: list[Column], names: list[str]) -> DataFrame:
        """Add ``names``: the weighted means of the inner level, from the cells' totals."""
        means = df.groupBy(inner).agg(*[F.try_divide(F.sum(t), F.sum("_w")).alias(n) for t, n in zip(total, names)])
        return df.join(means, inner)

    own = without_inner(cells, [F.col(f"_s{v}") for v in m], [f"_i{v}" for v in m])
    start = _by_outer(own, outer, [F.col("_w"), *[F.col(f"_s{v}") - F.col("_w") * F.col(f"_i{v}") for v in m]], ["d", *[f"r{v}" for v in m]])
    state = written(start.select("key", "d", *[F.lit(0.0).alias(f"th{v}") for v in m], *[f"r{v}" for v in m],
                                 *[F.try_divide(f"r{v}", "d").alias(f"p{v}") for v in m]), "effects")

    def total(df: DataFrame, values: list[Column]) -> list[float]:
        return [x or 0.0 for x in df.agg(*[F.sum(v).alias(f"x{i}") for i, v in enumerate(values)]).first()]

    size = total(state, [F.col(f"r{v}") * F.col(f"p{v}") for v in m])
    first, rounds = size, 0
    while any(s > (tol * tol) * f for s, f in zip(size, first)):
        if rounds == max_rounds:
            raise RuntimeError(f"the effects have not converged to {tol} in {max_rounds} rounds")
        along = _with_effects(cells, state, outer, [f"p{v}" for v in m], "_f")
        along = without_inner(along, [F.col("_w") * F.col(f"_f{v}") for v in m], [f"_i{v}" for v in m])
        moved = _by_outer(along, outer, [F.col("_w") * (F.col(f"_f{v}") - F.col(f"_i{v}")) for v in m], [f"q{v}" for v in m])
        state = written(state.join(moved, "key"), "effects")
        steep = total(state, [F.col(f"p{v}") * F.col(f"q{v}") for v in m])
        # a variable that is done (or that the effects explain fully) stays as it is
        step = [s / q if q > 0 and s > (tol * tol) * f else 0.0 for s, q, f in zip(size, steep, first)]
        state = state.select("key", "d", *[(F.col(f"th{v}") + step[v] * F.col(f"p{v}")).alias(f"th{v}") for v in m],
                             *[(F.col(f"r{v}") - step[v] * F.col(f"q{v}")).alias(f"r{v}") for v in m], *[f"p{v}" for v in m])
        new = total(state, [F.try_divide(F.col(f"r{v}") * F.col(f"r{v}"), F.col("d")) for v in m])
        turn = [b / a if a > 0 and s else 0.0 for a, b, s in zip(size, new, step)]
        state = state.select("key", "d", *[f"th{v}" for v in m], *[f"r{v}" for v in m], *[
            (F.try_divide(f"r{v}", "d") + turn[v] * F.col(f"p{v}")).alias(f"p{v}") for v in m])
        size, rounds = [n if s else 0.0 for n, s in zip(new, step)], rounds + 1
    found = written(state.select("key", *[f"th{v}" for v in m]), "outer-effects")
    left = _with_effects(cells, found, outer, [f"th{v}" for v in m], "_f")
    inside = left.groupBy(inner).agg(*[F.try_divide(F.sum(F.col(f"_s{v}") - F.col("_w") * F.col(f"_f{v}")), F.sum("_w")).alias(f"t{v}") for v in m])
    return found, written(inside, "inner-effects"), rounds


def _left_over(cells: DataFrame, outer_effects: DataFrame, inner_effects: DataFrame, inner: str, outer: list[str], k: int) -> DataFrame:
    """Cells with ``_m<v>``: the cell's mean of each variable without the effects."""
    df = _with_effects(_keyed(cells, outer), outer_effects, outer, [f"th{v}" for v in range(k + 1)], "_f").join(inner_effects, inner)
    return df.withColumns({f"_m{v}": F.try_divide(f"_s{v}", "_w") - F.col(f"_f{v}") - F.col(f"t{v}") for v in range(k + 1)})


def _cross(k: int) -> list[Column]:
    """Cross-products of the variables without effects, summed over cells."""
    return [F.sum(F.col(N.name(i, j)) + F.col("_w") * F.col(f"_m{i}") * F.col(f"_m{j}")).alias(N.name(i, j))
            for i in range(k + 1) for j in range(i, k + 1)]


def _solution(row, k: int):
    """(slopes with None where left out, the same with 0, inverse) of a row of ``N.solve``."""
    b = [row[f"_b{i}"] for i in range(k)]
    v = np.array([[row[f"_v{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return b, [x or 0.0 for x in b], v


def components(cells: DataFrame, a: str, b: str) -> int:
    """Number of connected components of the graph whose edges are the (a, b) pairs of ``cells``.

    Levels of ``a`` take the least label around (over shared levels of ``b``) and then
    their label's own label, so chains shrink by halves; every round is written.
    """
    edges = written(cells.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "edges")
    label = written(edges.groupBy("a").agg(F.min("a").alias("l")), "labels")
    while True:
        near = edges.join(label, "a").groupBy("b").agg(F.min("l").alias("l"))
        least = edges.join(near, "b").groupBy("a").agg(F.min("l").alias("l"))
        jump = least.join(label.select(F.col("a").alias("l"), F.col("l").alias("next")), "l")
        new = written(jump.select("a", F.least("l", "next").alias("l")), "labels")
        if new.join(label, "a").where(new["l"] != label["l"]).isEmpty():
            return label.select("l").distinct().count()
        label = new


def twoway_fe(df: DataFrame, y: str, xs: list[str], fe1: str, fe2: str, tol: float = 1e-10, max_rounds: int = 500) -> DataFrame:
    """I-08: slopes of y on ``xs`` absorbing two fixed effects, with iid and clustered (by ``fe1``) standard errors.

    Rows with a null in any of these columns are left out.  Columns: term, coef, se, t, df, p, se_cluster, t_cluster,
    p_cluster, n_clusters, n_obs, r2, r2_within.  A regressor that the effects or earlier ones explain has nulls.
    """
    k = len(xs)
    N.check(k)
    spark = df.sparkSession
    rows = df.select(F.col(fe1).alias("_o"), F.col(fe2).alias("_u"), *[F.col(c).cast("double").alias(f"_x{i}")
                                                                      for i, c in enumerate([*xs, y])]).na.drop()
    cells = written(rows.groupBy("_o", "_u").agg(*_cell_sums([F.col(f"_x{i}") for i in range(k + 1)])), "cells")
    raw = cells.agg(F.sum("_w").alias("n"), *[F.sum(f"_s{v}").alias(f"s{v}") for v in range(k + 1)]).first()
    if not raw["n"]:
        raise ValueError("no rows without nulls")
    n = raw["n"]
    outer_effects, inner_effects, _ = absorb(cells, "_u", ["_o"], k, tol, max_rounds)
    left = _left_over(cells, outer_effects, inner_effects, "_u", ["_o"], k)
    own = [F.sum(F.col(N.name(v, v)) + F.col("_w") * (F.try_divide(f"_s{v}", "_w") - raw[f"s{v}"] / n) ** 2).alias(f"_t{v}")
           for v in range(k + 1)]
    sums = left.agg(*_cross(k), *own, F.count_distinct("_o").alias("l1"), F.count_distinct("_u").alias("l2"))
    sums = sums.withColumn("_yy", F.col(N.name(k, k)))
    fit = N.solve(sums, k, [f"_t{i}" for i in range(k)]).first()
    b, slopes, v = _solution(fit, k)
    dfree = int(n - fit["_rank"] - (fit["l1"] + fit["l2"] - components(cells, "_o", "_u")))
    s2 = fit["_rss"] / dfree if dfree > 0 else None

    def inside(i):  # cross-product of regressor i with the residual, in a cell
        residual = F.col(f"_m{k}") - sum((F.lit(slopes[j]) * F.col(f"_m{j}") for j in range(k)), F.lit(0.0))
        return F.col(N.name(i, k)) - sum((F.lit(slopes[j]) * F.col(N.name(i, j)) for j in range(k)), F.lit(0.0)) + F.col("_w") * F.col(f"_m{i}") * residual

    scores = left.groupBy("_o").agg(*[F.sum(inside(i)).alias(f"g{i}") for i in range(k)])
    meat = scores.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}")
                                                     for i in range(k) for j in range(i, k)]).first()
    groups = meat["g"]
    middle = np.array([[meat[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    free = n - fit["_rank"] - fit["l2"]
    scale = groups / (groups - 1) * (n - 1) / free if groups > 1 and free > 0 else None
    clustered = np.diag(v @ middle @ v)
    out = []
    for i, x in enumerate(xs):
        known = b[i] is not None
        se = float(np.sqrt(s2 * v[i, i])) if known and s2 is not None else None
        sec = float(np.sqrt(max(scale * clustered[i], 0.0))) if known and scale is not None else None
        out.append((x, b[i], se, b[i] / se if se else None, dfree, sec, b[i] / sec if sec else None, groups, int(n),
                    1 - fit["_rss"] / fit[f"_t{k}"] if fit[f"_t{k}"] else None, 1 - fit["_rss"] / fit["_yy"] if fit["_yy"] else None))
    table = spark.createDataFrame(out, "term string, coef double, se double, t double, df long, se_cluster double, t_cluster double, "
                                       "n_clusters long, n_obs long, r2 double, r2_within double")
    return table.select("term", "coef", "se", "t", "df", p_value("t", "df").alias("p"), "se_cluster", "t_cluster",
                        p_value("t_cluster", F.col("n_clusters") - 1).alias("p_cluster"), "n_clusters", "n_obs", "r2", "r2_within")


def _varying(cells: DataFrame, fes: list[str]) -> DataFrame:
    """Cells (levels, rows ``_n``, ones ``_y``) without the levels whose outcomes are all equal, until none is left."""
    cells = written(cells, "cells")
    left = cells.count()
    while left:
        for fe in fes:
            ok = cells.groupBy(fe).agg(F.sum("_n").alias("_a"), F.sum("_y").alias("_b")).filter("_b > 0 and _b < _a").select(fe)
            cells = cells.join(ok, on=fe, how="left_semi")
        cells = written(cells, "cells")
        before, left = left, cells.count()
        if left == before:
            break
    return cells


def drop_separated(df: DataFrame, y: str, fes: list[str]):
    """Remove levels of any effect whose 0/1 outcomes are all equal, until none is left: (frame, number of removed rows).

    The search runs on counts by combination of levels; the rows are read twice.
    """
    counted = df.groupBy(*fes).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("long")).alias("_y"))
    cells = _varying(counted, fes)
    kept = cells.agg(F.sum("_n")).first()[0] or 0
    return df.join(cells.select(*fes), on=fes, how="left_semi"), df.count() - kept


def level_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Consecutive 0-based ids for the distinct values of ``col``, with DataFrame operators:
    ids within hash buckets of the values, after the number of values in earlier buckets."""
    size = max(1, int(df.select(F.count_distinct(col)).first()[0] ** 0.5))
    levels = df.select(col).distinct().withColumn("_b", F.pmod(F.xxhash64(col), F.lit(size)))
    within = Window.partitionBy("_b").orderBy(col)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # about the root of the number of levels
    offset = levels.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return levels.withColumn("_r", F.row_number().over(within) - 1).join(offset, "_b").select(
        col, (F.col("_o") + F.col("_r")).alias(out))


def fe_logit(df: DataFrame, y: str, xs: str | list[str], fes: list[str], tol: float = 1e-10, max_rounds: int = 50) -> DataFrame:
    """I-09: logit of the 0/1 outcome y on ``xs`` with fixed effects; the last of ``fes`` is the largest.

    Rows with a null are left out, and so are the rows of levels whose outcomes are all equal (``n_removed``).
    Columns: term, coef, se, z, p (iid), se_cluster, z_cluster, p_cluster (clustered by the first effect, with the factor
    G / (G - 1) * (N - 1) / (N - K), K = k + parameters of the other effects), n_obs, n_removed, deviance, iterations.
    """
    xs = [xs] if isinstance(xs, str) else list(xs)
    k, spark = len(xs), df.sparkSession
    N.check(k)
    checkpoint_dir(spark)
    names = [f"_o{j}" for j in range(len(fes))]
    outer, inner = names[:-1], names[-1]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(fes, names)], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(xs)],
                     F.col(y).cast("double").alias("_v")).na.drop()
    points = [f"_x{i}" for i in range(k)]
    whole = written(rows.groupBy(*names, *points).agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_y")), "points")
    kept = _varying(whole.groupBy(*names).agg(F.sum("_n").alias("_n"), F.sum("_y").alias("_y")), names)
    data = written(_keyed(whole.join(kept.select(*names), names, "left_semi"), outer), "points")
    n_all, n_obs = (t.agg(F.sum("_n")).first()[0] or 0 for t in (whole, data))
    if not n_obs:
        raise ValueError("every level has equal outcomes")
    scales = data.agg(*[F.sqrt(F.sum(F.col("_n") * F.col(p) * F.col(p)) / n_obs).alias(p) for p in points]).first()
    scale = [scales[p] or 1.0 for p in points]

    def at(b, outer_effects, inner_effects) -> DataFrame:
        """Points with the linear predictor ``_eta`` and the probability ``_p``."""
        eta = sum((F.lit(b[i]) * F.col(points[i]) for i in range(k)), F.lit(0.0))
        found = data
        if outer_effects is not None:
            found = _with_effects(found, outer_effects, outer, ["th"], "_f").join(inner_effects, inner)
            eta = eta + F.col("_f0") + F.col("t")
        return found.withColumn("_eta", eta).withColumn("_p", 1 / (1 + F.exp(-F.col("_eta"))))

    def deviance(found: DataFrame) -> Column:
        # -2 log-likelihood by the linear predictor, which does not overflow
        softplus = F.greatest(F.col("_eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta")))
        return F.sum(2 * (F.col("_n") * softplus - F.col("_y") * F.col("_eta")))

    b, effects, before, rounds = [0.0] * k, (None, None), None, 0
    while True:
        found = at(b, *effects)
        w = F.col("_n") * F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-12))
        found = found.withColumns({"_weight": w}).withColumn(
            "_z", F.col("_eta") + (F.col("_y") - F.col("_n") * F.col("_p")) / F.col("_weight"))
        variables = [*[F.col(points[i]) / scale[i] for i in range(k)], F.col("_z")]
        cells = written(found.groupBy(*names).agg(*_cell_sums(variables, F.col("_weight")), deviance(found).alias("_deviance")), "cells")
        now = cells.agg(F.sum("_deviance")).first()[0]
        if before is not None:
            if now > before * (1 + 1e-12) + 1e-9 and halved < 20:  # too long a step
                b = [(p + q) / 2 for p, q in zip(b, old_b)]
                effects, halved = _halfway(effects, old_effects, inner), halved + 1
                continue
            if abs(now - before) <= tol * (abs(now) + 0.1):
                break
        if rounds == max_rounds:
            raise RuntimeError(f"the logit has not converged in {max_rounds} rounds")
        outer_effects, inner_effects, _ = absorb(cells, inner, outer, k)
        left = _left_over(cells, outer_effects, inner_effects, inner, outer, k)
        fit = N.solve(left.agg(*_cross(k), *[F.sum(F.col(N.name(i, i)) + F.try_divide(F.col(f"_s{i}") ** 2, F.col("_w"))).alias(f"_t{i}")
                                              for i in range(k)]), k, [f"_t{i}" for i in range(k)]).first()
        slopes, filled, v = _solution(fit, k)
        old_b, old_effects, before, halved, rounds = b, effects, now, 0, rounds + 1
        b = [s / c for s, c in zip(filled, scale)]

        def combined(name):
            return F.col(f"{name}{k}") - sum((F.lit(filled[i]) * F.col(f"{name}{i}") for i in range(k)), F.lit(0.0))

        effects = (outer_effects.select("key", combined("th").alias("th")), inner_effects.select(inner, combined("t").alias("t")))

    # scores of the clusters, with the regressors without their weighted effects
    found = at(b, *effects).drop("t")
    found = _with_effects(found, outer_effects, outer, [f"th{i}" for i in range(k)], "_g").join(inner_effects, inner)
    residual = F.col("_y") - F.col("_n") * F.col("_p")
    score = [F.sum((F.col(points[i]) / scale[i] - F.col(f"_g{i}") - F.col(f"t{i}")) * residual).alias(f"g{i}") for i in range(k)]
    meat = found.groupBy(names[0]).agg(*score).agg(F.count(F.lit(1)).alias("g"), *[
        F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    levels = data.agg(*[F.count_distinct(n).alias(n) for n in names]).first()
    groups = meat["g"]
    free = n_obs - k - (sum(levels[n] for n in names[1:]) - (len(names) - 2))
    factor = groups / (groups - 1) * (n_obs - 1) / free if groups > 1 and free > 0 else None
    middle = np.array([[meat[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    clustered = np.diag(v @ middle @ v)
    out = []
    for i, x in enumerate(xs):
        known = slopes[i] is not None
        coef, se = (b[i], float(np.sqrt(v[i, i])) / scale[i]) if known else (None, None)
        sec = float(np.sqrt(max(factor * clustered[i], 0.0))) / scale[i] if known and factor is not None else None
        out.append((x, coef, se, coef / se if se else None, sec, coef / sec if sec else None, n_obs, n_all - n_obs, now, rounds))
    table = spark.createDataFrame(out, "term string, coef double, se double, z double, se_cluster double, z_cluster double, n_obs long, "
                                       "n_removed long, deviance double, iterations int")
    return table.select("term", "coef", "se", "z", z_p_value("z").alias("p"), "se_cluster", "z_cluster",
                        z_p_value("z_cluster").alias("p_cluster"), "n_obs", "n_removed", "deviance", "iterations")


def _halfway(new, old, inner: str):
    """Effects halfway to earlier ones (none: 0)."""
    if old[0] is None:
        return new[0].withColumn("th", F.col("th") / 2), new[1].withColumn("t", F.col("t") / 2)
    outer = new[0].join(old[0].withColumnRenamed("th", "_old"), "key").select("key", ((F.col("th") + F.col("_old")) / 2).alias("th"))
    return outer, new[1].join(old[1].withColumnRenamed("t", "_old"), inner).select(inner, ((F.col("t") + F.col("_old")) / 2).alias("t"))
