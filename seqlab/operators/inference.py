"""Experiment inference (I-01..I-12).

Spark computes sufficient statistics with one distributed aggregate per
model; every model here has a closed form in those statistics, so what is
left after the aggregate is a table with one row per arm (or per section),
finished with window expressions over that tiny table (``over ()`` on a
handful of rows) instead of a driver-side solver.

Conventions (statsmodels OLS defaults): homoskedastic standard errors,
residual degrees of freedom N - (number of coefficients).  Saturated models
(DiD, one-way contrasts) use cell means: the fitted values equal the cell
means, RSS = sum(n * var_pop) over cells and every coefficient is a +-1
combination of cell means, so its variance is s2 * sum(1/n) over the cells it
uses.  The covariate-adjusted model and the one-way fixed-effects model use
the within (Frisch-Waugh-Lovell) transformation: one aggregate of the k x k
within-group cross-products, solved in one row (``operators.normal``), for any
k below 20; a collinear regressor is left out.

Tables with several models at once carry them in ``by`` columns: one aggregate
serves all of them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlab.functions.distributions import f_p_value, normal_quantile_middle, p_value
from seqlab.operators import normal as N
from seqlab.operators.sections import SECTION_KEYS


def _all(by=()):
    """Window over the whole (tiny) table of a model: one row per arm or per level only."""
    return Window.partitionBy(*by)


def inv(c) -> Column:
    """1 / c, null when c is 0 (ANSI-safe)."""
    return F.try_divide(F.lit(1.0), c)


def _label(arm: str) -> Column:
    return F.col(arm).cast("string")


def did_observations(long: DataFrame, pre: int, post: int, value: str = "is_correct",
                     arm: str = "experiment_mode", drop: str = "observation",
                     keys: list[str] | None = None) -> DataFrame:
    """Q-24 + F-10: (arm, time_binary, y) with time 0 at ``pre`` and 1 at ``post``.
    ``drop='observation'`` drops null values one by one (statsmodels on the melted
    frame); ``'pair'`` drops a section row unless both values exist (I-02)."""
    x = long.filter(F.col("pos").isin(pre, post))
    if drop == "pair":
        keys = keys or SECTION_KEYS
        ok = x.groupBy(*keys).agg(F.count(value).alias("_c")).filter(F.col("_c") == 2).drop("_c")
        x = x.join(ok, on=keys, how="left_semi")
    x = x.filter(F.col(value).isNotNull())
    return x.select(F.col(arm), (F.col("pos") == post).cast("int").alias("time_binary"),
                    F.col(value).cast("double").alias("y"))


def _finish(rows: DataFrame, s2: Column, dfree: Column, by=()) -> DataFrame:
    se = F.sqrt(s2 * F.col("vf"))
    return rows.select(*by, "term", F.col("coef"), se.alias("se"),
                       F.when(se > 0, F.try_divide(F.col("coef"), se)).alias("t"), dfree.cast("long").alias("df"))


def with_p(rows: DataFrame) -> DataFrame:
    """I-11: a coefficient table with the two-sided p-value of every term."""
    return rows.withColumn("p", p_value("t", "df"))


def did(obs: DataFrame, baseline, arm: str = "experiment_mode", by: list[str] | None = None) -> DataFrame:
    """I-01: ``y ~ time_binary * C(arm, ref=baseline)`` by cell means, for each value of ``by``.
    Rows: term, coef, se, t, df."""
    by = by or []
    c = obs.groupBy(*by, arm).agg(
        F.count_if(F.col("time_binary") == 0).alias("n0"), F.count_if(F.col("time_binary") == 1).alias("n1"),
        F.avg(F.when(F.col("time_binary") == 0, F.col("y"))).alias("m0"),
        F.avg(F.when(F.col("time_binary") == 1, F.col("y"))).alias("m1"),
        F.var_pop(F.when(F.col("time_binary") == 0, F.col("y"))).alias("v0"),
        F.var_pop(F.when(F.col("time_binary") == 1, F.col("y"))).alias("v1"))
    isb = _label(arm) == F.lit(str(baseline))

    def ref(col):
        return F.max(F.when(isb, F.col(col))).over(_all(by))

    c = c.select("*", *[ref(x).alias(f"b_{x}") for x in ("n0", "n1", "m0", "m1")],
                 F.sum(F.col("n0") + F.col("n1")).over(_all(by)).alias("NN"),
                 F.sum(F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1")).over(_all(by)).alias("RSS"),
                 F.count(F.lit(1)).over(_all(by)).alias("GG"))
    lab = _label(arm)
    terms = F.when(isb, F.array(
        F.struct(F.lit("Intercept").alias("term"), F.col("m0").alias("coef"), (inv(F.col("n0"))).alias("vf")),
        F.struct(F.lit("time_binary").alias("term"), (F.col("m1") - F.col("m0")).alias("coef"),
                 (inv(F.col("n0")) + inv(F.col("n1"))).alias("vf")),
    )).otherwise(F.array(
        F.struct(F.concat(F.lit("arm["), lab, F.lit("]")).alias("term"), (F.col("m0") - F.col("b_m0")).alias("coef"),
                 (inv(F.col("n0")) + inv(F.col("b_n0"))).alias("vf")),
        F.struct(F.concat(F.lit("time_binary:arm["), lab, F.lit("]")).alias("term"),
                 ((F.col("m1") - F.col("m0")) - (F.col("b_m1") - F.col("b_m0"))).alias("coef"),
                 (inv(F.col("n0")) + inv(F.col("n1")) + inv(F.col("b_n0")) + inv(F.col("b_n1"))).alias("vf")),
    ))
    dfree = F.col("NN") - 2 * F.col("GG")
    rows = c.select(*by, F.explode(terms).alias("r"), "RSS", dfree.alias("dfree")).select(*by, "r.*", "RSS", "dfree")
    s2 = F.when(F.col("dfree") > 0, F.col("RSS") / F.col("dfree"))
    return _finish(rows, s2, F.col("dfree"), by)


def did_group_means(obs: DataFrame, baseline, arm: str = "experiment_mode") -> DataFrame:
    """I-02: group means before/after, their difference and the effect against the baseline arm."""
    g = obs.groupBy(arm).agg(F.avg(F.when(F.col("time_binary") == 0, F.col("y"))).alias("mean_pre"),
                             F.avg(F.when(F.col("time_binary") == 1, F.col("y"))).alias("mean_post"))
    g = g.withColumn("diff", F.col("mean_post") - F.col("mean_pre"))
    return g.withColumn("did_effect", F.col("diff") - F.max(F.when(_label(arm) == str(baseline), F.col("diff"))).over(_all()))


def contrast(obs: DataFrame, baseline, arm: str = "experiment_mode", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """I-03 / I-05: ``y ~ C(arm, ref=baseline)`` by group means, for each value of ``by``; df = N - G."""
    by = by or []
    c = obs.filter(F.col(y).isNotNull()).groupBy(*by, arm).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    isb = _label(arm) == F.lit(str(baseline))
    w = _all(by)
    c = c.select("*", F.max(F.when(isb, F.col("n"))).over(w).alias("b_n"), F.max(F.when(isb, F.col("m"))).over(w).alias("b_m"),
                 F.sum("n").over(w).alias("NN"), F.sum(F.col("n") * F.col("v")).over(w).alias("RSS"),
                 F.count(F.lit(1)).over(w).alias("GG"))
    term = F.when(isb, F.lit("Intercept")).otherwise(F.concat(F.lit("arm["), _label(arm), F.lit("]")))
    coef = F.when(isb, F.col("m")).otherwise(F.col("m") - F.col("b_m"))
    vf = F.when(isb, inv(F.col("n"))).otherwise(inv(F.col("n")) + inv(F.col("b_n")))
    dfree = F.col("NN") - F.col("GG")
    rows = c.select(*by, term.alias("term"), coef.alias("coef"), vf.alias("vf"), "RSS", dfree.alias("dfree"))
    return _finish(rows, F.when(F.col("dfree") > 0, F.col("RSS") / F.col("dfree")), F.col("dfree"), by)


def _regressor_terms(xs: tuple[str, ...]) -> list[Column]:
    return [F.struct(F.lit(x).alias("term"), F.col(f"_b{i}").alias("coef"),
                     F.when(F.col(f"_b{i}").isNotNull(), N.inverse(i, i)).alias("vf")) for i, x in enumerate(xs)]


def _arm_sums(rows: DataFrame, y: str, xs: tuple[str, ...], arm: str) -> DataFrame:
    """Per arm: n, means and within-arm cross-products of the rows without nulls; with the pooled solution beside them."""
    N.check(len(xs))
    d = rows.select(F.col(arm), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)],
                    F.col(y).cast("double").alias("_y")).na.drop()
    c = d.groupBy(arm).agg(*N.centred_sums([f"_x{i}" for i in range(len(xs))], "_y"))
    kept = [arm, "n", *[f"_m{i}" for i in range(len(xs) + 1)]]
    own = F.col(N.name(len(xs), len(xs))).alias("_yy")
    c = c.select(*kept, own, *[F.sum(a).over(_all()).alias(a) for a in N.names(len(xs))],
                 F.sum("n").over(_all()).alias("NN"), F.count(F.lit(1)).over(_all()).alias("GG"))
    return N.solve(c, len(xs))


def adjusted_contrast(rows: DataFrame, baseline, y: str, *xs: str, arm: str = "experiment_mode") -> DataFrame:
    """I-04: ``y ~ C(arm, ref=baseline) + x1 + ... + xk`` via within-arm centring.
    df = N - G - k; arm effect variance s2 (1/n_g + 1/n_b + d' S^-1 d)."""
    k = len(xs)
    c = _arm_sums(rows, y, xs, arm)
    isb = _label(arm) == F.lit(str(baseline))
    fitted = sum((F.coalesce(F.col(f"_b{i}"), F.lit(0.0)) * F.col(f"_m{i}") for i in range(k)), F.lit(0.0))
    c = c.withColumn("a", F.col(f"_m{k}") - fitted)
    for x in ("n", "a", *[f"_m{i}" for i in range(k)]):
        c = c.withColumn(f"b_{x}", F.max(F.when(isb, F.col(x))).over(_all()))
    dfree = F.col("NN") - F.col("GG") - F.col("_rank")
    apart = N.quadratic([F.col(f"_m{i}") - F.col(f"b__m{i}") for i in range(k)])
    terms = F.when(isb, F.array(
        F.struct(F.lit("Intercept").alias("term"), F.col("a").alias("coef"),
                 (inv(F.col("n")) + N.quadratic([F.col(f"_m{i}") for i in range(k)])).alias("vf")), *_regressor_terms(xs),
    )).otherwise(F.array(
        F.struct(F.concat(F.lit("arm["), _label(arm), F.lit("]")).alias("term"),
                 (F.col("a") - F.col("b_a")).alias("coef"), (inv(F.col("n")) + inv(F.col("b_n")) + apart).alias("vf"))))
    out = c.select(F.explode(terms).alias("r"), F.col("_rss").alias("RSS"), dfree.alias("dfree")).select("r.*", "RSS", "dfree")
    return _finish(out, F.when(F.col("dfree") > 0, F.col("RSS") / F.col("dfree")), F.col("dfree"))


def within_regressors(df: DataFrame, group: str, y: str, xs: list[str], extra_absorbed: int = 0) -> DataFrame:
    """I-07: slopes of y on ``xs`` with ``group`` fixed effects (exact one-way
    demeaning through group sums).  df = N - groups - k - extra_absorbed."""
    xs, k = tuple(xs), len(xs)
    N.check(k)
    g = df.select(group, *xs, y).na.drop(subset=[*xs, y]).groupBy(group).agg(*N.centred_sums([*xs], y))
    c = N.solve(g.agg(*[F.sum(a).alias(a) for a in N.names(k)], F.sum("n").alias("NN"), F.count(F.lit(1)).alias("GG")), k)
    dfree = F.col("NN") - F.col("GG") - F.col("_rank") - extra_absorbed
    rows = c.select(F.explode(F.array(*_regressor_terms(xs))).alias("r"), F.col("_rss").alias("RSS"), dfree.alias("dfree")).select(
        "r.*", "RSS", "dfree")
    return _finish(rows, F.when(F.col("dfree") > 0, F.col("RSS") / F.col("dfree")), F.col("dfree"))


def level_dummies(df: DataFrame, factor: str, baseline, prefix: str = "level") -> tuple[DataFrame, list[str], list]:
    """X-07: 0/1 columns for every level of ``factor`` but the baseline, in order: (frame, column names, levels).
    The levels are read from the data and must be fewer than 20."""
    found = [r[0] for r in df.select(factor).filter(F.col(factor).isNotNull()).distinct().limit(N.MOST + 1).collect()]
    levels = sorted(v for v in found if v != baseline)
    N.check(len(levels))
    names = [f"{prefix}{i}" for i in range(len(levels))]
    return df.withColumns({n: (F.col(factor) == F.lit(v)).cast("double") for n, v in zip(names, levels)}), names, levels


def median_contrast(rows: DataFrame, baseline, value: str, arm: str = "experiment_mode",
                    by: list[str] | None = None) -> DataFrame:
    """I-06: median regression on arm dummies only = differences of group medians
    (midpoint for even counts), per extra grouping ``by`` (e.g. outcome)."""
    from seqlab.operators.quantiles import exact_quantiles
    by = by or []
    g = exact_quantiles(rows, value, [*by, arm], (0.5,), ["med"], count_name="n")
    isb = _label(arm) == F.lit(str(baseline))
    g = g.withColumn("b_med", F.max(F.when(isb, F.col("med"))).over(_all(by)))
    return g.select(*by, F.when(isb, F.lit("Intercept")).otherwise(F.concat(F.lit("arm["), _label(arm), F.lit("]"))).alias("term"),
                    F.when(isb, F.col("med")).otherwise(F.col("med") - F.col("b_med")).alias("coef"), "n")


#: Published constants of the bandwidth (Hall and Sheather 1988) at the median, for a 95 % interval: the normal
#: quantile 1.959963984540054 to the power 2/3, times (1.5 phi(0)^2) to the power 1/3.
_HALL_SHEATHER = 1.959963984540054 ** (2 / 3) * (1.5 / (2 * 3.141592653589793)) ** (1 / 3)


def median_regression(rows: DataFrame, baseline, value: str, arm: str = "experiment_mode",
                      by: list[str] | None = None) -> DataFrame:
    """I-06 with standard errors: term, coef, se, t, df, p per ``by``.

    The density of the residuals at 0 comes from an Epanechnikov kernel: bandwidth
    min(sd(y), IQR(e) / 1.34) * 2 z, where P(0 < Z < z) is Hall and Sheather's h;
    one aggregate of kernel sums over the residuals.  se = sqrt(1/n_g + 1/n_b) / (2 f).
    Null values are ignored.  Null where the bandwidth or the density is 0.
    """
    from seqlab.operators.quantiles import exact_quantiles
    from seqlab.session import written
    by = by or []
    x = rows.select(*by, arm, F.col(value).cast("double").alias("_y")).filter(F.col("_y").isNotNull())
    cells = written(exact_quantiles(x, "_y", [*by, arm], (0.5,), ["med"], count_name="n"), "cell-medians")
    key = F.struct(*by, arm).alias("_k")  # a struct compares nulls as equal
    e = written(x.withColumn("_k", key).join(cells.select(key, "med"), "_k").select(
        *by, "_y", (F.col("_y") - F.col("med")).alias("_e")), "residuals")
    one = F.struct(*by).alias("_k") if by else F.lit(0).alias("_k")
    iqr = exact_quantiles(e, "_e", by, (0.25, 0.75), ["_q1", "_q3"], count_name="NN").select(one, "_q1", "_q3", "NN")
    sd = e.groupBy(*by).agg(F.stddev_pop("_y").alias("_sd")).select(one, "_sd")
    h = F.lit(_HALL_SHEATHER) * F.pow("NN", F.lit(-1.0 / 3))
    width = written(iqr.join(sd, "_k").select("_k", "NN", (F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / 1.34)
                                                           * 2 * normal_quantile_middle(h)).alias("_h")), "bandwidths")
    u = F.try_divide(F.col("_e"), F.col("_h"))
    kernel = F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(F.lit(0.0))
    density = (e.select(one, "_e").join(width, "_k").groupBy("_k", "NN", "_h").agg(F.sum(kernel).alias("_s"))
               .select("_k", "NN", F.try_divide(F.col("_s"), F.col("NN") * F.col("_h")).alias("_f")))
    isb = _label(arm) == F.lit(str(baseline))
    w = _all(by)
    c = cells.select("*", one, F.max(F.when(isb, F.col("med"))).over(w).alias("b_med"), F.max(F.when(isb, F.col("n"))).over(w).alias("b_n"),
                     F.count(F.lit(1)).over(w).alias("GG")).join(density, "_k")
    se = F.try_divide(F.sqrt(F.when(isb, inv(F.col("n"))).otherwise(inv(F.col("n")) + inv(F.col("b_n")))), 2 * F.col("_f"))
    coef = F.when(isb, F.col("med")).otherwise(F.col("med") - F.col("b_med"))
    out = c.select(*by, F.when(isb, F.lit("Intercept")).otherwise(F.concat(F.lit("arm["), _label(arm), F.lit("]"))).alias("term"),
                   coef.alias("coef"), se.alias("se"), F.when(se > 0, F.try_divide(coef, se)).alias("t"),
                   (F.col("NN") - F.col("GG")).cast("long").alias("df"))
    return with_p(out)


def _summary(s: DataFrame, by: list[str]) -> DataFrame:
    """n_obs, df, R2, adjusted R2, F with p, log-likelihood, AIC and BIC of rows with NN, params, RSS and TSS."""
    n, p = F.col("NN").cast("double"), F.col("params")
    r2 = 1 - F.try_divide(F.col("RSS"), F.col("TSS"))
    f = F.try_divide(F.try_divide(F.col("TSS") - F.col("RSS"), p - 1), F.try_divide(F.col("RSS"), n - p))
    ll = F.when(F.col("RSS") > 0, -n / 2 * (F.ln(2 * F.pi() * F.col("RSS") / n) + 1))
    return s.select(*by, F.col("NN").cast("long").alias("n_obs"), (p - 1).cast("long").alias("df_model"),
                    (F.col("NN") - p).cast("long").alias("df_resid"), r2.alias("r2"),
                    (1 - F.try_divide((1 - r2) * (n - 1), n - p)).alias("adj_r2"), f.alias("f_stat"),
                    f_p_value(f, p - 1, n - p).alias("f_p"), ll.alias("log_likelihood"),
                    (2 * p - 2 * ll).alias("aic"), (p * F.ln(n) - 2 * ll).alias("bic"))


def fit_stats(obs: DataFrame, cells: list[str] | None = None, by: list[str] | None = None, y: str = "y") -> DataFrame:
    """I-11: the summary of saturated models (one parameter for each cell), for each value of ``by``."""
    by, cells = by or [], cells or ["experiment_mode", "time_binary"]
    c = obs.filter(F.col(y).isNotNull()).groupBy(*by, *cells).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    c = c.withColumn("_grand", F.sum(F.col("n") * F.col("m")).over(_all(by)) / F.sum("n").over(_all(by)))
    s = c.groupBy(*by).agg(F.sum("n").alias("NN"), F.count(F.lit(1)).alias("params"), F.sum(F.col("n") * F.col("v")).alias("RSS"),
                           F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("_grand")) ** 2)).alias("TSS"))
    return _summary(s, by)


def adjusted_fit_stats(rows: DataFrame, y: str, *xs: str, arm: str = "experiment_mode") -> DataFrame:
    """I-11: the summary of a covariate-adjusted model (I-04)."""
    k = len(xs)
    c = _arm_sums(rows, y, xs, arm)
    c = c.withColumn("_grand", F.sum(F.col("n") * F.col(f"_m{k}")).over(_all()) / F.col("NN"))
    s = c.groupBy("NN", "GG", "_rank", "_rss").agg(F.sum(F.col("_yy") + F.col("n") * (F.col(f"_m{k}") - F.col("_grand")) ** 2).alias("TSS"))
    return _summary(s.select("NN", (F.col("GG") + F.col("_rank")).alias("params"), F.col("_rss").alias("RSS"), "TSS"), [])
