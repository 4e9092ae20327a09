"""Closed-form models against dense least squares (numpy) on random data."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import inference as I


def ols(X, y):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    dfree = len(y) - X.shape[1]
    s2 = resid @ resid / dfree
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    return beta, se, dfree


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 240
    arm = rng.choice([1, 2, 3], n)
    t = rng.integers(0, 2, n)
    y = (rng.random(n) < 0.4 + 0.1 * arm * t).astype(float)
    x1 = rng.integers(0, 2, n).astype(float)
    x2 = rng.integers(0, 2, n).astype(float)
    return arm, t, y, x1, x2


def test_did_equals_ols(spark, data):
    arm, t, y, _, _ = data
    obs = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(arm, t, y)],
                                "experiment_mode int, time_binary int, y double")
    got = {r["term"]: r for r in I.did(obs, 1).collect()}
    d2, d3 = (arm == 2).astype(float), (arm == 3).astype(float)
    X = np.column_stack([np.ones_like(y), t, d2, d3, t * d2, t * d3])
    beta, se, dfree = ols(X, y)
    names = ["Intercept", "time_binary", "arm[2]", "arm[3]", "time_binary:arm[2]", "time_binary:arm[3]"]
    for k, nm in enumerate(names):
        assert got[nm]["coef"] == pytest.approx(beta[k], abs=1e-9)
        assert got[nm]["se"] == pytest.approx(se[k], rel=1e-9)
        assert got[nm]["df"] == dfree


def test_contrast_equals_ols(spark, data):
    arm, _, y, _, _ = data
    obs = spark.createDataFrame([(int(a), float(c)) for a, c in zip(arm, y)], "experiment_mode int, y double")
    got = {r["term"]: r for r in I.contrast(obs, 1).collect()}
    X = np.column_stack([np.ones_like(y), (arm == 2), (arm == 3)]).astype(float)
    beta, se, dfree = ols(X, y)
    for k, nm in enumerate(["Intercept", "arm[2]", "arm[3]"]):
        assert got[nm]["coef"] == pytest.approx(beta[k], abs=1e-9)
        assert got[nm]["se"] == pytest.approx(se[k], rel=1e-9)


def test_adjusted_contrast_equals_ols(spark, data):
    arm, _, y, x1, x2 = data
    rows = spark.createDataFrame([(int(a), float(c), float(d), float(e)) for a, c, d, e in zip(arm, y, x1, x2)],
                                 "experiment_mode int, y double, x1 double, x2 double")
    got = {r["term"]: r for r in I.adjusted_contrast(rows, 1, "y", "x1", "x2").collect()}
    X = np.column_stack([np.ones_like(y), (arm == 2), (arm == 3), x1, x2]).astype(float)
    beta, se, dfree = ols(X, y)
    for k, nm in enumerate(["Intercept", "arm[2]", "arm[3]", "x1", "x2"]):
        assert got[nm]["coef"] == pytest.approx(beta[k], abs=1e-9)
        assert got[nm]["se"] == pytest.approx(se[k], rel=1e-8)
        assert got[nm]["df"] == dfree


def test_within_fe_equals_dummies(spark, data):
    arm, _, y, x1, x2 = data
    rows = spark.createDataFrame([(int(a), float(c), float(d), float(e)) for a, c, d, e in zip(arm, y, x1, x2)],
                                 "g int, y double, x1 double, x2 double")
    got = {r["term"]: r for r in I.within_regressors(rows, "g", "y", ["x1", "x2"]).collect()}
    X = np.column_stack([x1, x2, (arm == 1), (arm == 2), (arm == 3)]).astype(float)
    beta, se, dfree = ols(X, y)
    assert got["x1"]["coef"] == pytest.approx(beta[0], abs=1e-9)
    assert got["x2"]["se"] == pytest.approx(se[1], rel=1e-8)
    assert got["x1"]["df"] == dfree


def test_median_contrast(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, 5.0)], "experiment_mode int, v double")
    got = {r["term"]: r["coef"] for r in I.median_contrast(df, 1, "v").collect()}
    assert got == {"Intercept": 2.5, "arm[2]": 2.5}


@pytest.fixture(scope="module")
def wide():
    """Three arms and four regressors, the last one a combination of two others."""
    rng = np.random.default_rng(11)
    n = 300
    arm = rng.choice([1, 2, 3], n)
    x = np.column_stack([rng.normal(100, 1, n), rng.integers(0, 2, n), rng.exponential(1, n)])
    x = np.column_stack([x, x[:, 0] - 2 * x[:, 2]])
    y = 0.3 * arm + x @ [0.5, -1, 2, 0] + rng.normal(size=n)
    return arm, x, y


def _wide_rows(spark, wide):
    arm, x, y = wide
    return spark.createDataFrame([(int(a), float(c), *map(float, r)) for a, c, r in zip(arm, y, x)],
                                 "experiment_mode int, y double, x1 double, x2 double, x3 double, x4 double")


def test_adjusted_contrast_with_many_regressors_equals_ols(spark, wide):
    arm, x, y = wide
    got = {r["term"]: r for r in I.adjusted_contrast(_wide_rows(spark, wide), 1, "y", "x1", "x2", "x3", "x4").collect()}
    X = np.column_stack([np.ones_like(y), (arm == 2), (arm == 3), x[:, :3]]).astype(float)
    beta, se, dfree = ols(X, y)
    for k, nm in enumerate(["Intercept", "arm[2]", "arm[3]", "x1", "x2", "x3"]):
        assert got[nm]["coef"] == pytest.approx(beta[k], abs=1e-7)
        assert got[nm]["se"] == pytest.approx(se[k], rel=1e-6)
        assert got[nm]["df"] == dfree
    assert got["x4"]["coef"] is None and got["x4"]["se"] is None  # a combination of the others is left out


def test_within_regressors_of_a_four_level_factor_equal_dummies(spark):
    rng = np.random.default_rng(4)
    n = 400
    level, group = rng.integers(1, 5, n), rng.integers(0, 6, n)
    y = 0.4 * level * (level - 2) + group + rng.normal(size=n)
    rows = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(level, group, y)] + [(None, 0, 1.0)], "level int, g int, y double")
    rows, xs, levels = I.level_dummies(rows, "level", 1)
    assert levels == [2, 3, 4]
    got = {r["term"]: r for r in I.within_regressors(rows, "g", "y", xs).collect()}
    X = np.column_stack([(level == v) for v in (2, 3, 4)] + [(group == v) for v in range(6)]).astype(float)
    beta, se, dfree = ols(X, y)
    for k, nm in enumerate(xs):
        assert got[nm]["coef"] == pytest.approx(beta[k], abs=1e-9)
        assert got[nm]["se"] == pytest.approx(se[k], rel=1e-8) and got[nm]["df"] == dfree


def test_too_many_regressors_are_an_error(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(40)], "level int, y double")
    with pytest.raises(ValueError):
        I.level_dummies(df, "level", 1)


def test_summaries_equal_ols(spark, wide, data):
    arm, x, y = wide
    X = np.column_stack([np.ones_like(y), (arm == 2), (arm == 3), x[:, :3]]).astype(float)
    beta, _, dfree = ols(X, y)
    rss, tss, n, p = ((y - X @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum(), len(y), X.shape[1]
    got = I.adjusted_fit_stats(_wide_rows(spark, wide), "y", "x1", "x2", "x3", "x4").first()
    ll = -n / 2 * (np.log(2 * np.pi * rss / n) + 1)
    f = (tss - rss) / (p - 1) / (rss / dfree)
    want = {"n_obs": n, "df_model": p - 1, "df_resid": dfree, "r2": 1 - rss / tss, "adj_r2": 1 - rss / tss * (n - 1) / dfree, "f_stat": f,
            "log_likelihood": ll, "aic": 2 * p - 2 * ll, "bic": p * np.log(n) - 2 * ll}
    for name, v in want.items():
        assert got[name] == pytest.approx(v, rel=1e-7), name
    arm, t, y, _, _ = data
    obs = spark.createDataFrame([(m, int(a), int(b), float(c) + m) for m in (0, 5) for a, b, c in zip(arm, t, y)],
                                "model int, experiment_mode int, time_binary int, y double")
    X = np.column_stack([np.ones_like(y), t, arm == 2, arm == 3, t * (arm == 2), t * (arm == 3)]).astype(float)
    beta, _, dfree = ols(X, y)
    rss, tss = ((y - X @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    for r in I.fit_stats(obs, by=["model"]).collect():
        assert r["r2"] == pytest.approx(1 - rss / tss) and r["df_resid"] == dfree
        assert r["f_stat"] == pytest.approx((tss - rss) / 5 / (rss / dfree))


def test_models_side_by_side_equal_single_ones(spark, data):
    arm, t, y, _, _ = data
    obs = spark.createDataFrame([(m, int(a), int(b), float(c) * (m + 1)) for m in (0, 1) for a, b, c in zip(arm, t, y)],
                                "pair int, experiment_mode int, time_binary int, y double")
    both = I.did(obs, 1, by=["pair"]).collect()
    for m in (0, 1):
        alone = sorted(I.did(obs.filter(f"pair = {m}").drop("pair"), 1).collect())
        for r, one in zip(sorted(tuple(r)[1:] for r in both if r["pair"] == m), alone, strict=True):
            assert r[0] == one[0] and r[1:] == pytest.approx(tuple(one)[1:], rel=1e-12)


def test_median_regression_errors_equal_the_published_formulas(spark):
    """Against a direct computation of the kernel estimate with Hall and Sheather's bandwidth."""
    from statistics import NormalDist
    rng = np.random.default_rng(2)
    rows = [(o, int(a), float(rng.exponential(10 + 3 * a)) if o == "e" else float(rng.integers(0, 9))) for o in "ei" for a in rng.choice([1, 2, 3], 151)]
    df = spark.createDataFrame(rows + [("e", 1, None)], "outcome string, experiment_mode int, v double")
    got = {(r["outcome"], r["term"]): r for r in I.median_regression(df, 1, "v", by=["outcome"]).collect()}
    assert len(got) == 6
    for o in "ei":
        arm, y = (np.array([r[k] for r in rows if r[0] == o]) for k in (1, 2))
        med = {a: np.median(y[arm == a]) for a in (1, 2, 3)}
        e = y - np.array([med[a] for a in arm])
        n, nd = len(y), NormalDist()
        h = n ** (-1 / 3) * nd.inv_cdf(0.975) ** (2 / 3) * (1.5 * nd.pdf(0) ** 2) ** (1 / 3)
        iqr = np.quantile(e, 0.75) - np.quantile(e, 0.25)
        width = min(y.std(), iqr / 1.34) * (nd.inv_cdf(0.5 + h) - nd.inv_cdf(0.5 - h))
        u = e / width
        f = np.where(np.abs(u) <= 1, 0.75 * (1 - u * u), 0).sum() / (n * width)
        for a in (1, 2, 3):
            r = got[(o, "Intercept" if a == 1 else f"arm[{a}]")]
            var = 1 / (arm == a).sum() + (1 / (arm == 1).sum() if a > 1 else 0)
            assert r["coef"] == pytest.approx(med[a] - (med[1] if a > 1 else 0))
            assert r["se"] == pytest.approx(0.5 / f * np.sqrt(var), rel=1e-9) and r["df"] == n - 3
            assert 0 <= r["p"] <= 1


def test_probabilities(spark):
    import math
    from seqlab.functions import distributions as D
    rows = [(2.228138852, 10.0), (0.0, 5.0), (1.959963985, 1e7), (-2.0, 1e12), (1.0, 1.0), (None, 3.0), (1.0, 0.0)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, df double").select(D.p_value("t", "df").alias("p")).collect()]
    want = [0.05, 1.0, 0.05, math.erfc(2 / math.sqrt(2)), 0.5]
    assert got[:5] == pytest.approx(want, abs=1e-7) and got[5:] == [None, None]
    f = spark.createDataFrame([(4.964602744, 1.0, 10.0), (3.0, 2.0, 8.0), (0.0, 3.0, 9.0), (1e4, 2.0, 50.0)], "f double, a double, b double")
    got = [r.p for r in f.select(D.f_p_value("f", "a", "b").alias("p")).collect()]
    # with two degrees of freedom above, the tail is (1 + 2 f / b) ** (-b / 2)
    assert got == pytest.approx([0.05, (1 + 6 / 8) ** -4, 1.0, (1 + 2e4 / 50) ** -25], abs=1e-8)
    z = [0.0, 0.5, 2.99, 3.01, 8.0, -1.959963985]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(D.z_p_value("z").alias("p")).collect()]
    assert got == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z], rel=1e-10, abs=1e-15)
    h = [0.0, 0.1, 0.4, 0.49, 0.4999, 0.5]
    got = [r.z for r in spark.createDataFrame([(v,) for v in h], "h double").select(D.normal_quantile_middle(F.col("h")).alias("z")).collect()]
    assert [math.erf(v / math.sqrt(2)) / 2 for v in got[:5]] == pytest.approx(h[:5], abs=1e-12) and got[5] is None
