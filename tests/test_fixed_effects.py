"""Fixed-effects models against dense least squares and dense maximum likelihood."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import fixed_effects as E


def dummies(v, drop=0):
    return np.column_stack([v == k for k in sorted(set(v.tolist()))[drop:]]).astype(float)


def sandwich(scores, groups, bread):
    total = np.stack([scores[groups == g].sum(0) for g in sorted(set(groups.tolist()))])
    return bread @ (total.T @ total) @ bread


def panel(seed, n, sections, users, split=False):
    rng = np.random.default_rng(seed)
    s, u = rng.integers(0, sections, n), rng.integers(0, users, n)
    if split:  # two parts of the graph that no user connects
        u = u + users * (s % 2)
    x1 = rng.normal(size=n) + 0.2 * u
    x2 = (rng.random(n) < 0.4).astype(float)
    return rng, s, u, x1, x2


@pytest.mark.parametrize("sections, users, split", [(4, 15, False), (9, 12, True), (2, 40, False)])
def test_two_way_model_equals_dummies(spark, sections, users, split):
    rng, s, u, x1, x2 = panel(3, 320, sections, users, split)
    y = 2 * x1 - x2 + 0.3 * s + 0.1 * u + rng.normal(size=len(s)) * (1 + s)
    df = spark.createDataFrame([(int(a), f"u{b}", float(c), float(d), float(e)) for a, b, c, d, e in zip(s, u, y, x1, x2)]
                               + [(None, "u0", 1.0, 1.0, 1.0), (1, "u1", None, 1.0, 1.0)], "s int, u string, y double, x1 double, x2 double")
    got = {r["term"]: r for r in E.twoway_fe(df, "y", ["x1", "x2"], "s", "u").collect()}
    D = np.column_stack([x1, x2, dummies(s), dummies(u, 1)])
    rank = np.linalg.matrix_rank(D)
    beta = np.linalg.lstsq(D, y, rcond=None)[0]
    e = y - D @ beta
    Z = D[:, 2:]
    X = D[:, :2] - Z @ np.linalg.lstsq(Z, D[:, :2], rcond=None)[0]
    bread = np.linalg.inv(X.T @ X)
    dfree, n, groups = len(y) - rank, len(y), len(set(s.tolist()))
    se = np.sqrt(np.diag(bread) * (e @ e) / dfree)
    scale = groups / (groups - 1) * (n - 1) / (n - 2 - len(set(u.tolist())))
    sec = np.sqrt(np.diag(sandwich(X * e[:, None], s, bread)) * scale)
    within = y - Z @ np.linalg.lstsq(Z, y, rcond=None)[0]
    for k, x in enumerate(["x1", "x2"]):
        r = got[x]
        assert r["coef"] == pytest.approx(beta[k], abs=1e-8) and r["se"] == pytest.approx(se[k], rel=1e-7)
        assert r["se_cluster"] == pytest.approx(sec[k], rel=1e-6)
        assert (r["df"], r["n_obs"], r["n_clusters"]) == (dfree, n, groups)
        assert r["r2"] == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum()) and r["r2_within"] == pytest.approx(1 - e @ e / (within @ within))


def test_regressors_that_effects_or_others_explain_are_left_out(spark):
    rng, s, u, x1, x2 = panel(5, 200, 3, 10)
    y = x1 + rng.normal(size=200)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d), float(b * 2.0), float(d - 1 + a)) for a, b, c, d in zip(s, u, y, x1)],
                               "s int, u int, y double, x1 double, by_user double, twin double")
    got = {r["term"]: r for r in E.twoway_fe(df, "y", ["x1", "by_user", "twin"], "s", "u").collect()}
    alone = E.twoway_fe(df, "y", ["x1"], "s", "u").first()
    assert got["by_user"]["coef"] is None and got["twin"]["coef"] is None
    assert got["x1"]["coef"] == pytest.approx(alone["coef"]) and got["x1"]["df"] == alone["df"]


def test_effects_that_have_not_converged_are_an_error(spark):
    rng, s, u, x1, x2 = panel(5, 200, 6, 10)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(s, u, x1, x2)], "s int, u int, y double, x double")
    with pytest.raises(RuntimeError):
        E.twoway_fe(df, "y", ["x"], "s", "u", max_rounds=1)


def test_rows_are_read_once_and_iterations_rewrite_levels_only(spark, monkeypatch):
    rng, s, u, x1, x2 = panel(5, 400, 5, 10)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(s, u, x1, x2)], "s int, u int, y double, x double")
    read = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (read.add(1), r)[1]).toDF(df.schema)
    sizes = []
    keep = E.written
    monkeypatch.setattr(E, "written", lambda t, label: (lambda w: (sizes.append((label, w.count())), w)[1])(keep(t, label)))
    E.twoway_fe(counted, "y", ["x"], "s", "u").collect()
    assert read.value == 400
    assert [n for label, n in sizes if label == "effects"] and all(n == 5 for label, n in sizes if label == "effects")


@pytest.mark.parametrize("chain", [1, 2, 37])
def test_components_of_chains_and_islands(spark, chain):
    rows = [(f"s{i}", f"u{i}") for i in range(chain)] + [(f"s{i + 1}", f"u{i}") for i in range(chain)] + [("x", "y"), ("x", "z")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert E.components(df, "a", "b") == 2


def dense_logit(X, y, rounds=60):
    b = np.zeros(X.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.lstsq(X.T @ (X * (p * (1 - p))[:, None]), X.T @ (y - p), rcond=None)[0]
    return b, 1 / (1 + np.exp(-X @ b))


@pytest.mark.parametrize("k", [1, 2])
def test_logit_equals_dense_maximum_likelihood(spark, k):
    rng = np.random.default_rng(5)
    n = 700
    d, s, u = rng.integers(1, 4, n), rng.integers(0, 3, n), rng.integers(0, 12, n)
    x = np.column_stack([np.round(rng.exponential(30, n)), rng.normal(size=n)])[:, :k]
    eta = 0.5 - 0.02 * x[:, 0] + 0.3 * d - 0.2 * s + 0.1 * u + (0.4 * x[:, 1] if k == 2 else 0)
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    y[u == 0] = 1.0  # a separated user
    names = [f"g{i}" for i in range(k)]
    df = spark.createDataFrame([(int(a), *map(float, g), int(b), int(c), int(e)) for a, g, b, c, e in zip(y, x, d, s, u)] + [(None, *([1.0] * k), 1, 1, 1)],
                               ", ".join(["y int", *(f"{c} double" for c in names), "d int", "s int", "u int"]))
    got = {r["term"]: r for r in E.fe_logit(df, "y", names, ["d", "s", "u"]).collect()}
    ok = u != 0
    x, y, d, s, u = x[ok], y[ok], d[ok], s[ok], u[ok]
    X = np.column_stack([x, dummies(u), dummies(d, 1), dummies(s, 1)])
    b, p = dense_logit(X, y)
    w = p * (1 - p)
    cov = np.linalg.pinv(X.T @ (X * w[:, None]))
    root = np.sqrt(w)[:, None]
    Z = X[:, k:] * root
    left = X[:, :k] - (X[:, k:] @ np.linalg.lstsq(Z, X[:, :k] * root, rcond=None)[0])
    bread = np.linalg.inv(left.T @ (left * w[:, None]))
    n = len(y)
    scale = 3 / 2 * (n - 1) / (n - k - (3 + 11 - 1))
    sec = np.sqrt(np.diag(sandwich(left * (y - p)[:, None], d, bread)) * scale)
    dev = -2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    for i, c in enumerate(names):
        r = got[c]
        assert r["coef"] == pytest.approx(b[i], rel=1e-6) and r["se"] == pytest.approx(np.sqrt(cov[i, i]), rel=1e-6)
        assert r["se_cluster"] == pytest.approx(sec[i], rel=1e-5)
        assert r["z"] == pytest.approx(b[i] / np.sqrt(cov[i, i]), rel=1e-6) and 0 <= r["p"] <= 1
        assert (r["n_obs"], r["n_removed"]) == (n, int((~ok).sum())) and r["deviance"] == pytest.approx(dev, rel=1e-8)


def test_logit_of_separated_levels_only_is_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, 1, 1), (0, 2.0, 2, 2)], "y int, g double, s int, u int")
    with pytest.raises(ValueError):
        E.fe_logit(df, "y", "g", ["s", "u"])


def test_separated_levels_are_dropped_to_the_fixed_point(spark):
    """A chain in which every removed level separates the next one: nothing of it may stay."""
    rows = []
    for i in range(36):  # user i holds a 0 of section i and a 1 of section i + 1; the first section has only zeros
        rows += [(f"s{i}", f"u{i}", 0), (f"s{i + 1}", f"u{i}", 1)]
    rows += [("a", "v", 0), ("a", "v", 1), ("a", "w", 1), ("a", "w", 0)]
    df = spark.createDataFrame(rows, "section string, user string, y int")
    left, removed = E.drop_separated(df, "y", ["section", "user"])
    assert removed == 72 and {r["section"] for r in left.collect()} == {"a"}


def test_level_index_is_consecutive(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(60)], "y double")
    assert sorted(r["i"] for r in E.level_index(df, "y", "i").select(F.col("i")).collect()) == list(range(5))
