"""Registered queries: summaries and p-values of every published model (I-01, I-03, I-04, I-10, I-11),
median regression with standard errors (I-06)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from seqlab.operators import curves as C
from seqlab.operators import inference as I
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import register
from seqlab.plans.q_curves import valid_long
from seqlab.plans.q_inference import (_MED_PARTS, _adj_rows, _pooled_long, _valid_no0, adjusted_rows, beta_sql, contrast_rows, did_rows,
                                      rounded)
from seqlab.plans.q_sequences import N
from seqlab.plans.registry import query

PAIRS, POSITIONS, TARGETS = [(1, 10), (2, 11), (2, 12)], [1, 2, 10, 11, 12], [10, 11, 12]


def _models(long, prefix: str = ""):
    """Every answer in each saturated model it belongs to: model, experiment_mode, time_binary, y."""
    parts = [F.when(F.col("pos").isin(a, b), F.struct(F.lit(f"{prefix}did_{a}_{b}").alias("model"),
                                                      (F.col("pos") == b).cast("int").alias("time_binary"))) for a, b in PAIRS]
    parts += [F.when(F.col("pos") == p, F.struct(F.lit(f"{prefix}contrast_q{p}").alias("model"), F.lit(0).alias("time_binary")))
              for p in POSITIONS]
    rows = long.filter(F.col("pos").isin(*POSITIONS) & F.col("is_correct").isNotNull())
    return rows.select("experiment_mode", F.col("is_correct").cast("double").alias("y"),
                       F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))


# name of the model -> CTE prefix of its SQL
_DID = {f"did_{a}_{b}": f"did{a}{b}" for a, b in PAIRS} | {f"pooled_did_{a}_{b}": f"pool{a}{b}" for a, b in PAIRS}
_CONTRAST = {f"contrast_q{p}": f"cq{p}" for p in POSITIONS} | {f"pooled_contrast_q{p}": f"poolc{p}" for p in POSITIONS}
_ADJUSTED = {f"adjusted_q{t}": f"adj{t}" for t in TARGETS}

register("ms_obs", "ms_obs AS (" + " UNION ALL ".join(
    [f"SELECT '{m}' AS model, CAST(arm AS VARCHAR) AS arm, t, y FROM {c}_o" for m, c in _DID.items()]
    + [f"SELECT '{m}', CAST(arm AS VARCHAR), 0, y FROM {c}_o WHERE y IS NOT NULL" for m, c in _CONTRAST.items()]) + ")")
register("ms_sums", "ms_sums AS (SELECT model, SUM(n) AS n, COUNT(*) AS p, SUM(n * v) AS rss FROM (SELECT model, arm, t, COUNT(*) AS n, var_pop(y) AS v "
                    "FROM ms_obs GROUP BY model, arm, t) GROUP BY model "
                    + " ".join(f"UNION ALL SELECT '{m}', MAX(NN), MAX(GG + rnk), MAX(rss) FROM {c}_p HAVING COUNT(*) > 0" for m, c in _ADJUSTED.items()) + ")")
register("ms_total", "ms_total AS (SELECT model, var_pop(y) * COUNT(*) AS tss FROM ms_obs GROUP BY model "
                     + " ".join(f"UNION ALL SELECT '{m}', var_pop(y) * COUNT(*) FROM {c}_o HAVING COUNT(*) > 0" for m, c in _ADJUSTED.items()) + ")")
register("ms_fit", """ms_fit AS (
  SELECT *, (tss - rss) / NULLIF(p - 1, 0) / NULLIF(rss / NULLIF(n - p, 0), 0) AS f, 1 - rss / NULLIF(tss, 0) AS r2,
         CASE WHEN rss > 0 THEN -n / 2.0 * (ln(2 * pi() * rss / n) + 1) END AS ll
  FROM ms_sums JOIN ms_total USING (model))""")


@query("model_summaries", beta_sql("ms_b", """SELECT model AS id, (n - p) / 2.0 AS a, (p - 1) / 2.0 AS b,
    (n - p) / (n - p + greatest(f, 0) * (p - 1)) AS x, greatest(f, 0) * (p - 1) / (n - p + greatest(f, 0) * (p - 1)) AS rest
  FROM ms_fit WHERE f IS NOT NULL AND n > p AND p > 1""", """SELECT model, CAST(n AS BIGINT) AS n_obs, CAST(p - 1 AS BIGINT) AS df_model,
  CAST(n - p AS BIGINT) AS df_resid, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / NULLIF(n - p, 0), 6) AS adj_r2, round(f, 6) AS f_stat,
  round(b.p, 6) AS f_p, round(ll, 6) AS log_likelihood, round(2 * ms_fit.p - 2 * ll, 6) AS aic, round(ms_fit.p * ln(n) - 2 * ll, 6) AS bic
FROM ms_fit LEFT JOIN ms_b b ON b.id = model""".replace("p - 1 AS", "ms_fit.p - 1 AS").replace("n - p", "n - ms_fit.p")))
def model_summaries(spark, root):
    """I-11: n, df, R2, adjusted R2, F with its p, log-likelihood, AIC and BIC of the DiD, contrast, pooled and adjusted
    models: one aggregate for all saturated models of a cohort, one for each adjusted model."""
    cells = ["experiment_mode", "time_binary"]
    long = _valid_no0(spark, root)
    parts = [I.fit_stats(_models(long), cells, ["model"]), I.fit_stats(_models(_pooled_long(spark, root), "pooled_"), cells, ["model"])]
    parts += [I.adjusted_fit_stats(_adj_rows(long, t), f"q_{t}_corr", "q_1_corr", "q_2_corr").withColumn("model", F.lit(f"adjusted_q{t}"))
              for t in TARGETS]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return rounded(out, ("r2", "adj_r2", "f_stat", "f_p", "log_likelihood", "aic", "bic"))


register("mp_t", "mp_t AS (SELECT *, CASE WHEN se > 0 THEN coef / se END AS t FROM (SELECT model, term, coef, "
                 "sqrt(CASE WHEN dfree > 0 THEN rss / dfree END * vf) AS se, dfree FROM (" + " UNION ALL ".join(
                     [f"SELECT '{m}' AS model, * FROM ({did_rows(c)})" for m, c in _DID.items()]
                     + [f"SELECT '{m}', * FROM ({contrast_rows(c)})" for m, c in _CONTRAST.items()]
                     + [f"SELECT '{m}', * FROM ({adjusted_rows(c, 'q_1_corr', 'q_2_corr')})" for m, c in _ADJUSTED.items()]) + ")))")


@query("model_pvalues", beta_sql("mp_b", """SELECT model || '/' || term AS id, dfree / 2.0 AS a, 0.5 AS b, dfree / (dfree + t * t) AS x,
    t * t / (dfree + t * t) AS rest FROM mp_t WHERE t IS NOT NULL AND dfree > 0""", """SELECT model, term, round(coef, 6) AS coef, round(se, 6) AS se,
  round(t, 6) AS t, CAST(dfree AS BIGINT) AS df, round(p, 6) AS p FROM mp_t LEFT JOIN mp_b ON id = model || '/' || term"""))
def model_pvalues(spark, root):
    """I-11: coefficient, standard error, t and p of every term of the DiD, contrast, pooled and adjusted models."""
    long, parts = _valid_no0(spark, root), []
    for obs, base in ((_models(long), PL.P.baseline_arm), (_models(_pooled_long(spark, root), "pooled_"), 0)):
        did = F.col("model").contains("did")
        parts += [I.did(obs.filter(did), base, by=["model"]), I.contrast(obs.filter(~did), base, by=["model"])]
    parts += [I.adjusted_contrast(_adj_rows(long, t), PL.P.baseline_arm, f"q_{t}_corr", "q_1_corr", "q_2_corr").withColumn(
        "model", F.lit(f"adjusted_q{t}")) for t in TARGETS]
    return rounded(I.with_p(reduce(lambda a, b: a.unionByName(b), parts)), ("coef", "se", "t", "p"))


# I-06 with standard errors: kernel density of the residuals at 0, Hall and Sheather's bandwidth.
register("mr_y", "mr_y AS (" + " UNION ALL ".join(
    f"SELECT '{o}' AS outcome, experiment_mode, {v} AS y FROM vsteps_all WHERE pos = {p} AND {v} IS NOT NULL" for o, v, p in _MED_PARTS) + ")")
register("mr_c", "mr_c AS (SELECT outcome, experiment_mode, quantile_cont(y, 0.5) AS med, COUNT(*) AS n FROM mr_y GROUP BY outcome, experiment_mode)")
register("mr_e", "mr_e AS (SELECT outcome, y, y - med AS e FROM mr_y JOIN mr_c USING (outcome, experiment_mode))")
register("mr_h", """mr_h AS (
  SELECT *, least(sd, iqr / 1.34) * 2 * CASE WHEN h < 0.5 THEN list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(range(60), lambda i: h)),
      lambda z, g: z + (g - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(80),
        lambda k: z * exp(k * ln(greatest(z * z, 1e-300)) - (k * ln(2) + lgamma(k + 1.5) - lgamma(1.5)))))) / (exp(-z * z / 2) / sqrt(2 * pi()))) END AS width
  FROM (SELECT outcome, COUNT(*) AS NN, stddev_pop(y) AS sd, quantile_cont(e, 0.75) - quantile_cont(e, 0.25) AS iqr,
               pow(1.959963984540054, 2.0 / 3) * pow(1.5 / (2 * pi()), 1.0 / 3) * pow(COUNT(*), -1.0 / 3) AS h FROM mr_e GROUP BY outcome))""")
register("mr_f", """mr_f AS (
  SELECT outcome, NN, SUM(CASE WHEN abs(e / NULLIF(width, 0)) <= 1 THEN 0.75 * (1 - pow(e / width, 2)) ELSE 0 END) / NULLIF(NN * width, 0) AS f
  FROM mr_e JOIN mr_h USING (outcome) GROUP BY outcome, NN, width)""")
register("mr_t", """mr_t AS (
  SELECT *, CASE WHEN se > 0 THEN coef / se END AS t FROM (
    SELECT outcome, CASE WHEN isb THEN 'Intercept' ELSE 'arm[' || CAST(experiment_mode AS VARCHAR) || ']' END AS term,
           CASE WHEN isb THEN med ELSE med - b_med END AS coef, sqrt(1.0 / n + CASE WHEN isb THEN 0 ELSE 1.0 / b_n END) / (2 * NULLIF(f, 0)) AS se, NN - GG AS dfree
    FROM (SELECT *, experiment_mode = 1 AS isb, MAX(CASE WHEN experiment_mode = 1 THEN med END) OVER w AS b_med,
                 MAX(CASE WHEN experiment_mode = 1 THEN n END) OVER w AS b_n, COUNT(*) OVER w AS GG FROM mr_c WINDOW w AS (PARTITION BY outcome))
    JOIN mr_f USING (outcome)))""")


@query("median_regression", beta_sql("mr_b", """SELECT outcome || '/' || term AS id, dfree / 2.0 AS a, 0.5 AS b, dfree / (dfree + t * t) AS x,
    t * t / (dfree + t * t) AS rest FROM mr_t WHERE t IS NOT NULL AND dfree > 0""", """SELECT outcome, term, round(coef, 3) AS coef, round(se, 5) AS se,
  round(t, 5) AS t, CAST(dfree AS BIGINT) AS df, round(p, 6) AS p FROM mr_t LEFT JOIN mr_b ON id = outcome || '/' || term"""))
def median_regression(spark, root):
    """I-06: median regression of the step times on the arm, with kernel standard errors, t and p."""
    st = C.step_times(valid_long(spark, root), N).filter(F.col("pos").isin(10, 11, 12))
    pairs = F.array(
        F.struct(F.concat(F.lit("delta_q"), F.col("pos").cast("string")).alias("outcome"), F.col("delta").alias("x")),
        F.struct(F.when(F.col("pos") == 12, F.lit("acc_q12")).alias("outcome"), F.col("acc").alias("x")))
    stacked = st.select("experiment_mode", F.inline(pairs)).filter(F.col("outcome").isNotNull())
    m = I.median_regression(stacked, PL.P.baseline_arm, "x", by=["outcome"])
    return m.select("outcome", "term", F.round("coef", 3).alias("coef"), F.round("se", 5).alias("se"), F.round("t", 5).alias("t"), "df",
                    F.round("p", 6).alias("p"))
