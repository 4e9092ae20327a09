"""Registered queries: DiD, contrasts, adjusted and median contrasts, fixed effects (I-01..I-12)."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.timecols import seconds_between
from seqlab.operators import curves as C
from seqlab.operators import inference as I
from seqlab.operators import sequences as S
from seqlab.operators.sections import SECTION_KEYS
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import register, with_ctes
from seqlab.plans.q_curves import valid_long, wlong
from seqlab.plans.q_sequences import N, frames
from seqlab.plans.registry import query

MODEL_COLS = ["term", "coef", "se", "t", "df"]


def rounded(df, cols=("coef", "se", "t"), digits: int = 6):
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _fin(rows: str, digits: int = 6) -> str:
    d = digits
    return (f"SELECT term, round(coef, {d}) AS coef, round(se, {d}) AS se, round(CASE WHEN se > 0 THEN coef / se END, {d}) AS t, "
            f"CAST(dfree AS BIGINT) AS df FROM (SELECT term, coef, sqrt(CASE WHEN dfree > 0 THEN rss / dfree END * vf) AS se, "
            f"dfree FROM ({rows}))")


def beta_sql(name: str, src: str, select: str, steps: int = 100) -> str:
    """``select`` with a table ``name`` (id, p) beside it: p is the regularised incomplete beta function of the rows
    (id, a, b, x, rest = 1 - x) of ``src``, by its continued fraction in the form of the three-term recurrence of convergents."""
    register(f"{name}_i", f"""{name}_i AS (
  SELECT id, swap, CASE WHEN swap THEN b ELSE a END AS a, CASE WHEN swap THEN a ELSE b END AS b, CASE WHEN swap THEN rest ELSE x END AS x,
         exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(rest)) AS front
  FROM (SELECT id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(x AS DOUBLE) AS x, CAST(rest AS DOUBLE) AS rest,
               x >= (a + 1) / (a + b + 2) AS swap FROM ({src})) WHERE x > 0 AND rest > 0)""")
    # A_n / B_n -> 1 / (1 + d1 / (1 + d2 / ...)); rescaled every step
    register(f"{name}_r", f"""{name}_r AS (
  SELECT id, swap, a, b, x, front, 0 AS n, CAST(0 AS DOUBLE) AS a0, CAST(1 AS DOUBLE) AS a1, CAST(1 AS DOUBLE) AS b0, CAST(1 AS DOUBLE) AS b1 FROM {name}_i
  UNION ALL
  SELECT id, swap, a, b, x, front, n + 1, a1 / s, (a1 + d * a0) / s, b1 / s, (b1 + d * b0) / s FROM (
    SELECT *, b1 + d * b0 AS s FROM (
      SELECT *, CASE WHEN (n + 1) % 2 = 1 THEN -(a + n // 2) * (a + b + n // 2) * x / ((a + n) * (a + n + 1))
                     ELSE ((n + 1) // 2) * (b - (n + 1) // 2) * x / ((a + n) * (a + n + 1)) END AS d FROM {name}_r WHERE n < {2 * steps})))""")
    register(name, f"""{name} AS (
  SELECT id, CASE WHEN swap THEN 1 - front * a1 / b1 / a ELSE front * a1 / b1 / a END AS p FROM {name}_r WHERE n = {2 * steps}
  UNION ALL SELECT id, CASE WHEN x <= 0 THEN 0 ELSE 1 END FROM ({src}) WHERE x <= 0 OR rest <= 0)""")
    return with_ctes(select).replace("WITH ", "WITH RECURSIVE ", 1)


def did_p_sql(name: str, source: str) -> str:
    """The DiD table of ``did_sql(source, ...)`` with p-values."""
    rows = did_rows(source)
    register(f"{name}_t", f"""{name}_t AS (SELECT *, CASE WHEN se > 0 THEN coef / se END AS t FROM (
    SELECT term, coef, sqrt(CASE WHEN dfree > 0 THEN rss / dfree END * vf) AS se, dfree FROM ({rows})))""")
    return beta_sql(f"{name}_b", f"SELECT term AS id, dfree / 2 AS a, 0.5 AS b, dfree / (dfree + t * t) AS x, t * t / (dfree + t * t) AS rest "
                                 f"FROM {name}_t WHERE t IS NOT NULL AND dfree > 0",
                    f"SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 6) AS t, CAST(dfree AS BIGINT) AS df, round(p, 6) AS p "
                    f"FROM {name}_t LEFT JOIN {name}_b ON id = term")


def did_sql(name: str, obs: str, base: str) -> str:
    """Saturated DiD in SQL; ``obs`` yields (arm, t, y); ``base`` is the baseline label."""
    register(f"{name}_o", f"{name}_o AS ({obs})")
    refs = ", ".join(f"MAX(CASE WHEN CAST(arm AS VARCHAR) = '{base}' THEN {x} END) OVER () AS b_{x}"
                     for x in ("n0", "n1", "m0", "m1"))
    register(f"{name}_c", f"""{name}_c AS (
  SELECT *, {refs}, SUM(n0 + n1) OVER () - 2 * COUNT(*) OVER () AS dfree,
         SUM(n0 * v0 + n1 * v1) OVER () AS rss, CAST(arm AS VARCHAR) = '{base}' AS isb
  FROM (SELECT arm, COUNT(*) FILTER (WHERE t = 0) AS n0, COUNT(*) FILTER (WHERE t = 1) AS n1,
               AVG(y) FILTER (WHERE t = 0) AS m0, AVG(y) FILTER (WHERE t = 1) AS m1,
               var_pop(y) FILTER (WHERE t = 0) AS v0, var_pop(y) FILTER (WHERE t = 1) AS v1
        FROM {name}_o GROUP BY arm))""")
    return with_ctes(_fin(did_rows(name)))


def did_rows(name: str) -> str:
    """The terms of a registered DiD."""
    c = f"{name}_c"
    lab = "CAST(arm AS VARCHAR)"
    return f"""SELECT 'Intercept' AS term, m0 AS coef, 1.0 / NULLIF(n0, 0) AS vf, rss, dfree FROM {c} WHERE isb
  UNION ALL SELECT 'time_binary', m1 - m0, 1.0 / NULLIF(n0, 0) + 1.0 / NULLIF(n1, 0), rss, dfree FROM {c} WHERE isb
  UNION ALL SELECT 'arm[' || {lab} || ']', m0 - b_m0, 1.0 / NULLIF(n0, 0) + 1.0 / NULLIF(b_n0, 0), rss, dfree FROM {c} WHERE NOT isb
  UNION ALL SELECT 'time_binary:arm[' || {lab} || ']', (m1 - m0) - (b_m1 - b_m0),
    1.0 / NULLIF(n0, 0) + 1.0 / NULLIF(n1, 0) + 1.0 / NULLIF(b_n0, 0) + 1.0 / NULLIF(b_n1, 0), rss, dfree FROM {c} WHERE NOT isb"""


def contrast_sql(name: str, obs: str, base: str) -> str:
    """One-way contrast in SQL; ``obs`` yields (arm, y)."""
    register(f"{name}_o", f"{name}_o AS ({obs})")
    register(f"{name}_c", f"""{name}_c AS (
  SELECT *, MAX(CASE WHEN CAST(arm AS VARCHAR) = '{base}' THEN n END) OVER () AS b_n,
         MAX(CASE WHEN CAST(arm AS VARCHAR) = '{base}' THEN m END) OVER () AS b_m,
         SUM(n) OVER () - COUNT(*) OVER () AS dfree, SUM(n * v) OVER () AS rss, CAST(arm AS VARCHAR) = '{base}' AS isb
  FROM (SELECT arm, COUNT(*) AS n, AVG(y) AS m, var_pop(y) AS v FROM {name}_o WHERE y IS NOT NULL GROUP BY arm))""")
    return with_ctes(_fin(contrast_rows(name)))


def contrast_rows(name: str) -> str:
    """The terms of a registered contrast."""
    return f"""SELECT CASE WHEN isb THEN 'Intercept' ELSE 'arm[' || CAST(arm AS VARCHAR) || ']' END AS term,
    CASE WHEN isb THEN m ELSE m - b_m END AS coef,
    CASE WHEN isb THEN 1.0 / NULLIF(n, 0) ELSE 1.0 / NULLIF(n, 0) + 1.0 / NULLIF(b_n, 0) END AS vf, rss, dfree FROM {name}_c"""


def _within_sql(src: str, group: str) -> str:
    return f"""SELECT {group} AS g, COUNT(*) AS n, AVG(y) AS my, AVG(x1) AS m1, AVG(x2) AS m2,
    covar_pop(x1, x1) * COUNT(*) AS s11, covar_pop(x2, x2) * COUNT(*) AS s22, covar_pop(x1, x2) * COUNT(*) AS s12,
    covar_pop(x1, y) * COUNT(*) AS s1y, covar_pop(x2, y) * COUNT(*) AS s2y, covar_pop(y, y) * COUNT(*) AS syy
  FROM {src} GROUP BY {group}"""


def _pooled_sql(name: str, inner: str) -> None:
    sums = ", ".join(f"SUM({x}) OVER () AS P{x[1:]}" for x in ("s11", "s22", "s12", "s1y", "s2y", "syy"))
    register(f"{name}_p0", f"{name}_p0 AS (SELECT *, {sums}, SUM(n) OVER () AS NN, COUNT(*) OVER () AS GG FROM ({inner}))")
    # a regressor that those before it determine is left out
    register(f"{name}_p0r", f"""{name}_p0r AS (SELECT *, e > 1e-10 * P22 AS ok2 FROM (
    SELECT *, P11 > 0 AS ok1, P22 - CASE WHEN P11 > 0 THEN P12 * P12 / P11 ELSE 0 END AS e FROM {name}_p0))""")
    register(f"{name}_p1", f"""{name}_p1 AS (SELECT *, CAST(ok1 AS INTEGER) + CAST(ok2 AS INTEGER) AS rnk,
    CASE WHEN ok1 THEN 1 / P11 + CASE WHEN ok2 THEN P12 * P12 / P11 / P11 / e ELSE 0 END ELSE 0 END AS i11,
    CASE WHEN ok2 THEN 1 / e ELSE 0 END AS i22, CASE WHEN ok1 AND ok2 THEN -P12 / P11 / e ELSE 0 END AS i12 FROM {name}_p0r)""")
    register(f"{name}_p", f"""{name}_p AS (SELECT *, greatest(Pyy - b1 * P1y - b2 * P2y, 0) AS rss,
    CASE WHEN ok1 THEN b1 END AS c1, CASE WHEN ok2 THEN b2 END AS c2,
    CASE WHEN ok1 THEN i11 END AS vf1, CASE WHEN ok2 THEN i22 END AS vf2 FROM (
    SELECT *, i11 * P1y + i12 * P2y AS b1, i12 * P1y + i22 * P2y AS b2 FROM {name}_p1))""")


def adjusted_sql(name: str, obs: str, base: str, x1: str, x2: str) -> str:
    """``obs`` yields (arm, y, x1, x2) without nulls."""
    register(f"{name}_o", f"{name}_o AS ({obs})")
    _pooled_sql(name, _within_sql(f"{name}_o", "arm"))
    register(f"{name}_a", f"""{name}_a AS (SELECT *, MAX(CASE WHEN isb THEN n END) OVER () AS b_n,
    MAX(CASE WHEN isb THEN a END) OVER () AS b_a, MAX(CASE WHEN isb THEN m1 END) OVER () AS b_m1,
    MAX(CASE WHEN isb THEN m2 END) OVER () AS b_m2, NN - GG - rnk AS dfree FROM (
    SELECT *, my - b1 * m1 - b2 * m2 AS a, CAST(g AS VARCHAR) = '{base}' AS isb FROM {name}_p))""")
    return with_ctes(_fin(adjusted_rows(name, x1, x2)))


def adjusted_rows(name: str, x1: str, x2: str) -> str:
    """The terms of a registered adjusted contrast."""
    a = f"{name}_a"
    q = "(i11 * {u} * {u} + 2 * i12 * {u} * {v} + i22 * {v} * {v})"
    return f"""SELECT 'Intercept' AS term, a AS coef, 1.0 / n + {q.format(u='m1', v='m2')} AS vf, rss, dfree FROM {a} WHERE isb
  UNION ALL SELECT '{x1}', c1, vf1, rss, dfree FROM {a} WHERE isb
  UNION ALL SELECT '{x2}', c2, vf2, rss, dfree FROM {a} WHERE isb
  UNION ALL SELECT 'arm[' || CAST(g AS VARCHAR) || ']', a - b_a,
    1.0 / n + 1.0 / b_n + {q.format(u='(m1 - b_m1)', v='(m2 - b_m2)')}, rss, dfree FROM {a} WHERE NOT isb"""


# ---------------------------------------------------------------------------------------------------
# Cohort: valid sections outside arm 0, baseline arm 1 (the published DiD setting).

def _valid_no0(spark, root):
    return valid_long(spark, root).filter(F.col("experiment_mode") != 0)


def _obs_sql(pre: int, post: int, where: str = "experiment_mode <> 0", src: str = "vlong", arm: str = "experiment_mode") -> str:
    return (f"SELECT {arm} AS arm, CASE WHEN pos = {post} THEN 1 ELSE 0 END AS t, CAST(is_correct AS DOUBLE) AS y "
            f"FROM {src} WHERE pos IN ({pre}, {post}) AND is_correct IS NOT NULL AND {where}")


def _did_query(pre: int, post: int):
    def fn(spark, root):
        obs = I.did_observations(_valid_no0(spark, root), pre, post)
        return rounded(I.did(obs, PL.P.baseline_arm))
    fn.__doc__ = f"I-01: DiD of correctness between questions {pre} and {post}, arms 2 and 3 against arm 1."
    return fn


for _pre, _post in [(1, 10), (2, 11), (2, 12)]:
    query(f"did_{_pre}_{_post}", did_sql(f"did{_pre}{_post}", _obs_sql(_pre, _post), "1"))(_did_query(_pre, _post))


def _external(spark, root):
    long, first, ctrl, chk = frames(spark, root)
    v = valid_long(spark, root).withColumn("experiment_mode", F.col("experiment_mode").cast("string"))
    b = PL.long_data(long, N).filter(F.col("experiment_mode") == -1).withColumn("experiment_mode", F.lit("non-filter"))
    return v.unionByName(b.select(*v.columns))


register("ext_long", """ext_long AS (
  SELECT user_id, gamecharacter_id, session_id, section_id, pos, is_correct, CAST(experiment_mode AS VARCHAR) AS lab FROM vlong
  UNION ALL SELECT user_id, gamecharacter_id, session_id, section_id, pos, is_correct, 'non-filter' FROM ld WHERE experiment_mode = -1)""")
register("ext_pairs", """ext_pairs AS (
  SELECT * FROM ext_long e WHERE pos IN (2, 11) AND EXISTS (
    SELECT 1 FROM ext_long f WHERE f.user_id = e.user_id AND f.gamecharacter_id = e.gamecharacter_id
      AND f.session_id = e.session_id AND f.section_id = e.section_id AND f.pos IN (2, 11) AND f.is_correct IS NOT NULL
    GROUP BY f.user_id HAVING COUNT(*) = 2))""")


@query("did_external_baseline", did_sql("didext", _obs_sql(2, 11, "TRUE", "ext_pairs", "lab"), "non-filter"))
def did_external_baseline(spark, root):
    """I-02 + T-05 + F-10: valid arms 0..3 against the unfiltered baseline cohort
    (arm -1 relabelled 'non-filter'), questions 2 and 11, pairs with both values."""
    obs = I.did_observations(_external(spark, root), 2, 11, drop="pair")
    return rounded(I.did(obs, "non-filter"))


@query("did_group_means", with_ctes("""SELECT CAST(arm AS VARCHAR) AS experiment_mode, round(mean_pre, 6) AS mean_pre,
  round(mean_post, 6) AS mean_post, round(mean_post - mean_pre, 6) AS diff,
  round((mean_post - mean_pre) - MAX(CASE WHEN CAST(arm AS VARCHAR) = 'non-filter' THEN mean_post - mean_pre END) OVER (), 6) AS did_effect
FROM (SELECT arm, AVG(y) FILTER (WHERE t = 0) AS mean_pre, AVG(y) FILTER (WHERE t = 1) AS mean_post FROM didext_o GROUP BY arm)"""))
def did_group_means(spark, root):
    """I-02: group means before and after, difference, effect against the baseline cohort."""
    obs = I.did_observations(_external(spark, root), 2, 11, drop="pair")
    g = I.did_group_means(obs, "non-filter")
    return g.select(F.col("experiment_mode").cast("string").alias("experiment_mode"),
                    *[F.round(F.col(c), 6).alias(c) for c in ["mean_pre", "mean_post", "diff", "did_effect"]])


@query("did_fit_stats", with_ctes("""SELECT CAST(N AS BIGINT) AS n_obs, CAST(N - k AS BIGINT) AS df_resid,
  round(1 - rss / (syy - sy * sy / N), 6) AS r2,
  round(1 - (rss / (syy - sy * sy / N)) * (N - 1) / (N - k), 6) AS adj_r2,
  round(((syy - sy * sy / N) - rss) / (k - 1) / (rss / (N - k)), 6) AS f_stat
FROM (SELECT SUM(n) AS N, SUM(s) AS sy, SUM(ss) AS syy, SUM(ss - s * s / n) AS rss, COUNT(*) AS k
      FROM (SELECT arm, t, COUNT(*) AS n, SUM(y) AS s, SUM(y * y) AS ss FROM did110_o GROUP BY arm, t))"""))
def did_fit_stats(spark, root):
    """I-11: N, residual df, R2, adjusted R2 and F of the questions 1-10 DiD model."""
    obs = I.did_observations(_valid_no0(spark, root), 1, 10)
    return rounded(I.fit_stats(obs).select("n_obs", "df_resid", "r2", "adj_r2", "f_stat"), ("r2", "adj_r2", "f_stat"))


def _position_obs(long, pos: int):
    return long.filter(F.col("pos") == pos).select("experiment_mode", F.col("is_correct").cast("double").alias("y"))


def _pos_sql(pos: int, src: str = "vlong", where: str = "experiment_mode <> 0", arm: str = "experiment_mode"):
    return f"SELECT {arm} AS arm, CAST(is_correct AS DOUBLE) AS y FROM {src} WHERE pos = {pos} AND {where}"


@query("contrast_q12", contrast_sql("cq12", _pos_sql(12), "1"))
def contrast_q12(spark, root):
    """I-03: correctness at question 12 by arm against arm 1 (valid, arms 1..3)."""
    return rounded(I.contrast(_position_obs(_valid_no0(spark, root), 12), PL.P.baseline_arm))


@query("contrast_q1", contrast_sql("cq1", _pos_sql(1), "1"))
def contrast_q1(spark, root):
    """I-03: correctness at question 1 by arm against arm 1 (valid, arms 1..3)."""
    return rounded(I.contrast(_position_obs(_valid_no0(spark, root), 1), PL.P.baseline_arm))


register("rf12long", """rf12long AS (SELECT l.* FROM long l JOIN raw_f12 v ON l.user_id = v.user_id
  AND l.gamecharacter_id = v.gamecharacter_id AND l.session_id = v.session_id AND l.section_id = v.section_id)""")


@query("contrast_q2_tolerant", contrast_sql("cq2t", _pos_sql(2, "rf12long", "TRUE"), "1"))
def contrast_q2_tolerant(spark, root):
    """I-03 on the tolerant-valid cohort (any length): correctness at question 2."""
    long, first, ctrl, chk = frames(spark, root)
    keys = S.seq_valid_tolerant(chk.filter(F.col("experiment_mode") != -1), N).filter(f"seq_valid_less{N}inc")
    rows = first.join(keys.select(*SECTION_KEYS), on=SECTION_KEYS, how="left_semi")
    return rounded(I.contrast(_position_obs(rows, 2), PL.P.baseline_arm))


def _adj_rows(long, target: int):
    w = long.filter(F.col("pos").isin(1, 2, target)).groupBy(*SECTION_KEYS, "experiment_mode").agg(
        *[F.max(F.when(F.col("pos") == p, F.col("is_correct"))).alias(f"q_{p}_corr") for p in (1, 2, target)])
    return w


_ADJ_SQL = """SELECT experiment_mode AS arm, CAST(MAX(CASE WHEN pos = {t} THEN is_correct END) AS DOUBLE) AS y,
  CAST(MAX(CASE WHEN pos = 1 THEN is_correct END) AS DOUBLE) AS x1, CAST(MAX(CASE WHEN pos = 2 THEN is_correct END) AS DOUBLE) AS x2
FROM vlong WHERE experiment_mode <> 0 AND pos IN (1, 2, {t})
GROUP BY user_id, gamecharacter_id, session_id, section_id, experiment_mode"""


@query("adjusted_q12", adjusted_sql("adj12", f"SELECT * FROM ({_ADJ_SQL.format(t=12)}) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL",
                                    "1", "q_1_corr", "q_2_corr"))
def adjusted_q12(spark, root):
    """I-04: q_12 ~ C(arm, ref 1) + q_1 + q_2 on the valid cohort without arm 0."""
    w = _adj_rows(_valid_no0(spark, root), 12)
    return rounded(I.adjusted_contrast(w, PL.P.baseline_arm, "q_12_corr", "q_1_corr", "q_2_corr"))


def _pooled_long(spark, root):
    v = _valid_no0(spark, root)
    return v.withColumn("experiment_mode", F.when(F.col("experiment_mode") == 1, 0).otherwise(1))


_POOL_ARM = "CASE WHEN experiment_mode = 1 THEN 0 ELSE 1 END"


@query("pooled_did", did_sql("pool110", _obs_sql(1, 10, arm=_POOL_ARM), "0"))
def pooled_did(spark, root):
    """I-10 + F-13: arms 2 and 3 merged against arm 1 (recoded 1 -> 0, others -> 1), DiD 1-10."""
    return rounded(I.did(I.did_observations(_pooled_long(spark, root), 1, 10), 0))


@query("pooled_contrast_q12", contrast_sql("poolc12", _pos_sql(12, arm=_POOL_ARM), "0"))
def pooled_contrast_q12(spark, root):
    """I-10: merged arms, correctness at question 12."""
    return rounded(I.contrast(_position_obs(_pooled_long(spark, root), 12), 0))


register("vsteps_all", f"""vsteps_all AS (
  SELECT *, date_diff('microsecond', LAG(created_at) OVER w, created_at) / 1000000.0 AS delta,
         date_diff('microsecond', FIRST(created_at) OVER w, created_at) / 1000000.0 AS acc
  FROM vlong WHERE pos <= {N}
  WINDOW w AS (PARTITION BY user_id, gamecharacter_id, session_id, section_id ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
_MED_PARTS = [("delta_q10", "delta", 10), ("delta_q11", "delta", 11), ("delta_q12", "delta", 12), ("acc_q12", "acc", 12)]


@query("median_contrast", with_ctes(" UNION ALL ".join(f"""SELECT '{o}' AS outcome,
  CASE WHEN experiment_mode = 1 THEN 'Intercept' ELSE 'arm[' || CAST(experiment_mode AS VARCHAR) || ']' END AS term,
  round(CASE WHEN experiment_mode = 1 THEN med ELSE med - MAX(CASE WHEN experiment_mode = 1 THEN med END) OVER () END, 3) AS coef, n
FROM (SELECT experiment_mode, quantile_cont({v}, 0.5) AS med, COUNT(*) AS n FROM vsteps_all
      WHERE pos = {p} AND {v} IS NOT NULL GROUP BY experiment_mode)""" for o, v, p in _MED_PARTS)))
def median_contrast(spark, root):
    """I-06: median regression of step time into questions 10, 11, 12 and of the time
    from question 1 to 12 on arm dummies (ref arm 1) = differences of group medians.
    The four outcomes are stacked and share one quantile pass."""
    st = C.step_times(valid_long(spark, root), N).filter(F.col("pos").isin(10, 11, 12))
    pairs = F.array(
        F.struct(F.concat(F.lit("delta_q"), F.col("pos").cast("string")).alias("outcome"), F.col("delta").alias("x")),
        F.struct(F.when(F.col("pos") == 12, F.lit("acc_q12")).alias("outcome"), F.col("acc").alias("x")))
    stacked = st.select("experiment_mode", F.inline(pairs)).filter(F.col("outcome").isNotNull())
    m = I.median_contrast(stacked, PL.P.baseline_arm, "x", by=["outcome"])
    return m.select("outcome", "term", F.round("coef", 3).alias("coef"), "n")


register("len_sess", f"""len_sess AS (
  SELECT experiment_mode, COALESCE(SUM(CASE WHEN spos >= 2 THEN time_diff END), 0.0) AS total_length, COUNT(*) AS q_number
  FROM wlong WHERE n_questions >= {N} GROUP BY user_id, gamecharacter_id, session_id, experiment_mode, n_questions)""")


def _len_sessions(spark, root, max_total: float | None = 3 * 3600):
    t = C.session_totals(wlong(spark, root), N, include_lead_gap=False).filter(F.col("n_questions") >= N)
    t = t.filter(F.col("experiment_mode") != -1)
    return t if max_total is None else t.filter(F.col("total_length") <= max_total)


def _length_contrast(spark, root, max_total: float | None = 3 * 3600):
    """I-05: total session minutes and question count on arm (ref arm 0), sessions
    with at least 12 answers, at most 3 hours, inside an arm.  The total here leaves
    out the lead gap (D-12): with the 3600-minute session gap every lead gap is
    longer than 3 hours, so including it would empty the cohort."""
    t = _len_sessions(spark, root, max_total)
    a = I.contrast(t.select("experiment_mode", (F.col("total_length") / 60).alias("y")), 0)
    b = I.contrast(t.select("experiment_mode", F.col("n_questions").cast("double").alias("y")), 0)
    return rounded(a.select(F.lit("minutes").alias("outcome"), "*").unionByName(
        b.select(F.lit("q_number").alias("outcome"), "*")), digits=3)


contrast_sql("lenmin", "SELECT experiment_mode AS arm, total_length / 60 AS y FROM len_sess "
                       "WHERE experiment_mode <> -1 AND total_length <= 10800", "0")
contrast_sql("lenq", "SELECT experiment_mode AS arm, CAST(q_number AS DOUBLE) AS y FROM len_sess "
                     "WHERE experiment_mode <> -1 AND total_length <= 10800", "0")


def _fin_named(name: str, label: str) -> str:
    rows = contrast_rows(name)
    return f"SELECT '{label}' AS outcome, * FROM ({_fin(rows, 3)})"


query("length_contrast", with_ctes(_fin_named("lenmin", "minutes") + " UNION ALL " + _fin_named("lenq", "q_number")))(
    _length_contrast)


register("fe_rows", """fe_rows AS (
  SELECT section_id, user_id, ln(time_diff) AS y, CAST(difficulty_level = 2 AS DOUBLE) AS x1,
         CAST(difficulty_level = 3 AS DOUBLE) AS x2
  FROM in_sessions WHERE time_diff <= 1800 AND time_diff <> 0 AND time_diff IS NOT NULL
    AND difficulty_level IS NOT NULL AND section_id IS NOT NULL)""")
_pooled_sql("fe1", _within_sql("fe_rows", "section_id"))


def fe_rows(spark, root, log: bool = True):
    """F-09 + F-10 + X-07: answer-level gaps <= 30 min, non-zero, nulls dropped."""
    s = PL.in_sessions(spark, root)
    s = s.filter((F.col("time_diff") <= 1800) & (F.col("time_diff") != 0)).na.drop(
        subset=["time_diff", "difficulty_level", "section_id"])
    y = F.ln("time_diff") if log else F.col("time_diff")
    return s.select("section_id", "user_id", "is_correct", "time_diff", "difficulty_level", y.alias("y"),
                    (F.col("difficulty_level") == 2).cast("double").alias("x1"),
                    (F.col("difficulty_level") == 3).cast("double").alias("x2"))


def named_levels(out, xs, levels):
    """The dummy columns' names as ``difficulty[level]``."""
    names = F.create_map(*[c for x, v in zip(xs, levels) for c in (F.lit(x), F.lit(f"difficulty[{v}]"))])
    return out.withColumn("term", names[F.col("term")])


@query("log_gap_section_fe", with_ctes("SELECT * FROM (" + _fin(
    "SELECT 'difficulty[2]' AS term, c1 AS coef, vf1 AS vf, rss, NN - GG - rnk AS dfree FROM (SELECT * FROM fe1_p LIMIT 1) "
    "UNION ALL SELECT 'difficulty[3]', c2, vf2, rss, NN - GG - rnk FROM (SELECT * FROM fe1_p LIMIT 1)") + ")"))
def log_gap_section_fe(spark, root):
    """I-07: ln(gap) ~ C(difficulty, ref 1) + C(section): slopes by exact
    within-section demeaning (section effects absorbed)."""
    rows, xs, levels = I.level_dummies(fe_rows(spark, root), "difficulty_level", 1)
    out = I.within_regressors(rows, "section_id", "y", xs)
    return rounded(named_levels(out, xs, levels))


contrast_sql("lenmin_all", "SELECT experiment_mode AS arm, total_length / 60 AS y FROM len_sess WHERE experiment_mode <> -1", "0")
contrast_sql("lenq_all", "SELECT experiment_mode AS arm, CAST(q_number AS DOUBLE) AS y FROM len_sess WHERE experiment_mode <> -1", "0")


@query("length_contrast_uncapped", with_ctes(_fin_named("lenmin_all", "minutes") + " UNION ALL "
                                            + _fin_named("lenq_all", "q_number")))
def length_contrast_uncapped(spark, root):
    """I-05 without the 3-hour cap (F-09 is optional): every session of 12+ answers in an arm."""
    return _length_contrast(spark, root, None)


# --- several fixed effects -----------------------------------------------------------------------

# The derived log has two sections: users are demeaned exactly, and the second section's dummy is partialled out.
register("fe_gap", """fe_gap AS (
  SELECT section_id, user_id, CAST(time_diff AS DOUBLE) AS y, CAST(difficulty_level = 2 AS DOUBLE) AS x1,
         CAST(difficulty_level = 3 AS DOUBLE) AS x2, CAST(section_id = 1 AS DOUBLE) AS d
  FROM in_sessions WHERE time_diff <= 1800 AND time_diff <> 0 AND time_diff IS NOT NULL
    AND difficulty_level IS NOT NULL AND section_id IS NOT NULL)""")
register("fe_gap_u", """fe_gap_u AS (
  SELECT section_id, user_id, y AS y0, y - AVG(y) OVER w AS y, x1 - AVG(x1) OVER w AS x1, x2 - AVG(x2) OVER w AS x2, d - AVG(d) OVER w AS d
  FROM fe_gap WINDOW w AS (PARTITION BY user_id))""")
register("fe_gap_d", """fe_gap_d AS (
  SELECT COALESCE(SUM(d * y) / NULLIF(SUM(d * d), 0), 0) AS by_, COALESCE(SUM(d * x1) / NULLIF(SUM(d * d), 0), 0) AS bx1,
         COALESCE(SUM(d * x2) / NULLIF(SUM(d * d), 0), 0) AS bx2, COUNT(DISTINCT section_id) AS l1, COUNT(DISTINCT user_id) AS l2,
         CASE WHEN SUM(d * d) > 1e-9 OR COUNT(DISTINCT section_id) = 1 THEN 1 ELSE 2 END AS parts, var_pop(y0) * COUNT(*) AS tss FROM fe_gap_u)""")
register("fe_gap_s", """fe_gap_s AS (
  SELECT section_id, y - by_ * d AS y, x1 - bx1 * d AS x1, x2 - bx2 * d AS x2 FROM fe_gap_u, fe_gap_d)""")
_pooled_sql("fe2", """SELECT COUNT(*) AS n, SUM(x1 * x1) AS s11, SUM(x2 * x2) AS s22, SUM(x1 * x2) AS s12, SUM(x1 * y) AS s1y,
  SUM(x2 * y) AS s2y, SUM(y * y) AS syy FROM fe_gap_s""")
register("fe_gap_m", """fe_gap_m AS (
  SELECT COUNT(*) AS g, SUM(g1 * g1) AS m11, SUM(g1 * g2) AS m12, SUM(g2 * g2) AS m22 FROM (
    SELECT section_id, SUM(x1 * (y - b1 * x1 - b2 * x2)) AS g1, SUM(x2 * (y - b1 * x1 - b2 * x2)) AS g2
    FROM fe_gap_s, fe2_p GROUP BY section_id))""")
register("fe_gap_t", """fe_gap_t AS (
  SELECT *, coef / NULLIF(se, 0) AS t, coef / NULLIF(sec, 0) AS tc FROM (
    SELECT term, coef, sqrt(rss / NULLIF(dfree, 0) * vf) AS se, dfree, sqrt(vc * g / NULLIF(g - 1, 0) * (NN - 1) / (NN - rnk - l2)) AS sec, g, NN,
           1 - rss / tss AS r2, 1 - rss / Pyy AS r2w
    FROM (SELECT 'difficulty[2]' AS term, c1 AS coef, vf1 AS vf, i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22 AS vc,
                 rss, NN - rnk - (l1 + l2 - parts) AS dfree, g, NN, rnk, l2, tss, Pyy FROM fe2_p, fe_gap_m, fe_gap_d
          UNION ALL SELECT 'difficulty[3]', c2, vf2, i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22,
                 rss, NN - rnk - (l1 + l2 - parts), g, NN, rnk, l2, tss, Pyy FROM fe2_p, fe_gap_m, fe_gap_d)))""")
_FE_COLS = ("coef", "se", "t", "p", "se_cluster", "t_cluster", "p_cluster", "r2", "r2_within")


@query("gap_twoway_fe", beta_sql("fe_gap_b", """SELECT term || '/iid' AS id, dfree / 2 AS a, 0.5 AS b, dfree / (dfree + t * t) AS x, t * t / (dfree + t * t) AS rest
    FROM fe_gap_t WHERE t IS NOT NULL AND dfree > 0
  UNION ALL SELECT term || '/cluster', (g - 1) / 2, 0.5, (g - 1) / (g - 1 + tc * tc), tc * tc / (g - 1 + tc * tc) FROM fe_gap_t WHERE tc IS NOT NULL""",
    """SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 6) AS t, CAST(dfree AS BIGINT) AS df, round(i.p, 6) AS p,
  round(sec, 6) AS se_cluster, round(tc, 6) AS t_cluster, round(c.p, 6) AS p_cluster, g AS n_clusters, CAST(NN AS BIGINT) AS n_obs,
  round(r2, 6) AS r2, round(r2w, 6) AS r2_within
FROM fe_gap_t LEFT JOIN fe_gap_b i ON i.id = term || '/iid' LEFT JOIN fe_gap_b c ON c.id = term || '/cluster'"""))
def gap_twoway_fe(spark, root):
    """I-08: gap ~ difficulty | section + user, with iid errors and errors clustered by section."""
    from seqlab.operators.fixed_effects import twoway_fe
    rows, xs, levels = I.level_dummies(fe_rows(spark, root, log=False), "difficulty_level", 1)
    return rounded(named_levels(twoway_fe(rows, "y", xs, "section_id", "user_id"), xs, levels), _FE_COLS)


@query("correct_fe_logit")
def correct_fe_logit(spark, root):
    """I-09: is_correct ~ gap | difficulty + section + user (logit, separated levels dropped)."""
    from seqlab.operators.fixed_effects import fe_logit
    rows = fe_rows(spark, root, log=False)
    out = fe_logit(rows, "is_correct", "time_diff", ["difficulty_level", "section_id", "user_id"])
    return rounded(out, ("coef", "se", "z", "p", "se_cluster", "z_cluster", "p_cluster", "deviance")).drop("iterations")


@query("did_pvalues", did_p_sql("did110p", "did110"))
def did_pvalues(spark, root):
    """I-11: the questions 1-10 DiD table with two-sided p-values."""
    obs = I.did_observations(_valid_no0(spark, root), 1, 10)
    return rounded(I.with_p(I.did(obs, PL.P.baseline_arm)), ("coef", "se", "t", "p"))


register("mf", f"""mf AS (SELECT experiment_mode, total_length / 60 AS minutes, CAST(q_number AS DOUBLE) AS q_number
  FROM len_sess WHERE experiment_mode <> -1)""")


@query("model_frame_summary", with_ctes(" UNION ALL ".join(f"""SELECT '{v}' AS variable,
  (SELECT string_agg(CAST(experiment_mode AS VARCHAR), ',' ORDER BY experiment_mode)
     FROM (SELECT DISTINCT experiment_mode FROM mf)) AS levels,
  COUNT({v}) AS count, round(AVG({v}), 3) AS mean, round(stddev_samp({v}), 3) AS std, round(MIN({v}), 3) AS min,
  round(quantile_cont({v}, 0.5), 3) AS p50, round(MAX({v}), 3) AS max FROM mf""" for v in ("minutes", "q_number"))))
def model_frame_summary(spark, root):
    """G-20: levels of the arm factor and a summary of the I-05 model frame."""
    from seqlab.operators import summary as M
    t = _len_sessions(spark, root, None).select(
        "experiment_mode", (F.col("total_length") / 60).alias("minutes"), F.col("n_questions").cast("double").alias("q_number"))
    levels = M.distinct_sorted(t, "experiment_mode").agg(
        F.array_join(F.array_sort(F.collect_list(F.col("experiment_mode").cast("int"))).cast("array<string>"), ",")
    ).scalar()
    from seqlab.operators.quantiles import exact_quantiles
    parts = []
    for v in ("minutes", "q_number"):
        med = exact_quantiles(t, v, [], (0.5,), ["_p50"])
        parts.append(t.withColumn("_p50", med.scalar()).agg(F.lit(v).alias("variable"), levels.alias("levels"), F.count(v).alias("count"),
                           F.round(F.avg(v), 3).alias("mean"), F.round(F.stddev_samp(v), 3).alias("std"),
                           F.round(F.min(v), 3).alias("min"), F.round(F.first("_p50"), 3).alias("p50"),
                           F.round(F.max(v), 3).alias("max")))
    return parts[0].unionByName(parts[1])


# --- the remaining positions the published analysis fits ---------------------------------------

def _contrast_query(pos: int, pooled: bool):
    def fn(spark, root):
        src = _pooled_long(spark, root) if pooled else _valid_no0(spark, root)
        return rounded(I.contrast(_position_obs(src, pos), 0 if pooled else PL.P.baseline_arm))
    fn.__doc__ = f"I-03{' / I-10' if pooled else ''}: correctness at question {pos} by arm."
    return fn


for _p in (2, 10, 11):
    query(f"contrast_q{_p}", contrast_sql(f"cq{_p}", _pos_sql(_p), "1"))(_contrast_query(_p, False))
for _p in (1, 2, 10, 11):
    query(f"pooled_contrast_q{_p}", contrast_sql(f"poolc{_p}", _pos_sql(_p, arm=_POOL_ARM), "0"))(_contrast_query(_p, True))


def _pooled_did_query(pre: int, post: int):
    def fn(spark, root):
        return rounded(I.did(I.did_observations(_pooled_long(spark, root), pre, post), 0))
    fn.__doc__ = f"I-10: merged arms, DiD between questions {pre} and {post}."
    return fn


for _pre, _post in [(2, 11), (2, 12)]:
    query(f"pooled_did_{_pre}_{_post}", did_sql(f"pool{_pre}{_post}", _obs_sql(_pre, _post, arm=_POOL_ARM), "0"))(
        _pooled_did_query(_pre, _post))


def _adjusted_query(target: int):
    def fn(spark, root):
        w = _adj_rows(_valid_no0(spark, root), target)
        return rounded(I.adjusted_contrast(w, PL.P.baseline_arm, f"q_{target}_corr", "q_1_corr", "q_2_corr"))
    fn.__doc__ = f"I-04: q_{target} ~ C(arm, ref 1) + q_1 + q_2 on the valid cohort without arm 0."
    return fn


for _t in (10, 11):
    query(f"adjusted_q{_t}", adjusted_sql(
        f"adj{_t}", f"SELECT * FROM ({_ADJ_SQL.format(t=_t)}) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL",
        "1", "q_1_corr", "q_2_corr"))(_adjusted_query(_t))


# --- I-02: every published scenario with every pair of questions ---------------------------------
# Cohort: whole sessions whose modal subject is math and whose difficulty at questions
# 1, 2, 10, 11, 12 follows the pattern; the baseline is every long session outside the experiment.

_PAIRS = [(1, 10), (2, 11), (2, 12)]
_SCENARIOS = {"arm1_nonfilter": (("1",), "non-filter"), "arms_ref1": (("0", "1", "2", "3"), "1"),
              "arms_nonfilter": (("0", "2", "3"), "non-filter")}

register("sc_cand", f"""sc_cand AS (
  SELECT w.*, p.n_hits FROM wlong w JOIN (
    SELECT user_id, gamecharacter_id, session_id,
           SUM(CASE WHEN {" OR ".join(f"(spos = {k} AND difficulty_level = {v})" for k, v in C.DIFFICULTY_PATTERN.items())}
               THEN 1 ELSE 0 END) AS n_hits
    FROM wlong GROUP BY user_id, gamecharacter_id, session_id) p USING (user_id, gamecharacter_id, session_id)
  JOIN pc_subj j USING (user_id, gamecharacter_id, session_id)
  WHERE w.n_questions >= {N} AND j.subject_name_mode = 'math')""")
register("sc_long", f"""sc_long AS (
  SELECT user_id, gamecharacter_id, session_id, spos, is_correct,
         CASE WHEN experiment_mode = -1 THEN 'non-filter' ELSE CAST(experiment_mode AS VARCHAR) END AS lab
  FROM sc_cand WHERE experiment_mode = -1 OR n_hits = {len(C.DIFFICULTY_PATTERN)})""")
register("sc_first", """sc_first AS (
  SELECT user_id, gamecharacter_id, session_id, lab FROM sc_long WHERE spos = 1 AND is_correct = 1)""")


def scenario_long(spark, root):
    """Whole-session rows of the scenario cohorts, labelled by arm or 'non-filter'."""
    from seqlab.operators.sessions import session_table
    from seqlab.operators.summary import positional_pattern
    keys = ["user_id", "gamecharacter_id", "session_id"]
    w = wlong(spark, root).filter(F.col("n_questions") >= N)
    math = session_table(PL.in_sessions(spark, root), mode_cols={"subject": "subject_name"}).filter("subject = 'math'")
    w = w.join(math.select(*keys), keys, "left_semi")
    kept = positional_pattern(w, C.DIFFICULTY_PATTERN, keys)
    base = w.filter("experiment_mode = -1").withColumn("lab", F.lit("non-filter"))
    arms = w.filter("experiment_mode <> -1").join(kept, keys, "left_semi").withColumn(
        "lab", F.col("experiment_mode").cast("string"))
    return base.unionByName(arms).select(*keys, F.col("spos").alias("pos"), "is_correct", "lab")


def _scenario_obs(long, labels, base):
    """The answers of all question pairs at once: an answer appears in every pair it belongs to."""
    rows = long.filter(F.col("lab").isin(*labels, base) & F.col("is_correct").isNotNull())
    pairs = F.array(*[F.when(F.col("pos").isin(a, b), F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col("pos") == b).cast("int").alias("time_binary")))
                      for a, b in _PAIRS])
    return rows.select(F.col("lab").alias("experiment_mode"), F.col("is_correct").cast("double").alias("y"),
                       F.inline(F.filter(pairs, lambda p: p.isNotNull())))


def _scenario_query(labels, base, first_correct: bool = False):
    def fn(spark, root):
        long = scenario_long(spark, root)
        if first_correct:
            keys = ["user_id", "gamecharacter_id", "session_id"]
            right = long.filter("pos = 1 AND is_correct = 1").select(*keys)
            long = long.join(right, keys, "left_semi")
        return rounded(I.did(_scenario_obs(long, labels, base), base, by=["pair"]))
    fn.__doc__ = f"I-02: DiD of arms {', '.join(labels)} against {base}, question pairs 1-10, 2-11 and 2-12 in one aggregate."
    return fn


def _scenario_sql(name, labels, base, first_correct: bool = False) -> str:
    chosen = ", ".join(f"'{x}'" for x in {*labels, base})
    only = (" AND (user_id, gamecharacter_id, session_id) IN (SELECT (user_id, gamecharacter_id, session_id) FROM sc_first)"
            if first_correct else "")
    parts = []
    for a, b in _PAIRS:
        sql = did_sql(f"sc_{name}_{a}_{b}", f"SELECT lab AS arm, CASE WHEN spos = {b} THEN 1 ELSE 0 END AS t, "
                      f"CAST(is_correct AS DOUBLE) AS y FROM sc_long WHERE lab IN ({chosen}) AND spos IN ({a}, {b}) "
                      f"AND is_correct IS NOT NULL{only}", base)
        parts.append(f"SELECT '{a}-{b}' AS pair, * FROM (" + sql[sql.index("SELECT term, round(coef"):] + ")")
    return with_ctes(" UNION ALL ".join(parts))


for _name, (_labels, _base) in _SCENARIOS.items():
    query(f"did_scenario_{_name}", _scenario_sql(_name, _labels, _base))(_scenario_query(_labels, _base))
query("did_scenario_q1_correct", _scenario_sql("q1", ("0", "1", "2", "3"), "non-filter", True))(
    _scenario_query(("0", "1", "2", "3"), "non-filter", True))
