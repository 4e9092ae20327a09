"""Registered queries: frequency, crosstab, describe, histogram, box and other summaries (G, T, F)."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.timecols import ts_text
from seqlab.operators import curves as C
from seqlab.operators import summary as M
from seqlab.operators.sections import SECTION_KEYS, SESSION_KEYS
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import with_ctes
from seqlab.plans.q_curves import valid_long, wlong
from seqlab.plans.q_sessions import _ENRICHED_COLS
from seqlab.plans.q_sequences import N, frames
from seqlab.plans.registry import query


def r6(c):
    return F.round(c, 6)


def rawdata_rows(spark, root):
    return PL.first_sessions(PL.sections(spark, root))


@query("arm_counts", with_ctes("""SELECT experiment_mode, COUNT(*) AS n_raw,
  CAST(SUM(CASE WHEN q_len >= 12 THEN 1 ELSE 0 END) AS BIGINT) AS n_long
FROM long WHERE session_id = 1 AND pos = 1 GROUP BY experiment_mode"""))
def arm_counts(spark, root):
    """G-06: first-session section rows per arm, all lengths and at least 12."""
    r = rawdata_rows(spark, root)
    return r.groupBy("experiment_mode").agg(F.count(F.lit(1)).alias("n_raw"),
                                            F.count_if(F.col("q_len") >= N).alias("n_long"))


@query("crosstab_homogeneous", with_ctes("""SELECT a.experiment_mode,
  CAST(SUM(CASE WHEN h.is_homo THEN 1 ELSE 0 END) AS BIGINT) AS homo,
  CAST(SUM(CASE WHEN h.is_homo THEN 0 ELSE 1 END) AS BIGINT) AS mixed
FROM (SELECT user_id, gamecharacter_id, session_id, COUNT(section_id) = 0 OR (COUNT(*) = COUNT(section_id) AND MIN(section_id) = MAX(section_id)) AS is_homo
      FROM in_sessions GROUP BY user_id, gamecharacter_id, session_id) h
JOIN sess_arm a USING (user_id, gamecharacter_id, session_id) GROUP BY a.experiment_mode"""))
def crosstab_homogeneous(spark, root):
    """F-12 + G-07: sessions whose sections are all equal, crossed with the arm."""
    s = PL.in_sessions(spark, root)
    from seqlab.operators.sections import session_arm
    h = M.homogeneity(s, SESSION_KEYS).join(session_arm(s), on=SESSION_KEYS)
    return M.crosstab(h, "experiment_mode", "is_homo", [True, False], ["homo", "mixed"])


@query("describe_by_arm", with_ctes("""SELECT experiment_mode, COUNT(q_len) AS count, round(AVG(q_len), 6) AS mean,
  round(stddev_samp(q_len), 6) AS std, CAST(MIN(q_len) AS DOUBLE) AS min,
  round(quantile_cont(q_len, 0.25), 6) AS p25, round(quantile_cont(q_len, 0.5), 6) AS p50,
  round(quantile_cont(q_len, 0.75), 6) AS p75, CAST(MAX(q_len) AS DOUBLE) AS max
FROM long WHERE session_id = 1 AND pos = 1 GROUP BY experiment_mode"""))
def describe_by_arm(spark, root):
    """G-08: describe of section length by arm (first sessions)."""
    d = M.describe(rawdata_rows(spark, root), "q_len", ["experiment_mode"])
    return d.select("experiment_mode", "count", *[r6(F.col(c)).alias(c) for c in ["mean", "std"]], "min",
                    *[r6(F.col(c)).alias(c) for c in ["p25", "p50", "p75"]], "max")


@query("histogram_lengths", with_ctes("""WITH_R AS_R SELECT bin, round(lo + (bin - 1) * (hi - lo) / 10, 6) AS lo,
  round(lo + bin * (hi - lo) / 10, 6) AS hi, COUNT(*) AS n FROM (
  SELECT CAST(CASE WHEN r.hi = r.lo THEN 1 ELSE least(floor((x.q_len - r.lo) / ((r.hi - r.lo) / 10)) + 1, 10) END AS INTEGER) AS bin,
         r.lo, r.hi
  FROM (SELECT q_len FROM long WHERE session_id = 1 AND pos = 1) x,
       (SELECT CAST(MIN(q_len) AS DOUBLE) AS lo, CAST(MAX(q_len) AS DOUBLE) AS hi FROM long WHERE session_id = 1 AND pos = 1) r)
GROUP BY bin, lo, hi""".replace("WITH_R AS_R ", "")))
def histogram_lengths(spark, root):
    """G-12: ten equal-width bins of first-session section length."""
    h = M.histogram(rawdata_rows(spark, root), "q_len", 10)
    return h.select("bin", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


@query("length_counts", with_ctes(
    "SELECT experiment_mode, q_len, COUNT(*) AS n FROM long WHERE session_id = 1 AND pos = 1 "
    "GROUP BY experiment_mode, q_len"))
def length_counts(spark, root):
    """G-12 discrete variant: unit bins of section length by arm."""
    return M.frequency(rawdata_rows(spark, root), ["experiment_mode", "q_len"])


@query("box_difficulty", with_ctes(f"""SELECT q.experiment_mode, round(q.q1, 6) AS q1, round(q.median, 6) AS median,
  round(q.q3, 6) AS q3,
  round(MIN(CASE WHEN d.v BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN d.v END), 6) AS whisker_low,
  round(MAX(CASE WHEN d.v BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN d.v END), 6) AS whisker_high,
  CAST(SUM(CASE WHEN d.v BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM (SELECT user_id, gamecharacter_id, session_id, section_id, experiment_mode, AVG(difficulty_level) AS v
      FROM ld WHERE pos <= {N} GROUP BY ALL) d
JOIN (SELECT experiment_mode, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3
      FROM (SELECT user_id, gamecharacter_id, session_id, section_id, experiment_mode, AVG(difficulty_level) AS v
            FROM ld WHERE pos <= {N} GROUP BY ALL) GROUP BY experiment_mode) q
  ON d.experiment_mode = q.experiment_mode
GROUP BY q.experiment_mode, q.q1, q.median, q.q3"""))
def box_difficulty(spark, root):
    """G-13 + Q-21: box summary of mean difficulty over the first 12 answers, by arm."""
    prof = C.first_n_profile(PL.long_data(PL.long_table(spark, root), N), N)
    b = M.box_summary(prof, "difficulty_mean", ["experiment_mode"])
    return b.select("experiment_mode", *[r6(F.col(c)).alias(c) for c in
                                         ["q1", "median", "q3", "whisker_low", "whisker_high"]], "n_outliers")


@query("question_rate", with_ctes(
    "SELECT question_id, round(AVG(is_correct), 6) AS correct_rate, COUNT(is_correct) AS n "
    "FROM answer_log GROUP BY question_id"))
def question_rate(spark, root):
    """G-10: correct rate and answer count per question."""
    a = PL.answer_log(spark, root)
    return a.groupBy("question_id").agg(r6(F.avg("is_correct")).alias("correct_rate"), F.count("is_correct").alias("n"))


@query("answer_letter_share", with_ctes(f"""SELECT experiment_mode, COUNT(*) AS n, round(AVG(a_share), 6) AS mean_a_share
FROM (SELECT user_id, gamecharacter_id, session_id, experiment_mode,
             AVG(CASE WHEN substring(answer, 3, 1) = 'A' THEN 1.0 ELSE 0.0 END) AS a_share
      FROM wlong WHERE n_questions >= {N} GROUP BY ALL) GROUP BY experiment_mode"""))
def answer_letter_share(spark, root):
    """G-15: share of answers with letter A per session (>= 12 answers), averaged by arm."""
    w = wlong(spark, root).filter(F.col("n_questions") >= N)
    s = M.letter_share(w, SESSION_KEYS + ["experiment_mode"])
    return s.groupBy("experiment_mode").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("a_share")).alias("mean_a_share"))


@query("pre_post_by_arm", with_ctes("""SELECT experiment_mode,
  round(AVG(CASE WHEN pos = 1 THEN is_correct END), 6) AS mean_pre, round(AVG(CASE WHEN pos = 10 THEN is_correct END), 6) AS mean_post,
  round(stddev_samp(CASE WHEN pos = 1 THEN is_correct END), 6) AS std_pre,
  round(stddev_samp(CASE WHEN pos = 10 THEN is_correct END), 6) AS std_post
FROM vlong GROUP BY experiment_mode"""))
def pre_post_by_arm(spark, root):
    """G-09: mean and std of correctness at questions 1 and 10 by arm (valid cohort)."""
    v = valid_long(spark, root)
    pre = F.when(F.col("pos") == 1, F.col("is_correct"))
    post = F.when(F.col("pos") == 10, F.col("is_correct"))
    return v.groupBy("experiment_mode").agg(r6(F.avg(pre)).alias("mean_pre"), r6(F.avg(post)).alias("mean_post"),
                                            r6(F.stddev_samp(pre)).alias("std_pre"), r6(F.stddev_samp(post)).alias("std_post"))


_CURVE_SQL = f"SELECT experiment_mode, pos, AVG(is_correct) AS m FROM ld WHERE pos <= {N} GROUP BY experiment_mode, pos"


@query("linear_trend", with_ctes(f"""SELECT experiment_mode, round(regr_slope(m, pos), 6) AS slope,
  round(regr_intercept(m, pos), 6) AS intercept, round(AVG(m), 6) AS curve_mean
FROM ({_CURVE_SQL}) GROUP BY experiment_mode"""))
def linear_trend(spark, root):
    """G-14 + G-19: slope and intercept of the correct-rate curve on position, and its
    unweighted mean, by arm."""
    ld = PL.long_data(PL.long_table(spark, root), N)
    curve = C.position_mean_se(ld, "is_correct", N)
    t = M.linear_trend(curve, "mean", "pos", ["experiment_mode"]).join(
        curve.groupBy("experiment_mode").agg(F.avg("mean").alias("curve_mean")), "experiment_mode")
    return t.select("experiment_mode", *[r6(F.col(c)).alias(c) for c in ["slope", "intercept", "curve_mean"]])


@query("column_profile", with_ctes("SELECT column_name, non_null FROM (SELECT "
                                   + ", ".join(f"COUNT({c}) AS {c}" for c in _ENRICHED_COLS)
                                   + " FROM cohort) UNPIVOT (non_null FOR column_name IN ("
                                   + ", ".join(_ENRICHED_COLS) + "))"))
def column_profile(spark, root):
    """G-18: non-null count per column of the cohort table."""
    return M.column_profile(PL.cohort(spark, root).select(*_ENRICHED_COLS))


@query("max_session_start", with_ctes(
    "SELECT strftime(MAX(created_at), '%Y-%m-%d %H:%M:%S.%f') AS max_start FROM ld WHERE pos = 1 AND experiment_mode <> -1"))
def max_session_start(spark, root):
    """G-17: latest first-answer time in the experiment cohort."""
    e = PL.experiment_data(PL.long_table(spark, root), N).filter(F.col("pos") == 1)
    return e.agg(ts_text(F.max("created_at")).alias("max_start"))


@query("zero_gap_count", with_ctes(
    "SELECT COUNT(*) FILTER (WHERE time_diff = 0) AS zero_gaps, COUNT(time_diff) AS gaps, "
    "round(AVG(time_diff), 3) AS mean_gap FROM in_sessions"))
def zero_gap_count(spark, root):
    """G-21 + I-12: answers with a zero gap, gaps counted, overall mean gap."""
    s = PL.in_sessions(spark, root)
    return s.agg(F.count_if(F.col("time_diff") == 0).alias("zero_gaps"), F.count("time_diff").alias("gaps"),
                 F.round(F.avg("time_diff"), 3).alias("mean_gap"))


@query("head_sections", with_ctes(
    "SELECT user_id, gamecharacter_id, session_id, CAST(section_id AS DOUBLE) AS section_id, q_len, experiment_mode FROM long "
    "WHERE session_id = 1 AND pos = 1 ORDER BY created_at, user_id, gamecharacter_id, section_id LIMIT 5"))
def head_sections(spark, root):
    """T-02 / T-03: the five earliest first-session section rows (a head: the limit is the feature)."""
    r = PL.first_sessions(PL.long_table(spark, root)).filter(F.col("pos") == 1)
    h = M.head(r, ["created_at", "user_id", "gamecharacter_id", "section_id"], 5)
    return h.select(*SECTION_KEYS, "q_len", "experiment_mode").withColumn("section_id", F.col("section_id").cast("double"))


@query("distinct_arms", with_ctes("SELECT DISTINCT experiment_mode FROM long WHERE session_id = 1 ORDER BY 1"))
def distinct_arms(spark, root):
    """T-04: sorted arm labels."""
    return M.distinct_sorted(PL.first_sessions(PL.long_table(spark, root)), "experiment_mode")


@query("union_baseline", with_ctes("""SELECT experiment_mode, COUNT(*) AS n FROM (
  SELECT CAST(experiment_mode AS VARCHAR) AS experiment_mode FROM valid_rows
  UNION ALL SELECT 'non-filter' FROM ld WHERE pos = 1 AND experiment_mode = -1) GROUP BY experiment_mode"""))
def union_baseline(spark, root):
    """T-05: valid cohort plus the relabelled baseline cohort, rows per label."""
    long, first, ctrl, chk = frames(spark, root)
    from seqlab.plans.q_sequences import valid_keys
    v = valid_keys(chk).join(first.filter(F.col("pos") == 1), on=SECTION_KEYS).select("experiment_mode")
    b = PL.long_data(long, N).filter((F.col("pos") == 1) & (F.col("experiment_mode") == -1)).select("experiment_mode")
    u = M.union_labelled([(v, None), (b, "non-filter")])
    return M.frequency(u, ["experiment_mode"])


_PATTERN = C.DIFFICULTY_PATTERN


@query("positional_pattern", with_ctes(f"""SELECT experiment_mode, COUNT(*) AS n FROM (
  SELECT user_id, gamecharacter_id, session_id, experiment_mode FROM wlong WHERE n_questions >= {N}
  GROUP BY ALL HAVING SUM(CASE WHEN {" OR ".join(f"(spos = {p} AND difficulty_level = {v})" for p, v in _PATTERN.items())}
                          THEN 1 ELSE 0 END) = {len(_PATTERN)}) GROUP BY experiment_mode"""))
def positional_pattern(spark, root):
    """F-08 + F-04: sessions (>= 12 answers) whose difficulty at questions 1, 2, 10, 11, 12
    follows the pattern 1, 2, 1, 2, 2; counted by arm."""
    w = wlong(spark, root).filter(F.col("n_questions") >= N)
    p = M.positional_pattern(w, _PATTERN, SESSION_KEYS + ["experiment_mode"])
    return M.frequency(p, ["experiment_mode"])


@query("section_lookup", with_ctes(
    "SELECT user_id, session_id, experiment_mode, q_len FROM long WHERE session_id = 1 AND pos = 1 AND section_id = 1"))
def section_lookup(spark, root):
    """F-16: point lookup of first-session rows of one section, with projection."""
    r = rawdata_rows(spark, root)
    return r.filter(F.col("section_id") == 1).select("user_id", "session_id", "experiment_mode", "q_len")


@query("gap_histogram", with_ctes("""SELECT bin, round(lo + (bin - 1) * (hi - lo) / 10, 3) AS lo,
  round(lo + bin * (hi - lo) / 10, 3) AS hi, COUNT(*) AS n FROM (
  SELECT CAST(CASE WHEN r.hi = r.lo THEN 1 ELSE least(floor((x.time_diff - r.lo) / ((r.hi - r.lo) / 10)) + 1, 10) END AS INTEGER) AS bin,
         r.lo, r.hi
  FROM (SELECT time_diff FROM in_sessions WHERE time_diff < 120) x,
       (SELECT MIN(time_diff) AS lo, MAX(time_diff) AS hi FROM in_sessions WHERE time_diff < 120) r)
GROUP BY bin, lo, hi"""))
def gap_histogram(spark, root):
    """F-09 + G-12: ten equal bins of answer gaps shorter than 120 seconds."""
    s = PL.in_sessions(spark, root).filter(F.col("time_diff") < 120)
    h = M.histogram(s, "time_diff", 10)
    return h.select("bin", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "n")
