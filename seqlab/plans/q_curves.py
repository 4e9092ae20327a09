"""Registered queries: position curves and step times (Q-11..Q-19, Q-21..Q-23, W-06, W-07)."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.operators import curves as C
from seqlab.operators import sequences as S
from seqlab.operators.sections import SECTION_KEYS
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import register, with_ctes
from seqlab.plans.q_sequences import N, first_n_long, frames, ok_sql, valid_keys, valid_rows
from seqlab.plans.registry import query

ON4 = ("l.user_id = v.user_id AND l.gamecharacter_id = v.gamecharacter_id AND l.session_id = v.session_id "
       "AND l.section_id = v.section_id")


def r6(c):
    return F.round(c, 6)


def r3(c):
    """Time values (seconds) are compared at millisecond precision: sums of
    microsecond-derived doubles differ in the last bits between engines."""
    return F.round(c, 3)


register("raw_f12", f"raw_f12 AS (SELECT * FROM chk WHERE experiment_mode <> -1 AND {ok_sql('least(q_len, 12)')})")
register("vlong", f"vlong AS (SELECT l.* FROM long l JOIN valid_rows v ON {ON4})")
register("wlong", """wlong AS (
  SELECT i.*, CAST(ROW_NUMBER() OVER (PARTITION BY i.user_id, i.gamecharacter_id, i.session_id
                                     ORDER BY i.created_at, i.id) AS INTEGER) AS spos,
         COUNT(*) OVER (PARTITION BY i.user_id, i.gamecharacter_id, i.session_id) AS n_questions,
         CAST(a.experiment_mode AS INTEGER) AS experiment_mode
  FROM in_sessions i JOIN sess_arm a
    ON i.user_id = a.user_id AND i.gamecharacter_id = a.gamecharacter_id AND i.session_id = a.session_id)""")


def valid_long(spark, root):
    """First n answers of the valid cohort in long form (from the validity aggregate)."""
    return first_n_long(valid_rows(frames(spark, root)[3]))


def wlong(spark, root):
    return C.whole_session_long(PL.in_sessions(spark, root))


@query("retention_by_arm", with_ctes(f"""SELECT experiment_mode, i,
  round(AVG(CASE WHEN q_len >= i THEN 1.0 ELSE 0.0 END), 6) AS retention_rate
FROM raw_f12 CROSS JOIN range(1, {N + 1}) r(i) GROUP BY experiment_mode, i"""))
def retention_by_arm(spark, root):
    """Q-11: share of tolerant-valid first sections reaching question i, by arm."""
    chk = frames(spark, root)[3].filter(F.col("experiment_mode") != -1)
    rows = S.seq_valid_tolerant(chk, N).filter(f"seq_valid_less{N}inc")
    out = C.retention(rows, N)
    return out.select("experiment_mode", F.col("i").cast("long").alias("i"), r6(F.col("retention_rate")).alias("retention_rate"))


@query("difficulty_mix", with_ctes(f"""SELECT experiment_mode, pos, level,
  round(SUM(CASE WHEN difficulty_level = level THEN 1 ELSE 0 END) / COUNT(difficulty_level), 6) AS share
FROM vlong CROSS JOIN (VALUES (1), (2), (3)) lv(level) WHERE pos <= {N} GROUP BY experiment_mode, pos, level"""))
def difficulty_mix(spark, root):
    """Q-12: difficulty shares per arm and position in the valid cohort."""
    out = C.difficulty_mix(valid_long(spark, root), N)
    return out.select("experiment_mode", "pos", "level", r6(F.col("share")).alias("share"))


@query("position_curve", with_ctes(f"""SELECT experiment_mode, pos,
  round(AVG(is_correct), 6) AS mean_correct, round(stddev_pop(is_correct) / sqrt(COUNT(*)), 6) AS se_correct,
  round(AVG(difficulty_level), 6) AS mean_difficulty,
  round(stddev_pop(difficulty_level) / sqrt(COUNT(*)), 6) AS se_difficulty
FROM ld WHERE pos <= {N} GROUP BY experiment_mode, pos"""))
def position_curve(spark, root):
    """Q-13: correctness and difficulty by position, mean and SE, per arm (first
    sessions with at least 12 answers)."""
    ld = PL.long_data(PL.long_table(spark, root), N)
    j = C.position_mean_se(ld, ["is_correct", "difficulty_level"], N, names=["correct", "difficulty"])
    return j.select("experiment_mode", "pos", *[r6(F.col(c)).alias(c) for c in
                                                ["mean_correct", "se_correct", "mean_difficulty", "se_difficulty"]])


@query("baseline_curve", with_ctes(f"""SELECT pos, round(m, 6) AS mean, round(se, 6) AS se,
  round(m - 1.96 * se, 6) AS lower, round(m + 1.96 * se, 6) AS upper FROM (
  SELECT pos, AVG(is_correct) AS m, stddev_pop(is_correct) / sqrt(COUNT(*)) AS se
  FROM ld WHERE experiment_mode = -1 AND pos <= {N} GROUP BY pos)"""))
def baseline_curve(spark, root):
    """Q-14: baseline (no arm) correctness curve with a 1.96 SE band; first n of
    every session (D-07)."""
    ld = PL.long_data(PL.long_table(spark, root), N).filter(F.col("experiment_mode") == -1)
    out = C.band(C.position_mean_se(ld, "is_correct", N, by=[]))
    return out.select("pos", *[r6(F.col(c)).alias(c) for c in ["mean", "se", "lower", "upper"]])


@query("gap_curve", with_ctes(f"""SELECT g.experiment_mode, g.j, round(g.mean_gap, 3) AS mean_gap,
  round(g.sd / sqrt(s.ns), 3) AS se_gap,
  round(SUM(g.mean_gap) OVER (PARTITION BY g.experiment_mode ORDER BY g.j), 3) AS cum_gap,
  round(SUM(g.sd / sqrt(s.ns)) OVER (PARTITION BY g.experiment_mode ORDER BY g.j), 3) AS cum_se
FROM (SELECT experiment_mode, spos - 1 AS j, AVG(time_diff) AS mean_gap, stddev_pop(time_diff) AS sd
      FROM wlong WHERE n_questions >= {N} AND spos BETWEEN 2 AND {N + 1} GROUP BY experiment_mode, spos - 1) g
JOIN (SELECT experiment_mode, COUNT(*) AS ns FROM wlong WHERE n_questions >= {N} AND spos = 1
      GROUP BY experiment_mode) s ON g.experiment_mode = s.experiment_mode"""))
def gap_curve(spark, root):
    """Q-15 + W-06: mean and SE of answer gaps by question and their running sums."""
    out = C.gap_curve(wlong(spark, root), N)
    return out.select("experiment_mode", "j", *[r3(F.col(c)).alias(c) for c in ["mean_gap", "se_gap", "cum_gap", "cum_se"]])


register("vsteps", f"""vsteps AS (
  SELECT *, date_diff('microsecond', LAG(created_at) OVER w, created_at) / 1000000.0 AS delta,
         date_diff('microsecond', FIRST(created_at) OVER w, created_at) / 1000000.0 AS acc
  FROM vlong WHERE pos <= {N}
  WINDOW w AS (PARTITION BY user_id, gamecharacter_id, session_id, section_id ORDER BY pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")


@query("step_median", with_ctes(
    "SELECT experiment_mode, pos, round(quantile_cont(delta, 0.5), 3) AS median_delta "
    "FROM vsteps WHERE pos >= 2 GROUP BY experiment_mode, pos"))
def step_median(spark, root):
    """Q-16: median time spent on question p (p = 2..12) by arm, valid cohort."""
    st = C.step_times(valid_long(spark, root), N)
    out = C.median_by_position(st, "delta")
    return out.select("experiment_mode", "pos", r3(F.col("median_delta")).alias("median_delta"))


@query("accumulated_median", with_ctes(
    "SELECT experiment_mode, pos, round(quantile_cont(acc, 0.5), 3) AS median_acc "
    "FROM vsteps WHERE pos >= 2 GROUP BY experiment_mode, pos"))
def accumulated_median(spark, root):
    """Q-16: median time from question 1 to question p by arm, valid cohort."""
    st = C.step_times(valid_long(spark, root), N)
    out = C.median_by_position(st, "acc")
    return out.select("experiment_mode", "pos", r3(F.col("median_acc")).alias("median_acc"))


@query("ragged_curve", with_ctes("""SELECT experiment_mode, pos, round(AVG(is_correct), 6) AS mean,
  round(CASE WHEN COUNT(is_correct) = 1 THEN 0.0 ELSE stddev_pop(is_correct) / sqrt(COUNT(is_correct)) END, 6) AS spread,
  COUNT(is_correct) AS n
FROM long WHERE session_id = 1 GROUP BY experiment_mode, pos"""))
def ragged_curve(spark, root):
    """Q-17: correctness by position over all lengths of first sections."""
    out = C.ragged_curve(PL.first_sessions(PL.long_table(spark, root)))
    return out.select("experiment_mode", "pos", r6(F.col("mean")).alias("mean"), r6(F.col("spread")).alias("spread"), "n")


@query("rate_by_difficulty", with_ctes(f"""SELECT g.difficulty_level, g.pos, round(r.rate, 6) AS rate
FROM (SELECT CAST(lv AS INTEGER) AS difficulty_level, CAST(p AS INTEGER) AS pos
      FROM (VALUES (1), (2), (3)) a(lv) CROSS JOIN range(1, {N + 1}) b(p)) g
LEFT JOIN (SELECT difficulty_level, pos, AVG(is_correct) AS rate FROM ld WHERE pos <= {N}
           GROUP BY difficulty_level, pos) r
  ON g.difficulty_level = r.difficulty_level AND g.pos = r.pos"""))
def rate_by_difficulty(spark, root):
    """Q-18: correct rate by difficulty level and position (full grid)."""
    out = C.rate_by_difficulty(PL.long_data(PL.long_table(spark, root), N), N)
    return out.select("difficulty_level", "pos", r6(F.col("rate")).alias("rate"))


_RATE_POS = [1, 2, 10, 11, 12]


@query("rates_at_positions", with_ctes(f"""SELECT experiment_mode, 'Q' || CAST(pos AS VARCHAR) AS position,
  round(AVG(is_correct), 6) AS rate,
  round(CASE WHEN COUNT(*) <= 1 THEN 0.0 ELSE 1.83 * stddev_samp(is_correct) / sqrt(COUNT(*)) END, 6) AS sem
FROM ld WHERE pos IN {tuple(_RATE_POS)} AND is_correct IS NOT NULL GROUP BY experiment_mode, pos"""))
def rates_at_positions(spark, root):
    """Q-19: rate and 1.83-SE bar at questions 1, 2, 10, 11, 12 by arm."""
    out = C.rates_at_positions(PL.long_data(PL.long_table(spark, root), N), _RATE_POS)
    return out.select("experiment_mode", "position", r6(F.col("rate")).alias("rate"), r6(F.col("sem")).alias("sem"))


@query("rates_pivot", with_ctes(f"""SELECT experiment_mode,
  {", ".join(f"round(AVG(CASE WHEN pos = {p} THEN is_correct END), 6) AS rate_Q{p}" for p in (1, 10))}
FROM ld WHERE pos IN (1, 10) GROUP BY experiment_mode"""))
def rates_pivot(spark, root):
    """G-11: arm x position pivot of the correct rate at questions 1 and 10."""
    ld = PL.long_data(PL.long_table(spark, root), N).filter(F.col("pos").isin(1, 10))
    p = ld.groupBy("experiment_mode").pivot("pos", [1, 10]).agg(F.avg("is_correct"))
    return p.select("experiment_mode", r6(F.col("1")).alias("rate_Q1"), r6(F.col("10")).alias("rate_Q10"))


@query("difficulty_counts", with_ctes(f"""SELECT user_id, gamecharacter_id, session_id, section_id, experiment_mode,
  round(AVG(difficulty_level), 6) AS difficulty_mean,
  {", ".join(f"CAST(SUM(CASE WHEN difficulty_level = {lv} THEN 1 ELSE 0 END) AS BIGINT) AS n_level{lv}" for lv in (1, 2, 3))}
FROM ld WHERE pos <= {N} GROUP BY user_id, gamecharacter_id, session_id, section_id, experiment_mode"""))
def difficulty_counts(spark, root):
    """Q-21: mean difficulty and level counts over the first 12 answers."""
    out = C.first_n_profile(PL.long_data(PL.long_table(spark, root), N), N)
    return out.select(*SECTION_KEYS, "experiment_mode", r6(F.col("difficulty_mean")).alias("difficulty_mean"),
                      *[F.col(f"n_level{lv}").cast("long").alias(f"n_level{lv}") for lv in (1, 2, 3)])


@query("session_totals", with_ctes(f"""SELECT user_id, gamecharacter_id, session_id, experiment_mode, n_questions,
  round(COALESCE(SUM(time_diff), 0.0), 3) AS total_length,
  round(SUM(CASE WHEN spos BETWEEN 2 AND {N + 1} THEN time_diff END), 3) AS gap_1_n,
  CAST(n_questions > {N} AS INTEGER) AS over_n
FROM wlong GROUP BY user_id, gamecharacter_id, session_id, experiment_mode, n_questions"""))
def session_totals(spark, root):
    """Q-22 + F-15: total time, count, over-12 flag and time over items 1..12 per session."""
    out = C.session_totals(wlong(spark, root), N)
    return out.select("user_id", "gamecharacter_id", "session_id", "experiment_mode", "n_questions",
                      r3(F.col("total_length")).alias("total_length"), r3(F.col("gap_1_n")).alias("gap_1_n"), "over_n")


@query("head_tail", with_ctes("""SELECT level, CAST(section AS DOUBLE) AS section, round(AVG(head_corr), 6) AS head_mean,
  round(AVG(tail_corr), 6) AS tail_mean, COUNT(head_corr) AS n FROM (
  SELECT user_id, gamecharacter_id, session_id,
         MAX(CASE WHEN spos = 3 THEN is_correct END) AS head_corr, MAX(CASE WHEN spos = 13 THEN is_correct END) AS tail_corr,
         MAX(CASE WHEN spos = 3 THEN difficulty_level END) AS head_diff,
         MAX(CASE WHEN spos = 13 THEN difficulty_level END) AS tail_diff,
         MAX(CASE WHEN spos = 1 THEN section_id END) AS section
  FROM wlong WHERE n_questions > 12 GROUP BY user_id, gamecharacter_id, session_id)
JOIN range(1, 4) l(level) ON head_diff = level AND tail_diff = level GROUP BY level, section HAVING COUNT(head_corr) > 10"""))
def head_tail(spark, root):
    """Q-23: head (item 2) vs tail (item 12) correctness at difficulty 1, 2 and 3, per first section."""
    w = wlong(spark, root)
    levels = [C.head_tail(w, level=v).withColumn("level", F.lit(v).cast("long")) for v in (1, 2, 3)]
    out = levels[0].unionByName(levels[1]).unionByName(levels[2])
    return out.select("level", F.col("section").cast("double").alias("section"), r6(F.col("head_mean")).alias("head_mean"),
                      r6(F.col("tail_mean")).alias("tail_mean"), "n")


@query("ragged_curve_std", with_ctes("""SELECT experiment_mode, pos, round(AVG(is_correct), 6) AS mean,
  round(CASE WHEN COUNT(is_correct) = 1 THEN 0.0 ELSE stddev_pop(is_correct) END, 6) AS spread,
  COUNT(is_correct) AS n
FROM long WHERE session_id = 1 GROUP BY experiment_mode, pos"""))
def ragged_curve_std(spark, root):
    """Q-17, older variant: spread is the population std (not divided by sqrt(n))."""
    out = C.ragged_curve(PL.first_sessions(PL.long_table(spark, root)), spread="std")
    return out.select("experiment_mode", "pos", r6(F.col("mean")).alias("mean"), r6(F.col("spread")).alias("spread"), "n")
