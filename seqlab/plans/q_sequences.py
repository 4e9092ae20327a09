"""Registered queries: section split, control sequences, validity and match curves (Q-01..Q-10, Q-20, Q-24)."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.scalar import array_text
from seqlab.functions.timecols import ts_text
from seqlab.operators import sequences as S
from seqlab.operators.sections import SECTION_KEYS, section_arrays
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import mode_cte, register, with_ctes
from seqlab.plans.registry import query

N = PL.P.n
KEYS_SQL = "user_id, gamecharacter_id, session_id, section_id"
# a section may be null, so it leaves a query as a double in both engines
KEYS_OUT_SQL = "user_id, gamecharacter_id, session_id, CAST(section_id AS DOUBLE) AS section_id"


def keys_out():
    return [*SECTION_KEYS[:-1], F.col(SECTION_KEYS[-1]).cast("double").alias(SECTION_KEYS[-1])]


register("ld", "ld AS (SELECT * FROM long WHERE session_id = 1 AND q_len >= 12)")
register("ctrl", mode_cte("ctrl", "(SELECT * FROM ld WHERE experiment_mode <> -1 AND pos <= 12)",
                          ["section_id", "experiment_mode", "pos"], "question_id", "cq"))
register("ctrl_keys", "ctrl_keys AS (SELECT DISTINCT section_id, experiment_mode FROM ctrl)")
register("chk", """chk AS (
  SELECT p.*, (k.section_id IS NOT NULL) AS has_control FROM (
    SELECT l.user_id, l.gamecharacter_id, l.session_id, l.section_id, l.experiment_mode, l.q_len,
           MIN(CASE WHEN c.cq IS DISTINCT FROM l.question_id THEN l.pos END) AS first_mismatch
    FROM long l LEFT JOIN ctrl c
      ON l.section_id = c.section_id AND l.experiment_mode = c.experiment_mode AND l.pos = c.pos
    WHERE l.session_id = 1 AND l.pos <= 12
    GROUP BY l.user_id, l.gamecharacter_id, l.session_id, l.section_id, l.experiment_mode, l.q_len) p
  LEFT JOIN ctrl_keys k ON p.section_id = k.section_id AND p.experiment_mode = k.experiment_mode)""")
register("expd", "expd AS (SELECT * FROM chk WHERE q_len >= 12 AND experiment_mode <> -1)")
register("valid_rows", f"""valid_rows AS (
  SELECT * FROM expd WHERE has_control AND (first_mismatch IS NULL OR first_mismatch > {N}))""")


def ok_sql(k: str) -> str:
    return f"(has_control AND (first_mismatch IS NULL OR first_mismatch > {k}))"


# Spark side shared frames ------------------------------------------------------------------------

def frames(spark, root):
    long = PL.long_table(spark, root)
    first = PL.first_sessions(long)
    ctrl = S.modal_control(PL.long_data(long, N), N)
    chk = S.first_mismatch(first, ctrl, N, carry=CARRY)
    return long, first, ctrl, chk


# fields of the first n answers carried with each section row (see S.first_mismatch)
CARRY = ["id", "question_id", "is_correct", "difficulty_level", "created_at"]


def valid_rows(chk):
    """Section rows of the ``valid`` cohort: all n questions equal the control."""
    return S.seq_valid(experiment_checked(chk), N).filter("seq_valid")


def first_n_long(rows):
    """Expand the carried first-n answers of section rows into long form."""
    return rows.select(*SECTION_KEYS, "experiment_mode", "q_len", F.inline("first_n"))


def experiment_checked(chk):
    return chk.filter((F.col("q_len") >= N) & (F.col("experiment_mode") != -1))


def valid_keys(chk):
    return valid_rows(chk).select(*SECTION_KEYS)


@query("control_sequences", with_ctes("SELECT section_id, experiment_mode, pos, cq FROM ctrl"))
def control_sequences(spark, root):
    """J-09 input: modal control sequence per (section, arm), long form."""
    return frames(spark, root)[2]


@query("control_wide", with_ctes(
    "SELECT section_id, experiment_mode, "
    + ", ".join(f"max(CASE WHEN pos = {i} THEN cq END) AS Q{i}" for i in range(1, N + 1))
    + " FROM ctrl GROUP BY section_id, experiment_mode"))
def control_wide(spark, root):
    """Q-05 / G-11: control sequences as Q1..Q12 columns."""
    return S.control_to_wide(frames(spark, root)[2], N)


def _arr_sql(col):
    return (f"array_to_string(list_transform(array_agg({col} ORDER BY pos), "
            f"lambda x: coalesce(CAST(x AS VARCHAR), 'null')), ',')")


@query("section_split", with_ctes(f"""SELECT {KEYS_OUT_SQL}, q_len, experiment_mode,
  {_arr_sql('question_id')} AS question_id, {_arr_sql('is_correct')} AS is_correct,
  {_arr_sql('difficulty_level')} AS difficulty_level, {_arr_sql('experiment_index')} AS experiment_index,
  strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS create_at
FROM long GROUP BY {KEYS_SQL}, q_len, experiment_mode"""))
def section_split(spark, root):
    """Q-01 / Q-02: one row per (session, section) with parallel arrays in time order."""
    long = PL.long_table(spark, root).withColumn("_t", ts_text("created_at"))
    fields = ["question_id", "is_correct", "difficulty_level", "experiment_index", "_t"]
    out = section_arrays(long, fields)
    return out.select(*keys_out(), "q_len", "experiment_mode",
                      *[array_text(c).alias(c) for c in fields[:-1]], F.get("_t", 0).alias("create_at"))


@query("seq_valid", with_ctes(f"""SELECT {KEYS_OUT_SQL}, experiment_mode,
  ({ok_sql(str(N))} AND q_len >= {N}) AS seq_valid
FROM expd"""))
def seq_valid(spark, root):
    """Q-06: exact validity of the first 12 questions."""
    e = experiment_checked(frames(spark, root)[3])
    e = S.seq_valid(e, N)
    return e.select(*keys_out(), "experiment_mode", "seq_valid")


@query("seq_valid_tolerant", with_ctes(f"""SELECT {KEYS_OUT_SQL}, experiment_mode, q_len,
  {", ".join(f"{ok_sql(f'least(q_len, {i})')} AS seq_valid_less{i}inc" for i in range(1, N + 1))}
FROM chk WHERE experiment_mode <> -1"""))
def seq_valid_tolerant(spark, root):
    """Q-07: tolerant validity for i = 1..12 on first sessions of any length inside an arm."""
    c = frames(spark, root)[3].filter(F.col("experiment_mode") != -1)
    for i in range(1, N + 1):
        c = S.seq_valid_tolerant(c, i)
    return c.select(*keys_out(), "experiment_mode", "q_len", *[f"seq_valid_less{i}inc" for i in range(1, N + 1)])


_PREFIX_SQL = f"""SELECT {{by}} i, round(AVG(CASE WHEN {ok_sql('i')} THEN 1.0 ELSE 0.0 END), 6) AS match_ratio
FROM expd CROSS JOIN range(1, {N + 1}) r(i) GROUP BY {{by}} i"""


@query("prefix_ratio", with_ctes(_PREFIX_SQL.format(by="")))
def prefix_ratio(spark, root):
    """Q-08: share of the experiment cohort whose first i questions equal the control."""
    out = S.prefix_curve(experiment_checked(frames(spark, root)[3]), N)
    return out.select(F.col("i").cast("long").alias("i"), F.round("match_ratio", 6).alias("match_ratio"))


@query("prefix_ratio_by_arm", with_ctes(_PREFIX_SQL.format(by="experiment_mode,")))
def prefix_ratio_by_arm(spark, root):
    """Q-09: prefix-match share by arm."""
    out = S.prefix_curve(experiment_checked(frames(spark, root)[3]), N, by=["experiment_mode"])
    return out.select("experiment_mode", F.col("i").cast("long").alias("i"),
                      F.round("match_ratio", 6).alias("match_ratio"))


@query("position_match_by_arm", with_ctes(f"""SELECT l.experiment_mode, l.pos,
  round(AVG(CASE WHEN l.question_id = c.cq THEN 1.0 ELSE 0.0 END), 6) AS match_ratio
FROM ld l LEFT JOIN ctrl c ON l.section_id = c.section_id AND l.experiment_mode = c.experiment_mode AND l.pos = c.pos
WHERE l.experiment_mode <> -1 AND l.pos <= {N}
GROUP BY l.experiment_mode, l.pos"""))
def position_match_by_arm(spark, root):
    """Q-10: per-position match share by arm."""
    long, first, ctrl, chk = frames(spark, root)
    e = PL.experiment_data(long, N)
    out = S.position_match(e, ctrl, N)
    return out.select("experiment_mode", "pos", F.round("match_ratio", 6).alias("match_ratio"))


_MC_POS = (1, 2, 6, 10, 11, 12)
register("mc_sub", f"mc_sub AS (SELECT * FROM ld WHERE pos IN {_MC_POS})")
register("mc_modes", mode_cte("mc_modes", "mc_sub", ["experiment_mode", "pos"], "question_id", "q_mode"))
register("mc_modes3", mode_cte("mc_modes3", "(SELECT * FROM mc_sub WHERE experiment_mode = 3)",
                               ["pos"], "question_id", "q_mode"))


def _mc_sql(modes: str, on: str) -> str:
    return with_ctes(f"""SELECT experiment_mode, all_mode, COUNT(*) AS n FROM (
  SELECT s.user_id, s.gamecharacter_id, s.session_id, s.section_id, s.experiment_mode,
         SUM(CASE WHEN s.question_id = m.q_mode THEN 1 ELSE 0 END) = {len(_MC_POS)} AS all_mode
  FROM mc_sub s LEFT JOIN {modes} m ON {on}
  GROUP BY s.user_id, s.gamecharacter_id, s.session_id, s.section_id, s.experiment_mode)
GROUP BY experiment_mode, all_mode""")


@query("modal_conformity", _mc_sql("mc_modes", "s.experiment_mode = m.experiment_mode AND s.pos = m.pos"))
def modal_conformity(spark, root):
    """Q-20 + G-07: rows whose questions equal their arm's modal question at
    positions 1, 2, 6, 10, 11, 12, counted by arm."""
    ld = PL.long_data(PL.long_table(spark, root), N)
    mc = S.modal_conformity(ld, _MC_POS)
    return mc.groupBy("experiment_mode", "all_mode").agg(F.count(F.lit(1)).alias("n"))


@query("modal_conformity_arm3", _mc_sql("mc_modes3", "s.pos = m.pos"))
def modal_conformity_arm3(spark, root):
    """Q-20 as published (D-05): every row compared with arm 3's modes."""
    ld = PL.long_data(PL.long_table(spark, root), N)
    mc = S.modal_conformity(ld, _MC_POS, mode_arm=3)
    return mc.groupBy("experiment_mode", "all_mode").agg(F.count(F.lit(1)).alias("n"))


@query("melt_positions", with_ctes(f"""SELECT l.user_id, l.section_id, l.experiment_mode, l.pos AS position,
  CAST(l.is_correct AS DOUBLE) AS value
FROM long l JOIN valid_rows v ON l.user_id = v.user_id AND l.gamecharacter_id = v.gamecharacter_id
  AND l.session_id = v.session_id AND l.section_id = v.section_id
WHERE l.pos IN (1, 10)"""))
def melt_positions(spark, root):
    """Q-24: q_1_corr and q_10_corr of the valid cohort in long form."""
    v = first_n_long(valid_rows(frames(spark, root)[3]))
    out = S.melt_positions(v, [1, 10], "is_correct", ["user_id", "section_id", "experiment_mode"])
    return out.withColumn("value", F.col("value").cast("double"))
