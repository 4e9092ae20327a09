"""Registered queries: sources, enrichment, sessionization (S, F, J, G-01..G-05, W, X)."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.scalar import array_text, volume_code
from seqlab.functions.timecols import parse_timestamp, ts_text
from seqlab.operators import enrich as E
from seqlab.operators.sessions import assign_sessions, session_table
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import mode_cte, register, session_ctes, volume_case, with_ctes
from seqlab.plans.registry import query
from seqlab.sources import adapter


def r6(c):
    return F.round(c, 6)


def _sql_text(col: str) -> str:
    return f"array_to_string(list_transform(array_agg({col} ORDER BY created_at, id), lambda x: coalesce(CAST(x AS VARCHAR), 'null')), ',')"


# --- Entry 3: the SQL session views (S-07, W-01, W-03, W-05, G-02, G-03, G-04, X-02) ------------

def _script_sessions(spark, root, with_arm: bool, gap_minutes: float):
    ev = PL.events(spark, root)
    log = PL.exp_log(spark, root) if with_arm else PL.answer_log(spark, root)
    log = log.withColumn("created_at", parse_timestamp(F.col("created_at_utc8")))
    q = PL.question_structure(spark, root).select("question_id", "difficulty_level", "subject_name", "section_name")
    u = adapter.user_info(ev).select("user_id", "school_city")
    joined = log.join(q, "question_id", "left").join(u, "user_id", "left")
    s = assign_sessions(joined, gap_seconds=gap_minutes * 60)
    arrays = {"is_corrects": "is_correct", "difficulties": "difficulty_level", "question_ids": "question_id"}
    if with_arm:
        arrays["experiment_index"] = "experiment_index"
    t = session_table(s, array_cols=arrays, first_cols={
        "subject_name": "subject_name", "section_id": "section_id",
        "section_name": "section_name", "school_city": "school_city"})
    return t.select(
        "user_id", "gamecharacter_id", "session_id",
        *[array_text(c).alias(c) for c in arrays],
        "subject_name", F.col("section_id").cast("double").alias("section_id"), "section_name", "school_city",
        ts_text("start_time").alias("session_start"), ts_text("end_time").alias("session_end"),
        "n_questions", r6(F.col("session_length")).alias("time_elapsed"))


def _script_sql(src: str, gap_minutes: float, with_arm: bool, prefix: str) -> str:
    register(f"{prefix}_src", f"""{prefix}_src AS (
  SELECT l.*, TRY_CAST(l.created_at_utc8 AS TIMESTAMP) AS created_at, q.difficulty_level, q.subject_name,
         q.section_name, u.school_city
  FROM {src} l LEFT JOIN question_structure q ON l.question_id = q.question_id
  LEFT JOIN user_info u ON l.user_id = u.user_id)""")
    register(prefix, session_ctes(f"{prefix}_src", prefix, gap_minutes))
    arm = f"{_sql_text('experiment_index')} AS experiment_index," if with_arm else ""
    return with_ctes(f"""SELECT user_id, gamecharacter_id, session_id,
  {_sql_text('is_correct')} AS is_corrects, {_sql_text('difficulty_level')} AS difficulties,
  {_sql_text('question_id')} AS question_ids, {arm}
  first(subject_name ORDER BY created_at, id) AS subject_name,
  CAST(first(section_id ORDER BY created_at, id) AS DOUBLE) AS section_id,
  first(section_name ORDER BY created_at, id) AS section_name,
  first(school_city ORDER BY created_at, id) AS school_city,
  strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS session_end,
  COUNT(*) AS n_questions,
  round(date_diff('microsecond', min(created_at), max(created_at)) / 1000000.0, 6) AS time_elapsed
FROM {prefix} GROUP BY user_id, gamecharacter_id, session_id""")


@query("exp_sessions", _script_sql("exp_log", 30, True, "xs30"))
def exp_sessions(spark, root):
    """Flagship: experiment-log sessions, 30-minute gap, per character."""
    return _script_sessions(spark, root, True, 30)


@query("sessions_no_arm", _script_sql("answer_log", 30, False, "as30"))
def sessions_no_arm(spark, root):
    """General answer-log sessions without the arm array."""
    return _script_sessions(spark, root, False, 30)


@query("naive_sessions", _script_sql("exp_log", 3600, True, "xs3600"))
def naive_sessions(spark, root):
    """Experiment-log sessions with the 3600-minute gap."""
    return _script_sessions(spark, root, True, 3600)


# --- Entry 1: enrichment and cohort (J-01..J-08, G-01, F-02, X-01, X-05) ------------------------

_ENRICHED_COLS = ["id", "user_id", "gamecharacter_id", "question_id", "section_id", "is_correct", "answer",
                  "is_self_selected", "user_grade", "school_city", "experiment_index", "section_name",
                  "difficulty_level", "subject_name", "book_volume_name", "course_id"]
_NULLABLE = ["experiment_index", "section_id", "is_correct", "difficulty_level"]
_ENRICHED_SQL = ", ".join(c if c not in _NULLABLE else f"CAST({c} AS DOUBLE) AS {c}" for c in _ENRICHED_COLS)


def _enriched_cols():
    # nullable integers are emitted as double on both sides (pandas turns them to float)
    return [F.col(c).cast("double").alias(c) if c in _NULLABLE else F.col(c) for c in _ENRICHED_COLS]


@query("enrich_answers", with_ctes(
    f"SELECT {_ENRICHED_SQL}, created_at_utc8 AS created_at FROM enriched"))
def enrich_answers(spark, root):
    """J-06: answers with user, first experiment arm, question and course attributes."""
    return PL.enriched(spark, root).select(*_enriched_cols(), F.col("created_at_utc8").alias("created_at"))


@query("cohort_filter", with_ctes(
    f"SELECT {_ENRICHED_SQL}, manual_book_vol, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM cohort"))
def cohort_filter(spark, root):
    """F-02 + X-01 + X-05: grade 5, math, controlled courses; parsed time and volume code."""
    return PL.cohort(spark, root).select(*_enriched_cols(), "manual_book_vol",
                                         ts_text("created_at").alias("created_at"))


@query("dedup_experiment_log", with_ctes(
    "SELECT user_id, gamecharacter_id, CAST(section_id AS DOUBLE) AS section_id, experiment_index FROM exp_dedup"))
def dedup_experiment_log(spark, root):
    """G-01: first experiment arm per (user, character, section)."""
    return E.dedup_experiment_log(PL.exp_log(spark, root)).withColumn("section_id", F.col("section_id").cast("double"))


@query("semi_join_users", with_ctes(
    "SELECT id, user_id, question_id, CAST(is_correct AS DOUBLE) AS is_correct FROM answer_log "
    "WHERE user_id IN (SELECT user_id FROM user_info WHERE user_grade = 5)"))
def semi_join_users(spark, root):
    """J-07 + F-17: answers of grade-5 users (left-semi join)."""
    ev = PL.events(spark, root)
    users = adapter.user_info(ev).filter(F.col("user_grade") == 5)
    return E.semi_join_users(PL.answer_log(spark, root), users).select(
        "id", "user_id", "question_id", F.col("is_correct").cast("double").alias("is_correct"))


@query("experiment_flag", with_ctes(
    "SELECT id, user_id, user_id IN (SELECT user_id FROM exp_log) AS is_experiment FROM answer_log"))
def experiment_flag(spark, root):
    """J-08: answer flagged when its user appears in the experiment log."""
    return E.experiment_flag(PL.answer_log(spark, root), PL.exp_log(spark, root)).select("id", "user_id", "is_experiment")


# --- pandas-pipeline sessions: numbering per user (D-01), modes (G-05) ----------------------------

register("ug30", session_ctes("cohort", "ug30", 30, flavour="user_global"))
_SK = ["user_id", "gamecharacter_id", "session_id"]
register("ug_arm", mode_cte("ug_arm", "ug30", _SK, "experiment_index", "experiment_mode"))
register("ug_vol", mode_cte("ug_vol", "ug30", _SK, "manual_book_vol", "manual_book_vol_mode"))
register("ug_subj", mode_cte("ug_subj", "ug30", _SK, "subject_name", "subject_name_mode"))
register("pc_vol", mode_cte("pc_vol", "in_sessions", _SK, "manual_book_vol", "manual_book_vol_mode"))
register("sess_arm_plain", mode_cte("sess_arm_plain", "in_sessions", _SK, "experiment_index", "experiment_mode"))
register("pc_subj", mode_cte("pc_subj", "in_sessions", _SK, "subject_name", "subject_name_mode"))


def _modes_sql(src, arm, vol, subj, arrays: bool):
    arr = ""
    if arrays:
        arr = (f"{_sql_text('is_correct')} AS is_correct, {_sql_text('difficulty_level')} AS difficulty_level, "
               f"{_sql_text('question_id')} AS question_id, {_sql_text('section_id')} AS section_id, "
               f"{_sql_text('answer')} AS answer,")
    return with_ctes(f"""SELECT s.*, CAST(a.experiment_mode AS DOUBLE) AS experiment_mode,
       CAST(v.manual_book_vol_mode AS DOUBLE) AS manual_book_vol_mode, j.subject_name_mode FROM (
  SELECT user_id, gamecharacter_id, session_id, {arr}
         strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') AS start_time,
         strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS end_time,
         round(date_diff('microsecond', min(created_at), max(created_at)) / 1000000.0, 6) AS session_length,
         COUNT(*) AS answer_length
  FROM {src} GROUP BY user_id, gamecharacter_id, session_id) s
JOIN {arm} a USING (user_id, gamecharacter_id, session_id)
JOIN {vol} v USING (user_id, gamecharacter_id, session_id)
JOIN {subj} j USING (user_id, gamecharacter_id, session_id)""")


def _session_modes(s, arrays: bool):
    arr = {"is_correct": "is_correct", "difficulty_level": "difficulty_level", "question_id": "question_id",
           "section_id": "section_id", "answer": "answer"} if arrays else None
    t = session_table(s, array_cols=arr, mode_cols={
        "experiment_mode": "experiment_index", "manual_book_vol_mode": "manual_book_vol",
        "subject_name_mode": "subject_name"})
    cols = ["user_id", "gamecharacter_id", "session_id"]
    if arrays:
        cols += [array_text(c).alias(c) for c in arr]
    return t.select(*cols, ts_text("start_time").alias("start_time"), ts_text("end_time").alias("end_time"),
                    r6(F.col("session_length")).alias("session_length"),
                    F.col("n_questions").alias("answer_length"),
                    F.col("experiment_mode").cast("double").alias("experiment_mode"),
                    F.col("manual_book_vol_mode").cast("double").alias("manual_book_vol_mode"), "subject_name_mode")


@query("sessions_user_global", _modes_sql("ug30", "ug_arm", "ug_vol", "ug_subj", True))
def sessions_user_global(spark, root):
    """The pandas pipeline: cohort answers, 30-minute gap, lag per character but
    session numbers per user (D-01), arrays, modes and duration per session."""
    s = assign_sessions(PL.cohort(spark, root), gap_seconds=30 * 60, flavour="user_global")
    return _session_modes(s, arrays=True)


@query("session_modes", _modes_sql("in_sessions", "sess_arm_plain", "pc_vol", "pc_subj", False))
def session_modes(spark, root):
    """G-05: modal arm, volume and subject per session (lowest on ties, null if none)."""
    return _session_modes(PL.in_sessions(spark, root), arrays=False)



@query("volume_codes", with_ctes(
    f"SELECT book_volume_name, {volume_case('book_volume_name')} AS vol, "
    f"{volume_case('book_volume_name', True)} AS vol_strict, "
    "COUNT(*) AS n FROM enriched GROUP BY book_volume_name"))
def volume_codes(spark, root):
    """X-05 / D-16: volume number from the volume name, lenient and strict."""
    return (PL.enriched(spark, root).groupBy("book_volume_name").agg(F.count(F.lit(1)).alias("n"))
            .select("book_volume_name", volume_code("book_volume_name").alias("vol"),
                    volume_code("book_volume_name", strict=True).alias("vol_strict"), "n"))
