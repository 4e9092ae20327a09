"""Registered queries for the remaining small operators (S-07, S-08, F-03, F-07, F-14, F-18, G-16, J-03, J-10, X-03)."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.timecols import epoch_micros, parse_timestamp, timestamp_from_millis, ts_text
from seqlab.operators import enrich as E
from seqlab.operators import inference as I
from seqlab.operators import sequences as S
from seqlab.operators.sections import SESSION_KEYS
from seqlab.operators.sessions import session_table
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import register, with_ctes
from seqlab.plans.q_inference import _valid_no0, did_sql, rounded, _obs_sql
from seqlab.plans.q_sessions import _script_sessions
from seqlab.plans.registry import query
from seqlab.sources.tables import hash_sample


def register_views(spark, root: str) -> list[str]:
    """S-07: the three named session datasets as temporary views."""
    names = {"exp_sessions": (True, 30), "sessions": (False, 30), "naive_exp_sessions": (True, 3600)}
    for view, (arm, gap) in names.items():
        _script_sessions(spark, root, arm, gap).createOrReplaceTempView(view)
    return list(names)


@query("named_views", with_ctes("""SELECT 'exp_sessions' AS view_name, COUNT(*) AS n FROM xs30 WHERE new_session = 1
UNION ALL SELECT 'sessions', COUNT(*) FROM as30 WHERE new_session = 1
UNION ALL SELECT 'naive_exp_sessions', COUNT(*) FROM xs3600 WHERE new_session = 1"""))
def named_views(spark, root):
    """S-07 + S-09: register the session views and count their rows through SQL."""
    register_views(spark, root)
    return spark.sql("""SELECT 'exp_sessions' AS view_name, COUNT(*) AS n FROM exp_sessions
      UNION ALL SELECT 'sessions', COUNT(*) FROM sessions
      UNION ALL SELECT 'naive_exp_sessions', COUNT(*) FROM naive_exp_sessions""")


@query("sample_sessions")
def sample_sessions(spark, root):
    """S-08: a stable one-in-three sample of sessions by key hash (the sample is the
    feature; no SQL oracle since DuckDB has no xxhash64)."""
    t = session_table(PL.in_sessions(spark, root))
    return hash_sample(t, SESSION_KEYS, 3, 0).select(*SESSION_KEYS, "n_questions")


@query("volume_prefix", with_ctes(
    "SELECT book_volume_name, COUNT(*) AS n FROM enriched WHERE regexp_matches(book_volume_name, '^五') "
    "GROUP BY book_volume_name"))
def volume_prefix(spark, root):
    """F-03: answers whose volume name starts with the grade-5 numeral."""
    return E.volume_prefix_filter(PL.enriched(spark, root), "五").groupBy("book_volume_name").agg(
        F.count(F.lit(1)).alias("n"))


@query("modal_value_filter", with_ctes("""SELECT a.experiment_mode, COUNT(*) AS n
FROM sess_arm a JOIN pc_vol v USING (user_id, gamecharacter_id, session_id)
JOIN pc_subj j USING (user_id, gamecharacter_id, session_id)
WHERE j.subject_name_mode = 'math' AND v.manual_book_vol_mode = 3 GROUP BY a.experiment_mode"""))
def modal_value_filter(spark, root):
    """F-07: sessions whose modal subject is math and modal volume is 3, by arm."""
    t = session_table(PL.in_sessions(spark, root), mode_cols={
        "experiment_mode": "experiment_index", "vol_mode": "manual_book_vol", "subject_mode": "subject_name"})
    t = t.withColumn("experiment_mode", F.coalesce(F.col("experiment_mode"), F.lit(-1)))
    return t.filter((F.col("subject_mode") == "math") & (F.col("vol_mode") == 3)).groupBy("experiment_mode").agg(
        F.count(F.lit(1)).alias("n"))


register("q1c_long", """q1c_long AS (SELECT l.* FROM vlong l WHERE EXISTS (
  SELECT 1 FROM vlong f WHERE f.user_id = l.user_id AND f.gamecharacter_id = l.gamecharacter_id
    AND f.session_id = l.session_id AND f.section_id = l.section_id AND f.pos = 1 AND f.is_correct = 1))""")


@query("did_q1_correct", did_sql("didq1c", _obs_sql(2, 11, src="q1c_long"), "1"))
def did_q1_correct(spark, root):
    """F-14 + I-02: DiD 2-11 on valid sections whose first answer was correct."""
    v = _valid_no0(spark, root)
    keys = ["user_id", "gamecharacter_id", "session_id", "section_id"]
    ok = v.filter((F.col("pos") == 1) & (F.col("is_correct") == 1)).select(*keys)
    v = v.join(ok, on=keys, how="left_semi")
    return rounded(I.did(I.did_observations(v, 2, 11), 1))


@query("length_violations", with_ctes(
    "SELECT experiment_mode, COUNT(*) AS n_short FROM long WHERE session_id = 1 AND pos = 1 AND q_len < 12 "
    "GROUP BY experiment_mode"))
def length_violations(spark, root):
    """F-18: first-session sections that break the 'at least 12 answers' assertion, by arm."""
    r = PL.first_sessions(PL.sections(spark, root))
    return r.filter(F.col("q_len") < 12).groupBy("experiment_mode").agg(F.count(F.lit(1)).alias("n_short"))


@query("distinct_answers", with_ctes(
    "SELECT COUNT(*) AS n_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM answer_log)) AS n_distinct FROM answer_log"))
def distinct_answers(spark, root):
    """G-16: rows and distinct rows of the answer log (full-row distinct)."""
    a = PL.answer_log(spark, root)
    n = a.agg(F.count(F.lit(1)).alias("n_rows"))
    d = a.distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    return n.select("n_rows", d.select("n_distinct").scalar().alias("n_distinct"))


@query("enrich_by_id", with_ctes("""SELECT a.id, a.user_id, CAST(e.experiment_index AS DOUBLE) AS experiment_index
FROM answer_log a LEFT JOIN exp_log e ON a.id = e.id"""))
def enrich_by_id(spark, root):
    """J-03: the older enrichment, experiment arm joined on the answer id."""
    j = PL.answer_log(spark, root).join(PL.exp_log(spark, root).select("id", "experiment_index"), "id", "left")
    return j.select("id", "user_id", F.col("experiment_index").cast("double").alias("experiment_index"))


@query("section_lookup_by_name", with_ctes(
    "SELECT section_name, arg_max(section_id, question_id) AS section_id FROM question_structure GROUP BY section_name"))
def section_lookup_by_name(spark, root):
    """J-10: section name -> id, the last duplicate (highest question id) wins."""
    q = PL.question_structure(spark, root)
    return S.section_id_lookup(q, order_col="question_id")


@query("millis_roundtrip", with_ctes("""SELECT id,
  strftime(make_timestamp(CAST(floor(epoch_us(TRY_CAST(created_at_utc8 AS TIMESTAMP)) / 1000) AS BIGINT) * 1000), '%Y-%m-%d %H:%M:%S.%f') AS created_ms
FROM answer_log"""))
def millis_roundtrip(spark, root):
    """X-03 / D-13: epoch milliseconds -> timestamp (what a JSON round trip keeps)."""
    a = PL.answer_log(spark, root)
    ms = F.floor(epoch_micros(parse_timestamp("created_at_utc8")) / 1000)
    return a.select("id", ts_text(timestamp_from_millis(ms)).alias("created_ms"))


register("mc_keep", """mc_keep AS (
  SELECT s.user_id, s.gamecharacter_id, s.session_id, s.section_id
  FROM mc_sub s LEFT JOIN mc_modes m ON s.experiment_mode = m.experiment_mode AND s.pos = m.pos
  GROUP BY s.user_id, s.gamecharacter_id, s.session_id, s.section_id
  HAVING SUM(CASE WHEN s.question_id = m.q_mode THEN 1 ELSE 0 END) = 6)""")
register("mc_long", """mc_long AS (SELECT l.* FROM ld l JOIN mc_keep k ON l.user_id = k.user_id
  AND l.gamecharacter_id = k.gamecharacter_id AND l.session_id = k.session_id AND l.section_id = k.section_id)""")


@query("did_modal_conformant", did_sql("didmc", _obs_sql(1, 10, where="TRUE", src="mc_long"), "1"))
def did_modal_conformant(spark, root):
    """Q-20 + I-01: DiD 1-10 on first sections (>= 12 answers) whose questions match
    their arm's modal question at positions 1, 2, 6, 10, 11, 12; all arms, ref arm 1."""
    from seqlab.operators.sections import SECTION_KEYS
    from seqlab.plans.q_sequences import _MC_POS
    ld = PL.long_data(PL.long_table(spark, root), 12)
    keep = S.modal_conformity(ld, _MC_POS).filter("all_mode").select(*SECTION_KEYS)
    rows = ld.join(keep, on=SECTION_KEYS, how="left_semi")
    return rounded(I.did(I.did_observations(rows, 1, 10), 1))
