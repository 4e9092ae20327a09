"""Registered queries: distinct input views, text times, key sample, wide control, array functions, length and arm filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from seqlab.functions.scalar import all_equal_first, array_text, count_value, safe_get
from seqlab.functions.timecols import parse_timestamp, ts_text
from seqlab.operators import sequences as S
from seqlab.operators import summary as M
from seqlab.operators.sections import SESSION_KEYS
from seqlab.operators.sessions import session_table
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import register, with_ctes
from seqlab.plans.q_curves import wlong
from seqlab.plans.q_sequences import N, frames
from seqlab.plans.q_sessions import _ENRICHED_COLS, _SK, _sql_text
from seqlab.plans.registry import query
from seqlab.sources import adapter

# --- S-02: the four inputs as distinct named views -------------------------------------------------

_INPUTS = ["answer_log", "exp_log", "question_structure", "user_info"]


def register_input_views(spark, root: str) -> list[str]:
    """S-02: full-row distinct of the four inputs as temporary views (``input_<name>``)."""
    frames_ = {"answer_log": PL.answer_log(spark, root), "exp_log": PL.exp_log(spark, root),
               "question_structure": PL.question_structure(spark, root), "user_info": adapter.user_info(PL.events(spark, root))}
    for name in _INPUTS:
        frames_[name].distinct().createOrReplaceTempView(f"input_{name}")
    return [f"input_{n}" for n in _INPUTS]


@query("distinct_views", with_ctes(" UNION ALL ".join(
    f"SELECT 'input_{n}' AS view_name, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {n})) AS n" for n in _INPUTS)))
def distinct_views(spark, root):
    """S-02 + S-09: the registered input views that SHOW TABLES lists, with their rows."""
    names = register_input_views(spark, root)
    shown = spark.sql("SHOW TABLES").select(F.col("tableName").alias("view_name"))
    counts = spark.sql(" UNION ALL ".join(f"SELECT '{v}' AS view_name, COUNT(*) AS n FROM {v}" for v in names))
    return counts.join(shown, "view_name", "left_semi")


# --- X-01 / X-02: text to time ------------------------------------------------------------------

@query("parse_times", with_ctes("""SELECT id, strftime(TRY_CAST(created_at_utc8 AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS lenient,
  CASE WHEN created_at_utc8 <> 'no time' THEN strftime(CAST(CASE WHEN created_at_utc8 <> 'no time' THEN created_at_utc8 END AS TIMESTAMP),
    '%Y-%m-%d %H:%M:%S.%f') END AS strict
FROM answer_log"""))
def parse_times(spark, root):
    """X-01: text that is no time becomes null; X-02: the strict cast, on texts that are times."""
    good = F.when(F.col("created_at_utc8") != "no time", F.col("created_at_utc8"))
    return PL.answer_log(spark, root).select(
        "id", ts_text(parse_timestamp("created_at_utc8")).alias("lenient"), ts_text(parse_timestamp(good, lenient=False)).alias("strict"))


# --- S-08: a stable sample of sessions by an arithmetic key hash ------------------------------------

_KEY_HASH = "(user_id * 31 + gamecharacter_id * 17 + session_id * 7) % 3"


@query("sample_sessions_by_key", with_ctes(
    f"SELECT user_id, gamecharacter_id, session_id, COUNT(*) AS n_questions FROM in_sessions WHERE {_KEY_HASH} = 0 "
    "GROUP BY user_id, gamecharacter_id, session_id"))
def sample_sessions_by_key(spark, root):
    """S-08: one session in three by its key (the sample is the feature)."""
    t = session_table(PL.in_sessions(spark, root))
    return t.filter(F.expr(f"{_KEY_HASH} = 0")).select(*SESSION_KEYS, "n_questions")


# --- Q-05: wide control sequences with names and arm labels, back to the long form -------------------

_LABELS = ["control", "treatment1", "treatment2", "treatment3"]
register("ctrl_named", "ctrl_named AS (SELECT s.section_name, ["
         + ", ".join(f"'{x}'" for x in _LABELS) + "][c.experiment_mode + 1] AS sequence, c.section_id, c.experiment_mode, c.pos, c.cq "
         "FROM ctrl c JOIN (SELECT section_name, arg_max(section_id, question_id) AS section_id FROM question_structure "
         "GROUP BY section_name) s ON s.section_id = c.section_id)")


def control_table(spark, root):
    """The control sequences as the published wide table: section name, arm label, Q1..Qn."""
    wide = S.control_to_wide(frames(spark, root)[2], N)
    names = S.section_id_lookup(PL.question_structure(spark, root), order_col="question_id")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), F.col("experiment_mode") + 1).alias("sequence")
    return wide.join(names, "section_id").select("section_name", label, *[f"Q{i}" for i in range(1, N + 1)])


@query("control_from_wide", with_ctes("SELECT section_name, sequence, section_id, experiment_mode, pos, cq FROM ctrl_named"))
def control_from_wide(spark, root):
    """Q-05 + F-13 + J-10: wide table -> arm recode -> section id by name -> long control."""
    names = S.section_id_lookup(PL.question_structure(spark, root), order_col="question_id")
    wide = S.recode_arms(control_table(spark, root)).join(names, "section_name")
    labels = wide.select("section_id", "experiment_mode", "section_name", "sequence")
    return S.control_from_wide(wide, N).join(labels, ["section_id", "experiment_mode"]).select(
        "section_name", "sequence", "section_id", "experiment_mode", "pos", "cq")


# --- X-08 / F-12: array functions over session arrays ------------------------------------------------

@query("array_functions", with_ctes("""SELECT user_id, gamecharacter_id, session_id,
  CAST(any_value(CASE WHEN rn = 3 THEN question_id END) AS DOUBLE) AS third_question,
  CAST(COUNT(*) FILTER (WHERE question_id = 0) AS INTEGER) AS n_question_0,
  COUNT(section_id) = 0 OR (COUNT(*) = COUNT(section_id) AND MIN(section_id) = MAX(section_id)) AS one_section
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, gamecharacter_id, session_id ORDER BY created_at, id) AS rn FROM in_sessions)
GROUP BY user_id, gamecharacter_id, session_id"""))
def array_functions(spark, root):
    """X-08 + Q-04 + F-12: third item or null, count of a value, all items equal the first."""
    t = session_table(PL.in_sessions(spark, root), array_cols={"q": "question_id", "s": "section_id"})
    return t.select(*SESSION_KEYS, safe_get("q", 3).cast("double").alias("third_question"),
                    count_value("q", 0).alias("n_question_0"), all_equal_first("s").alias("one_section"))


# --- F-04 / F-06: the other length and arm filters ------------------------------------------------

@query("length_and_arm_filters", with_ctes("""SELECT experiment_mode,
  COUNT(*) FILTER (WHERE n_questions > 0 AND n_questions < 10) AS n_short,
  COUNT(*) FILTER (WHERE n_questions <= 50) AS n_at_most_50,
  COUNT(*) FILTER (WHERE experiment_mode IN (0, 2, 3)) AS n_arm_list,
  COUNT(*) FILTER (WHERE NOT experiment_mode IN (0, 2, 3)) AS n_other_arms
FROM wlong WHERE spos = 1 GROUP BY experiment_mode"""))
def length_and_arm_filters(spark, root):
    """F-04 (short sessions, at most 50 answers) and F-06 (arm lists and their complement), counted by arm."""
    w = wlong(spark, root).filter("spos = 1")
    listed = F.col("experiment_mode").isin(0, 2, 3)
    return w.groupBy("experiment_mode").agg(
        F.count_if((F.col("n_questions") > 0) & (F.col("n_questions") < 10)).alias("n_short"),
        F.count_if(F.col("n_questions") <= 50).alias("n_at_most_50"),
        F.count_if(listed).alias("n_arm_list"), F.count_if(~listed).alias("n_other_arms"))


# --- G-08 / G-10: the rate at modal volume 5, and the spread of the A share and of long sessions ------

@query("rate_at_modal_volume", with_ctes("""SELECT CAST(i.difficulty_level AS DOUBLE) AS difficulty_level,
  round(AVG(i.is_correct), 6) AS rate, COUNT(i.is_correct) AS n
FROM in_sessions i JOIN pc_vol v USING (user_id, gamecharacter_id, session_id)
WHERE v.manual_book_vol_mode = 5 GROUP BY i.difficulty_level"""))
def rate_at_modal_volume(spark, root):
    """Q-18 restricted to sessions whose modal volume is 5."""
    s = PL.in_sessions(spark, root)
    t = session_table(s, mode_cols={"vol": "manual_book_vol"}).filter("vol = 5").select(*SESSION_KEYS)
    return s.join(t, SESSION_KEYS, "left_semi").groupBy("difficulty_level").agg(
        F.round(F.avg("is_correct"), 6).alias("rate"), F.count("is_correct").alias("n")).select(
        F.col("difficulty_level").cast("double").alias("difficulty_level"), "rate", "n")


def _describe_sql(src: str, value: str) -> str:
    return with_ctes(f"""SELECT experiment_mode, COUNT({value}) AS count, round(AVG({value}), 6) AS mean,
  round(stddev_samp({value}), 6) AS std, round(MIN({value}), 6) AS min, round(quantile_cont({value}, 0.25), 6) AS p25,
  round(quantile_cont({value}, 0.5), 6) AS p50, round(quantile_cont({value}, 0.75), 6) AS p75, round(MAX({value}), 6) AS max
FROM {src} GROUP BY experiment_mode""")


def _describe(df, value: str):
    d = M.describe(df, value, ["experiment_mode"])
    return d.select("experiment_mode", "count", *[F.round(F.col(c), 6).alias(c) for c in d.columns[2:]])


register("a_shares", f"""a_shares AS (SELECT user_id, gamecharacter_id, session_id, experiment_mode,
  AVG(CASE WHEN substring(answer, 3, 1) = 'A' THEN 1.0 ELSE 0.0 END) AS a_share, CAST(COUNT(*) > {N} AS DOUBLE) AS over_n
  FROM wlong WHERE n_questions >= {N} GROUP BY user_id, gamecharacter_id, session_id, experiment_mode)""")


@query("describe_a_share", _describe_sql("a_shares", "a_share"))
def describe_a_share(spark, root):
    """G-08 + G-15: the share of letter A per session, described by arm."""
    w = wlong(spark, root).filter(F.col("n_questions") >= N)
    return _describe(M.letter_share(w, SESSION_KEYS + ["experiment_mode"]), "a_share")


@query("describe_over_n", _describe_sql("a_shares", "over_n"))
def describe_over_n(spark, root):
    """G-08 + Q-22: whether a session has more than 12 answers, described by arm."""
    w = wlong(spark, root).filter((F.col("n_questions") >= N) & (F.col("spos") == 1))
    return _describe(w.withColumn("over_n", (F.col("n_questions") > N).cast("double")), "over_n")


# --- G-02: all arrays of the published session table, whole and in bounded chunks -----------------------

_ARRAYS = ["is_correct", "difficulty_level", "experiment_index", "question_id", "subject_name", "section_id", "section_name",
           "school_city", "created_at", "answer", "book_volume_name", "is_self_selected", "manual_book_vol", "time_diff",
           "created_at_utc8"]
_TEXT = {"created_at": "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')", "time_diff": "CAST(round(time_diff * 1000) AS BIGINT)"}
_TEXT_SPARK = {"created_at": lambda: ts_text("created_at"), "time_diff": lambda: F.round(F.col("time_diff") * 1000).cast("long")}


def _with_text(s):
    return s.withColumns({f"t_{c}": (_TEXT_SPARK[c]() if c in _TEXT_SPARK else F.col(c)) for c in _ARRAYS})


_ARRAY_SQL = ", ".join(f"{_sql_text(_TEXT.get(c, c))} AS {c}" for c in _ARRAYS)


@query("session_arrays", with_ctes(f"SELECT {', '.join(_SK)}, COUNT(*) AS n_questions, {_ARRAY_SQL} FROM ug30 GROUP BY {', '.join(_SK)}"))
def session_arrays(spark, root):
    """G-02: the published session table with all 15 arrays (times in text, gaps in milliseconds)."""
    from seqlab.operators.sessions import assign_sessions
    s = _with_text(assign_sessions(PL.cohort(spark, root), gap_seconds=30 * 60, flavour="user_global"))
    t = session_table(s, array_cols={c: f"t_{c}" for c in _ARRAYS})
    return t.select(*_SK, "n_questions", *[array_text(c).alias(c) for c in _ARRAYS])


CHUNK = 16


@query("section_split_chunked", with_ctes(f"""SELECT user_id, gamecharacter_id, session_id, CAST(section_id AS DOUBLE) AS section_id,
  q_len, experiment_mode, CAST((pos - 1) // {CHUNK} AS INTEGER) AS chunk,
  array_to_string(list_transform(array_agg(question_id ORDER BY pos), lambda x: coalesce(CAST(x AS VARCHAR), 'null')), ',') AS question_id
FROM long GROUP BY user_id, gamecharacter_id, session_id, long.section_id, q_len, experiment_mode, (pos - 1) // {CHUNK}"""))
def section_split_chunked(spark, root):
    """Q-01 in rows of at most 16 items, so no row holds an unbounded section."""
    from seqlab.operators.sections import section_arrays
    out = section_arrays(PL.long_table(spark, root), ["question_id"], chunk_size=CHUNK)
    return out.select(*SESSION_KEYS, F.col("section_id").cast("double").alias("section_id"), "q_len", "experiment_mode", "chunk",
                      array_text("question_id").alias("question_id"))


# --- G-18: column types ---------------------------------------------------------------------------

_KINDS = {"bigint": "integer", "int": "integer", "string": "text"}


@query("column_types", with_ctes("SELECT column_name, kind, non_null FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN typeof(any_value({c})) IN ('BIGINT', 'INTEGER') THEN 'integer' ELSE 'text' END AS kind, "
    f"COUNT({c}) AS non_null FROM cohort" for c in _ENRICHED_COLS) + ")"))
def column_types(spark, root):
    """G-18: kind and non-null count of every column of the cohort table."""
    df = PL.cohort(spark, root).select(*_ENRICHED_COLS)
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, _KINDS.get(t, t))])
    return M.column_profile(df).select("column_name", kinds[F.col("column_name")].alias("kind"), "non_null")
