"""Learning-log views derived from the ``events`` table.

The reference reads five parquet inputs (answer log, experiment log,
question structure, user info, character course) that are not shipped.
These functions rebuild tables of the same shape from ``events``, so every
downstream operator reads data Spark derives from the given tables and grows
with them; every event is one answer.  The same expressions are written in
DuckDB SQL in ``seqlab.plans.oracle`` for the correctness check.

Answers come in blocks.  A character's events, in time order, are cut into
blocks of 24 to 27 answers; a block starts when its first event happened, and
its answers follow at a pace of about 90 seconds, so a 30-minute gap separates
blocks and a block is one session of two sections.  Inside a section most
users of an arm answer that arm's question order (positions 1, 2, 10, 11 and 12
are the same in every arm); one user in five leaves it from some position on,
and single answers deviate.  Some answers lack a
section, a result or an answer text, some carry a time that is no time, some
users answer twice in the same second, and one question has no difficulty.

Derived dimensions (``question_structure``, ``user_info``, ``gc_course``)
are ``distinct`` projections: one hash aggregate each, pre-aggregated on the
map side before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Schema of ``events``, given to the scan so that no footer is read to find it (S-01).
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

# The controlled course ids (15 of them) and the cohort defaults.
CONTROLLED_COURSES = list(range(15))
COHORT_GRADE = 5
COHORT_SUBJECT = "math"

# Volume names by question_id % 7 (six with a numeral, one without).
VOLUME_NAMES = ["六年級", "五年級", "四年級", "三年級", "二年級", "一年級", "總複習"]


_K = "CAST(get_json_object(props, '$.k') AS INT)"
_VOL_ARRAY = "array(" + ", ".join(f"'{v}'" for v in VOLUME_NAMES) + ")"


_CHARACTER = "CASE WHEN user_id % 3 = 0 THEN user_id * 10 + event_id % 2 ELSE user_id * 10 END"


def answer_blocks(events: DataFrame) -> DataFrame:
    """Events with the character, block number, place in the block (from 1), length of the
    block's first section and the block's start.  Places come from the skew-safe
    numbering; a window holds one block, 27 rows at most."""
    from seqlab.operators.sections import number_within

    base = events.selectExpr("event_id", "user_id", f"{_CHARACTER} AS gamecharacter_id", f"{_K} AS k", "value", "ts")
    placed = number_within(base, ["user_id", "gamecharacter_id"], ts="ts", tiebreak="event_id", pos="r", total="n",
                           bucket_seconds=86_400)
    blocks = placed.selectExpr(
        "*", "12 + user_id % 3 AS first_len", "(r - 1) DIV (24 + user_id % 3 + user_id % 2) AS block",
        "(r - 1) % (24 + user_id % 3 + user_id % 2) + 1 AS place")
    whole = Window.partitionBy("user_id", "gamecharacter_id", "block")
    return blocks.withColumn("block_start", F.min("ts").over(whole))


def answer_log(events: DataFrame) -> DataFrame:
    """Answer log: id, user, character, question, section, correctness, answer text, time as text."""
    b = answer_blocks(events).selectExpr(
        "*", "((CASE WHEN place <= first_len THEN 0 ELSE 1 END) + block) % 2 AS section",
        "CASE WHEN place <= first_len THEN place ELSE place - first_len END AS spot", "user_id % 4 AS a")
    b = b.selectExpr("*", "CASE WHEN spot > 12 THEN spot - 10 ELSE spot END AS s").selectExpr(
        "*", """2 * (CASE WHEN event_id % 53 = 0 OR (user_id % 5 = 3 AND spot >= 1 + user_id % 11) THEN k % 4
      WHEN spot IN (1, 10) THEN 0 WHEN spot IN (2, 11, 12) THEN 2
      ELSE (s * (a + 1) + a * (s DIV 2) + s DIV 3) % 3 END) + section AS question""")
    seconds = """CAST((place - 1 - CASE WHEN user_id % 6 = 1 AND place = 3 THEN 1 ELSE 0 END) * 90
      + CASE WHEN user_id % 6 = 1 THEN 0 ELSE event_id % 60 END AS INT)"""
    return b.selectExpr(
        "event_id AS id", "user_id", "gamecharacter_id",
        "CAST(question AS BIGINT) AS question_id",
        "CAST(CASE WHEN event_id % 61 = 0 THEN NULL ELSE section END AS BIGINT) AS section_id",
        "CAST(CASE WHEN event_id % 37 = 0 THEN NULL WHEN value >= 30 THEN 1 ELSE 0 END AS INT) AS is_correct",
        "CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('[\"', char(CAST(65 + event_id % 4 AS INT)), '\"]') END AS answer",
        "CAST(event_id % 2 AS INT) AS is_self_selected",
        f"""CASE WHEN event_id % 101 = 0 THEN 'no time'
          ELSE date_format(timestampadd(SECOND, {seconds}, block_start), 'yyyy-MM-dd HH:mm:ss.SSSSSS') END AS created_at_utc8""",
    )


def exp_log(answers: DataFrame) -> DataFrame:
    """Experiment (book-volume) log: answers of the users in the experiment
    population (all but ``user_id % 5 = 4``, a population definition, not a row
    cap) with the experiment arm that was active for that answer."""
    return answers.filter("user_id % 5 <> 4").selectExpr(
        "id", "user_id", "gamecharacter_id", "question_id", "section_id",
        "CAST(CASE WHEN id % 4 = 0 THEN (user_id + 1) % 4 ELSE user_id % 4 END AS INT) AS experiment_index",
        "is_correct", "created_at_utc8")


def question_structure(answers: DataFrame) -> DataFrame:
    """Question dimension over the distinct question ids; question 5 has no difficulty."""
    return answers.select("question_id").distinct().selectExpr(
        "question_id",
        "question_id % 2 AS section_id",
        "concat('sec_', CAST(question_id % 2 AS STRING)) AS section_name",
        "CAST(CASE WHEN question_id <> 5 THEN question_id % 3 + 1 END AS INT) AS difficulty_level",
        "CASE WHEN question_id < 6 THEN 'math' ELSE 'lang' END AS subject_name",
        f"element_at({_VOL_ARRAY}, CAST(question_id % 7 + 1 AS INT)) AS book_volume_name",
    )


def user_info(events: DataFrame) -> DataFrame:
    """User dimension: grade and city.  The grade uses ``user_id // 4`` so that the
    grade-5 cohort is not tied to the arm (which follows ``user_id % 4``)."""
    return events.select("user_id").distinct().selectExpr(
        "user_id", "CAST(4 + (user_id DIV 4) % 2 AS INT) AS user_grade",
        "concat('city_', CAST(user_id % 15 AS STRING)) AS school_city")


def gc_course(events: DataFrame) -> DataFrame:
    """Character -> course dimension."""
    return events.selectExpr("user_id", f"{_CHARACTER} AS gamecharacter_id").distinct().selectExpr(
        "gamecharacter_id", "(user_id + gamecharacter_id) % 20 AS course_id")
