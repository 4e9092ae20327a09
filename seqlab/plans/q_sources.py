"""Registered queries: text sources written to and read from the shared folder (S-04, S-05, S-06), exact sample (S-08)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlab.functions.scalar import array_text
from seqlab.functions.timecols import ts_text
from seqlab.operators.sections import SESSION_KEYS
from seqlab.operators.sessions import session_table
from seqlab.plans import pipeline as PL
from seqlab.plans.oracle import with_ctes
from seqlab.plans.q_sessions import _sql_text
from seqlab.plans.registry import query
from seqlab.session import checkpoint_dir
from seqlab.sources import tables as T
from seqlab.sources.sampling import sample_exact


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/seqlab-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_MISSING = "n/a"


@query("csv_answers", with_ctes(f"""SELECT id, user_id, created_at_utc8, CAST(is_correct AS DOUBLE) AS is_correct,
  CASE WHEN is_correct IS NULL THEN concat(id, ',', user_id, ',', created_at_utc8, ',{_MISSING}') END AS bad_row FROM answer_log"""))
def csv_answers(spark, root):
    """S-04 + S-06: the answer log as CSV with a byte-order mark, read back with a schema; a row whose result is
    no number keeps its other fields and its line."""
    path = _folder(spark, "answers-csv")
    rows = PL.answer_log(spark, root).select(F.col("id").alias("\ufeffid"), "user_id", "created_at_utc8", F.coalesce(
        F.col("is_correct").cast("string"), F.lit(_MISSING)).alias("is_correct"))
    rows.write.option("header", True).csv(path)
    back = T.read_csv_table(spark, path, "id long, user_id long, created_at_utc8 string, is_correct int", corrupt="bad_row")
    return back.withColumn("is_correct", F.col("is_correct").cast("double"))


@query("json_sessions", with_ctes(f"""SELECT user_id, gamecharacter_id, session_id, n_questions,
  CASE WHEN n_questions % 5 > 0 THEN start_time END AS start_time, CASE WHEN n_questions % 5 > 0 THEN is_corrects END AS is_corrects,
  n_questions % 5 = 0 AS bad
FROM (SELECT user_id, gamecharacter_id, session_id, COUNT(*) AS n_questions, strftime(MIN(created_at), '%Y-%m-%d %H:%M:%S.%f') AS start_time,
             {_sql_text('is_correct')} AS is_corrects FROM in_sessions GROUP BY user_id, gamecharacter_id, session_id)"""))
def json_sessions(spark, root):
    """S-05 + S-06: the session table with its arrays as JSON lines, read back with a schema; where the array is
    text instead, the line is kept as it is (every fifth length here), and only the keys of it are read."""
    path = _folder(spark, "sessions-json")
    t = session_table(PL.in_sessions(spark, root), array_cols={"is_corrects": "is_correct"})
    t = t.select(*SESSION_KEYS, "n_questions", ts_text("start_time").alias("start_time"), "is_corrects")
    line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    broken = F.to_json(F.struct(*SESSION_KEYS, "n_questions", F.lit(1).alias("start_time"), F.lit("none").alias("is_corrects")))
    t.select(F.when(F.col("n_questions") % 5 > 0, line).otherwise(broken).alias("value")).write.text(path)
    back = T.read_json_lines(spark, path, "user_id long, gamecharacter_id long, session_id long, n_questions long, "
                                          "start_time string, is_corrects array<int>", corrupt="bad_row")
    good = F.col("bad_row").isNull()
    return back.select(*SESSION_KEYS, "n_questions", F.when(good, F.col("start_time")).alias("start_time"),
                       F.when(good, array_text("is_corrects")).alias("is_corrects"), (~good).alias("bad"))


@query("sample_exact", with_ctes("""SELECT user_id, gamecharacter_id, session_id, n_questions FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY md5(concat('42:', user_id, ':', gamecharacter_id, ':', session_id))[1:15]) AS place, COUNT(*) OVER () AS n
  FROM (SELECT user_id, gamecharacter_id, session_id, COUNT(*) AS n_questions FROM in_sessions GROUP BY user_id, gamecharacter_id, session_id))
WHERE place <= round(n / 3.0)"""))
def sample_exact_sessions(spark, root):
    """S-08: a third of the sessions, to the row (the sample is the feature)."""
    t = session_table(PL.in_sessions(spark, root)).select(*SESSION_KEYS, "n_questions")
    return sample_exact(t, SESSION_KEYS, 1 / 3, 42)
