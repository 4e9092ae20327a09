"""Enrichment joins and cohort filters (J-01..J-10, G-01, G-16, F-02, F-03, F-17).

Join strategy: dimensions are joined with plain equi-joins and no hint by
default.  Catalyst broadcasts a side whose size estimate is under
``spark.sql.autoBroadcastJoinThreshold``; with AQE on, a side that is only
known to be small after its shuffle stage ran is switched to a broadcast
join at run time.  Anything larger stays a sort-merge join.  ``broadcast=``
'checked' adds an explicit hint only after a bounded row count proves the
side small (``limit(max_rows+1).count()``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.sources.adapter import CONTROLLED_COURSES, COHORT_GRADE, COHORT_SUBJECT


def checked_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast-hint ``df`` only if it provably has at most ``max_rows`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left", broadcast: str = "auto",
                   max_rows: int = 1_000_000, null_safe: bool = False) -> DataFrame:
    """Equi-join a dimension (J-01, J-04, J-05).  ``null_safe`` matches null keys
    to null keys like pandas merge (D-09); default is SQL semantics."""
    if broadcast == "checked":
        dim = checked_broadcast(dim, max_rows)
    keys = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return fact.join(dim, on=keys, how=how)
    d = dim.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in dim.columns])
    cond = None
    for k in keys:
        c = fact[k].eqNullSafe(d[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return fact.join(d, on=cond, how=how).drop(*[f"_r_{k}" for k in keys])


def assert_unique(dim: DataFrame, keys: list[str]) -> DataFrame:
    """D-15: rows of ``dim`` whose key occurs more than once (empty when unique)."""
    return dim.groupBy(*keys).count().filter(F.col("count") > 1)


def keep_first(df: DataFrame, keys: list[str], ts: str = "created_at_utc8", tiebreak: str = "id",
               value_cols: list[str] | None = None) -> DataFrame:
    """G-01: one row per key, the earliest by (ts asc nulls last, id).

    Written as a ``min_by`` aggregate, so it pre-aggregates on the map side
    and a hot key never lands whole in one task (a row_number window would).
    """
    value_cols = value_cols or [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts).isNull(), F.col(ts), F.col(tiebreak))
    picked = F.min_by(F.struct(*[F.col(c) for c in value_cols]), order).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def dedup_experiment_log(exp: DataFrame) -> DataFrame:
    """J-02 input: experiment arm per (user, character, section), first one kept."""
    return keep_first(
        exp.select("user_id", "gamecharacter_id", "section_id", "experiment_index", "created_at_utc8", "id"),
        ["user_id", "gamecharacter_id", "section_id"], value_cols=["experiment_index"])


def enrich_answers(answers: DataFrame, users: DataFrame, exp: DataFrame, questions: DataFrame,
                   courses: DataFrame, broadcast: str = "auto") -> DataFrame:
    """J-06: answers LEFT users, LEFT first experiment arm, LEFT questions
    (question-side section dropped, D-10), LEFT course."""
    df = join_dimension(answers, users, "user_id", broadcast=broadcast)
    df = join_dimension(df, dedup_experiment_log(exp), ["user_id", "gamecharacter_id", "section_id"],
                        broadcast=broadcast)
    df = join_dimension(df, questions.drop("section_id"), "question_id", broadcast=broadcast)
    df = join_dimension(df, courses, "gamecharacter_id", broadcast=broadcast)
    return df


def cohort_filter(df: DataFrame, grade: int | None = COHORT_GRADE, subject: str | None = COHORT_SUBJECT,
                  course_ids: list | DataFrame | None = tuple(CONTROLLED_COURSES)) -> DataFrame:
    """F-02: grade = g AND subject = s AND course in set (``None`` skips a part).

    A DataFrame of course ids becomes a left-semi join (for large sets)."""
    cond: Column = F.lit(True)
    if grade is not None:
        cond = cond & (F.col("user_grade") == grade)
    if subject is not None:
        cond = cond & (F.col("subject_name") == subject)
    if course_ids is not None and not isinstance(course_ids, DataFrame):
        cond = cond & F.col("course_id").isin(list(course_ids))
    out = df.filter(cond)
    if isinstance(course_ids, DataFrame):
        out = out.join(course_ids.select(F.col(course_ids.columns[0]).alias("course_id")), "course_id", "left_semi")
    return out


def volume_prefix_filter(df: DataFrame, prefix: str, col: str = "book_volume_name") -> DataFrame:
    """F-03: volume name matches a regex anchored at the start."""
    return df.filter(F.col(col).rlike("^" + prefix))


def semi_join_users(answers: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """J-07: answers of the listed users (left-semi, never duplicates rows)."""
    return answers.join(users.select(key), key, "left_semi")


def experiment_flag(answers: DataFrame, exp: DataFrame, key: str = "user_id") -> DataFrame:
    """J-08: ``is_experiment`` = the user appears in the experiment log."""
    flagged = exp.select(key).distinct().withColumn("_hit", F.lit(True))
    return (answers.join(flagged, key, "left")
            .withColumn("is_experiment", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))
