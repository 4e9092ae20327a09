"""Positions inside a group and the session-by-section table (Q-01, Q-02, F-11).

``number_within`` gives each answer its 1-based position in a group (a
session, or a session's section) and the group size.  Like the sessionizer it
numbers inside (group, time bucket) and adds the count of earlier buckets, so
an enormous session is spread over many tasks; only a one-row-per-bucket table
is grouped by the bare key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.operators.sessions import BUCKET, MAX_BUCKET_ROWS, _field, _running_offset, split_buckets

SESSION_KEYS = ["user_id", "gamecharacter_id", "session_id"]
SECTION_KEYS = SESSION_KEYS + ["section_id"]


def number_within(df: DataFrame, keys: list[str], ts: str = "created_at", tiebreak: str = "id",
                  pos: str = "pos", total: str = "q_len", bucket_seconds: int = BUCKET,
                  max_bucket_rows: int | None = MAX_BUCKET_ROWS) -> DataFrame:
    """Add ``pos`` (1-based, order (ts asc nulls last, id)) and ``total`` per group."""
    r = split_buckets(df, keys, ts, bucket_seconds, max_bucket_rows, out="_pb")
    w = Window.partitionBy(*keys, "_pb").orderBy(F.col(ts).asc_nulls_last(), F.col(tiebreak))
    r = r.withColumn("_lpos", F.row_number().over(w))
    cnt = r.groupBy(*keys, "_pb").agg(F.count(F.lit(1)).alias("_n"))
    cnt = _running_offset(cnt, keys, "_pb", "_n", "_poff")
    cnt = cnt.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)).cast("long"))
    # keys may be null (an answer without a section), so they are joined as one struct, whose null fields are equal
    cnt = cnt.select(F.struct(*keys, "_pb").alias("_k"), "_poff", total)
    r = r.withColumn("_k", F.struct(*keys, "_pb")).join(cnt, on="_k", how="inner").drop("_k")
    return r.withColumn(pos, (F.col("_poff") + F.col("_lpos")).cast("int")).drop("_pb", "_lpos", "_poff")


def session_arm(df: DataFrame, keys: list[str] = SESSION_KEYS, col: str = "experiment_index",
                out: str = "experiment_mode", fill: int | None = -1) -> DataFrame:
    """G-05 + F-11: modal arm of a whole session (lowest on ties), ``fill`` if none."""
    m = F.mode(F.col(col), True)
    if fill is not None:
        m = F.coalesce(m, F.lit(fill))
    return df.groupBy(*keys).agg(m.cast("int").alias(out))


def split_by_section(answers: DataFrame, ts: str = "created_at", tiebreak: str = "id",
                     bucket_seconds: int = BUCKET) -> DataFrame:
    """Q-01 in long form: one row per answer with ``pos`` and ``q_len`` inside its
    (user, character, session, section), and the session's arm as
    ``experiment_mode`` (the arm is the whole session's mode, not the section's).
    Arrays are an output format only (``section_arrays``)."""
    long = number_within(answers, SECTION_KEYS, ts=ts, tiebreak=tiebreak, bucket_seconds=bucket_seconds)
    arms = session_arm(answers)
    return long.join(arms, on=SESSION_KEYS, how="inner")


def section_rows(long: DataFrame, ts: str = "created_at") -> DataFrame:
    """Q-02: one row per (session, section): ``q_len``, arm, first time ``create_at``.
    Taken from the position-1 rows, so no further shuffle is needed."""
    return long.filter(F.col("pos") == 1).select(*SECTION_KEYS, "q_len", "experiment_mode",
                                                 F.col(ts).alias("create_at"))


def section_arrays(long: DataFrame, fields: list[str], ts: str = "created_at", tiebreak: str = "id",
                   chunk_size: int | None = None) -> DataFrame:
    """Q-01 as published: parallel arrays per (session, section) in time order.
    ``chunk_size`` emits rows (section, ``chunk``) of at most that many elements
    instead, so no row or task has to hold an unbounded section."""
    st = F.struct(F.col("pos"), *[F.col(f) for f in fields])
    keys = [*SECTION_KEYS, "q_len", "experiment_mode"]
    if chunk_size:
        long = long.withColumn("chunk", ((F.col("pos") - 1) / F.lit(int(chunk_size))).cast("int"))
        keys.append("chunk")
    out = long.groupBy(*keys).agg(F.array_sort(F.collect_list(st)).alias("_a"))
    for f in fields:
        out = out.withColumn(f, F.transform("_a", _field(f)))
    return out.drop("_a")
