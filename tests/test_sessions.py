"""Sessionizer: hand cases (FIXTURES section 4) and equality with the plain window form."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqlab.operators.sessions import assign_sessions, assign_sessions_plain, session_table

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, user_id long, gamecharacter_id long, created_at timestamp_ntz, v int"


def sess(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = assign_sessions(df, **kw).orderBy("id").collect()
    return [(r["id"], r["session_id"]) for r in out]


def test_gap_is_strictly_greater(spark):
    rows = [(1, 1, 10, T0, 1), (2, 1, 10, T0 + timedelta(minutes=30), 1),
            (3, 1, 10, T0 + timedelta(minutes=60, microseconds=1), 1)]
    assert sess(spark, rows, gap_seconds=1800) == [(1, 1), (2, 1), (3, 2)]


def test_time_ties_ordered_by_id(spark):
    rows = [(7, 1, 10, T0, 1), (3, 1, 10, T0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    t = session_table(assign_sessions(df, gap_seconds=1800), array_cols={"ids": "id"}).collect()
    assert len(t) == 1 and t[0]["ids"] == [3, 7]


def test_null_times(spark):
    rows = [(1, 1, 10, T0, 1), (2, 1, 10, None, 1), (3, 1, 10, None, 1)]
    assert sess(spark, rows, null_ts="join") == [(1, 1), (2, 1), (3, 2)]
    assert sess(spark, rows, null_ts="new") == [(1, 1), (2, 2), (3, 3)]
    assert sess(spark, rows) == [(1, 1)]


def test_two_characters_flavours(spark):
    rows = [(1, 1, 10, T0, 1), (2, 1, 11, T0 + timedelta(minutes=5), 1), (3, 1, 10, T0 + timedelta(minutes=10), 1)]
    assert sess(spark, rows, flavour="per_character") == [(1, 1), (2, 1), (3, 1)]
    assert sess(spark, rows, flavour="user_global") == [(1, 1), (2, 2), (3, 2)]


def test_null_key_dropped(spark):
    rows = [(1, 1, None, T0, 1), (2, 1, 10, T0, 1)]
    assert sess(spark, rows) == [(2, 1)]


def test_null_items_kept_in_arrays(spark):
    rows = [(1, 1, 10, T0, 1), (2, 1, 10, T0 + timedelta(seconds=1), None),
            (3, 1, 10, T0 + timedelta(seconds=2), 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    t = session_table(assign_sessions(df), array_cols={"vs": "v"}).collect()[0]
    assert t["vs"] == [1, None, 0] and t["n_questions"] == 3


@pytest.mark.parametrize("flavour", ["per_character", "user_global"])
@pytest.mark.parametrize("bucket,max_rows", [(3600, None), (86400, 5_000_000), (86400, 3)])
def test_bucketed_equals_plain_window(spark, flavour, bucket, max_rows):
    """The skew-safe bucketed plan gives exactly the textbook window result,
    also when sessions cross many bucket boundaries (1-hour buckets, 12-hour gap)."""
    from seqlab.sources.adapter import answer_log
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    # the events' own times, which spread over months, under the derived answers' keys
    a = answer_log(ev).join(ev.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at")), "id")
    got = assign_sessions(a, gap_seconds=12 * 3600, flavour=flavour, bucket_seconds=bucket, max_bucket_rows=max_rows)
    exp = assign_sessions_plain(a, gap_seconds=12 * 3600, flavour=flavour)
    cols = ["id", "session_id", "new_session", "time_diff"]
    diff = got.select(*cols).exceptAll(exp.select(*cols)).count() + exp.select(*cols).exceptAll(got.select(*cols)).count()
    assert diff == 0


def test_hot_user_is_split_across_tasks(spark):
    """One user with most rows: the heavy window is partitioned by (user, character,
    bucket), so the rows of that user spread over many window partitions."""
    rows = [(i, 1, 10, T0 + timedelta(minutes=7 * i), 1) for i in range(3000)] + \
           [(10_000 + i, 2, 20, T0 + timedelta(minutes=7 * i), 1) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = assign_sessions(df, gap_seconds=600, bucket_seconds=3600).withColumn("_p", F.spark_partition_id())
        per_part = got.filter(F.col("user_id") == 1).groupBy("_p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(per_part) > 1
    assert got.filter(F.col("user_id") == 1).agg(F.max("session_id")).first()[0] == 1


def test_shuffle_partitions_do_not_change_result(spark):
    from seqlab.plans import pipeline as PL
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        PL.reset()
        a = PL.in_sessions(spark, "/root/testdata/sf0.001", PL.Params()).select("id", "session_id").collect()
        PL.reset()
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = PL.in_sessions(spark, "/root/testdata/sf0.001", PL.Params()).select("id", "session_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_burst_inside_one_bucket_is_split(spark):
    """A key whose rows all fall inside one bucket is cut into time slices."""
    rows = [(i, 1, 10, T0 + timedelta(seconds=i), 1) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = assign_sessions(df, gap_seconds=600, bucket_seconds=86400, max_bucket_rows=100).withColumn(
            "_p", F.spark_partition_id())
        parts = got.groupBy("_p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1
    assert got.agg(F.max("session_id"), F.min("session_id")).first() == (1, 1)


def test_positions_with_split_buckets(spark):
    from seqlab.operators.sections import number_within
    rows = [(i, 1, 10, T0 + timedelta(seconds=(i * 7919) % 5000), 1) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("session_id", F.lit(1)).withColumn("section_id", F.lit(0))
    keys = ["user_id", "gamecharacter_id", "session_id", "section_id"]
    got = number_within(df, keys, max_bucket_rows=20).select("id", "pos", "q_len").orderBy("pos").collect()
    exp = sorted(rows, key=lambda r: (r[3], r[0]))
    assert [r["id"] for r in got] == [r[0] for r in exp] and all(r["q_len"] == 500 for r in got)


def test_chunked_session_arrays(spark):
    rows = [(i, 1, 10, T0 + timedelta(seconds=i), i % 2) for i in range(25)]
    df = assign_sessions(spark.createDataFrame(rows, SCHEMA), gap_seconds=600)
    whole = session_table(df, array_cols={"vs": "v", "ids": "id"}).first()
    parts = session_table(df, array_cols={"vs": "v", "ids": "id"}, chunk_size=10).orderBy("chunk").collect()
    assert [len(p["ids"]) for p in parts] == [10, 10, 5]
    assert sum((p["ids"] for p in parts), []) == whole["ids"] and sum((p["vs"] for p in parts), []) == whole["vs"]
    assert all(p["n_questions"] == 25 for p in parts)


def test_one_user_with_untimed_answers_only_is_numbered_in_ranges(spark):
    """Equal to one window over the key, and no range holds more than its bound, also when ids come in clusters."""
    from pyspark.sql import Window

    from seqlab.operators.sessions import number_by_id
    ids = [i * 1000 for i in range(2000)] + [10**12 + i for i in range(2000)] + [-5, 2**62]
    df = spark.createDataFrame([(1, i) for i in ids] + [(2, 7)], "u int, id long")
    got = number_by_id(df, ["u"], "id", "n", most=100)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy("id")))
    assert got.select("u", "id", "n").exceptAll(want).count() == 0 and got.count() == want.count()
    even = number_by_id(spark.range(5000).selectExpr("1 as u", "id * 3 as id"), ["u"], "id", "n", most=100)
    assert even.groupBy("u", "_h1", "_h2").count().agg(F.max("count")).first()[0] <= 100


def test_untimed_answers_continue_or_open_sessions_in_order_of_id(spark):
    import datetime as dt
    base = dt.datetime(2025, 1, 1)
    rows = [(1, 1, 10, base), (2, 1, 10, None), (9, 1, 10, None), (5, 1, 10, None), (3, 2, 20, None), (1, 2, 20, None)]
    df = spark.createDataFrame(rows, "id long, user_id long, gamecharacter_id long, created_at timestamp")
    for how, want in (("new", {1: [1, 2, 3, 4], 2: [1, 2]}), ("join", {1: [1, 1, 2, 3], 2: [1, 2]})):
        got = assign_sessions(df, null_ts=how).orderBy("user_id", "id").collect()
        assert {u: [r.session_id for r in got if r.user_id == u] for u in want} == want
