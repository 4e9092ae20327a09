"""Streaming sessions equal the batch sessionizer once the watermark has passed."""
import tempfile

from pyspark.sql import functions as F

from seqlab.functions.timecols import parse_timestamp
from seqlab.operators.sessions import assign_sessions, session_table
from seqlab.sources.adapter import answer_log
from seqlab.streaming import session_windows


def test_batch_session_window_equals_gap_rule(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a = answer_log(ev).withColumn("created_at", parse_timestamp("created_at_utc8")).where("created_at is not null")
    sw = session_windows(a, gap_minutes=30).select("user_id", "gamecharacter_id", "session_start", "n_questions")
    bt = session_table(assign_sessions(a, gap_seconds=1800)).select(
        "user_id", "gamecharacter_id", F.col("start_time").alias("session_start"), "n_questions")
    assert sw.exceptAll(bt).count() == 0 and bt.exceptAll(sw).count() == 0


def test_streaming_query_runs(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    a = answer_log(ev).withColumn("created_at", parse_timestamp("created_at_utc8")).where("created_at is not null").select(
        "user_id", "gamecharacter_id", "is_correct", "created_at")
    src = tempfile.mkdtemp(prefix="seqlab-stream-src-")
    a.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(a.schema).parquet(src)
    q = (session_windows(stream, 30, watermark="1 minute").writeStream.outputMode("append")
         .format("memory").queryName("sess_test").option("checkpointLocation", tempfile.mkdtemp()).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    n = spark.sql("SELECT COUNT(*) FROM sess_test").first()[0]
    assert n > 0


def test_running_numbers_equal_the_batch_sessionizer(spark):
    """Three batches, the second one partly late (within the watermark), the third one far later, so all timers fire."""
    import datetime as dt

    from seqlab.streaming import number_sessions
    base = dt.datetime(2025, 1, 1)
    rows = []
    for i in range(240):
        user = i % 4
        minutes = (i // 4) * 7 + (40 if i % 13 == 0 else 0) + (90 if i // 4 >= 30 else 0)
        rows.append((i, user, user * 10 + (i // 4) % 2 * (user == 1), base + dt.timedelta(minutes=minutes, microseconds=i % 3)))
    rows += [(900, 1, 10, None), (901, None, 10, base), (902, 2, None, base)]
    schema = "id long, user_id long, gamecharacter_id long, created_at timestamp"
    early = [r for r in rows if r[0] < 100 and r[0] % 9]
    late = [r for r in rows if r[0] < 100 and not r[0] % 9] + [r for r in rows if r[0] >= 100]
    far = [(1000 + k, 7, 70, base + dt.timedelta(days=30 + k)) for k in range(2)]
    src, sink, check = (tempfile.mkdtemp(prefix=f"seqlab-numbers-{n}-") for n in ("src", "sink", "check"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (number_sessions(stream, 30, watermark="12 hours").writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", check).start(sink))
    try:
        for part in (early, late, far[:1], far[1:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(sink).filter("user_id <> 7")
    want = assign_sessions(spark.createDataFrame(rows, schema), gap_seconds=1800).select(
        "user_id", "gamecharacter_id", "id", "created_at", F.round("time_diff", 6).alias("time_diff"), "session_id")
    got = got.withColumn("time_diff", F.round("time_diff", 6)).select(*want.columns)
    assert got.count() == 240 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
