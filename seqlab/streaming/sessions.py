"""Streaming form of the sessionizer (optional extension of W-03).

``session_window(ts, gap)`` with a watermark closes a (user, character)
session once no answer arrives within the gap; the boundary is the same
strict "greater than gap" rule as the batch sessionizer, and null times are
dropped.  Streams cannot number sessions (no running count over an unbounded
past), so the output is one row per closed session: start, end, count and
correct answers.  Equal to the batch ``per_character`` sessions.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_windows(answers: DataFrame, gap_minutes: float = 30, ts: str = "created_at",
                    watermark: str | None = None, keys=("user_id", "gamecharacter_id")) -> DataFrame:
    """Closed sessions per (user, character) from a batch or streaming frame."""
    gap = f"{int(round(gap_minutes * 60))} seconds"
    src = answers.filter(F.col(ts).isNotNull())
    if watermark is not None:
        # event-time watermarks need TIMESTAMP (with zone); wall-clock inputs are
        # read in the session time zone, which keeps gaps unchanged
        src = src.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    g = src.groupBy(*keys, F.session_window(F.col(ts), gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_questions"), F.sum("is_correct").alias("n_correct"),
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
    return g.drop("w")


def stream_session_counts(spark, source_dir: str, schema, gap_minutes: float = 30, watermark: str = "1 hour",
                          query_name: str = "seqlab_sessions", checkpoint: str | None = None):
    """Start a streaming query over a parquet folder of answers (append mode,
    memory sink).  Returns the running ``StreamingQuery``; callers stop it."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    out = session_windows(stream, gap_minutes, watermark=watermark)
    w = out.writeStream.outputMode("append").format("memory").queryName(query_name)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.start()
