"""Running session numbers on a stream (W-03, W-05): arbitrary state for each key.

``session_window`` closes sessions but cannot number them.  Here the state of a
(user, character) is the time of its last numbered answer, the number of its
session, and the answers that wait.  An answer is numbered once the watermark
has passed it, so answers that come late, but within the watermark, take their
place in time order; a timer in event time wakes a key whose answers wait and
to which nothing more comes.  The result equals the batch ``per_character``
numbering of the answers that were not later than the watermark.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["user_id", "gamecharacter_id"]
_STATE = T.StructType([T.StructField("last", T.LongType()), T.StructField("session", T.LongType()),
                       T.StructField("times", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType()))])


def _numberer(gap_micros: int, ts: str, tiebreak: str):
    def number(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, session, times, ids = state.get if state.exists else (None, 0, [], [])
        waiting = list(zip(times, ids))
        if not state.hasTimedOut:
            for batch in batches:
                waiting += zip(batch[ts].astype("datetime64[us, UTC]").astype("int64").tolist() if batch[ts].dt.tz is not None
                               else batch[ts].astype("datetime64[us]").astype("int64").tolist(), batch[tiebreak].tolist())
        safe = state.getCurrentWatermarkMs() * 1000  # nothing up to here can still come
        waiting.sort()
        out = []
        for at, (time, answer) in enumerate(waiting):
            if time >= safe:
                waiting = waiting[at:]
                break
            previous, session = last, session + (last is None or time - last > gap_micros)
            out.append((*key, answer, time, None if previous is None else (time - previous) / 1e6, session))
            last = time
        else:
            waiting = []
        state.update((last, session, [t for t, _ in waiting], [i for _, i in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            found = pd.DataFrame(out, columns=[*KEYS, tiebreak, "_micros", "time_diff", "session_id"])
            found[ts] = pd.to_datetime(found.pop("_micros"), unit="us", utc=True)
            yield found[[*KEYS, tiebreak, ts, "time_diff", "session_id"]]
    return number


def number_sessions(answers: DataFrame, gap_minutes: float = 30, ts: str = "created_at", tiebreak: str = "id",
                    watermark: str = "1 hour") -> DataFrame:
    """Keys, ``tiebreak``, ``ts``, ``time_diff`` (seconds) and ``session_id`` of a stream's answers, in append mode.

    Answers without a key or a time are left out, and so are those later than the watermark.
    """
    rows = answers.filter(F.col(ts).isNotNull() & F.col("user_id").isNotNull() & F.col("gamecharacter_id").isNotNull())
    rows = rows.select(*KEYS, F.col(tiebreak).cast("long").alias(tiebreak), F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, watermark)
    out = ", ".join([*(f"{k} {answers.schema[k].dataType.simpleString()}" for k in KEYS), f"{tiebreak} long", f"{ts} timestamp",
                     "time_diff double", "session_id long"])
    return rows.groupBy(*KEYS).applyInPandasWithState(
        _numberer(int(round(gap_minutes * 60_000_000)), ts, tiebreak), out, _STATE, "append", "EventTimeTimeout")
