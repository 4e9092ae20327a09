"""Sessionization (W-01..W-05, G-02..G-05, D-01..D-04, D-08, D-11).

Skew-safe design
----------------
A window partitioned by (user, character) would put one very active user
into a single task.  Instead every run is cut into fixed time buckets
(``bucket_seconds``, default one minute):

1. ``lag(ts)`` inside (key, bucket)              -> local previous time
2. per (key, bucket): first/last time, inner breaks (hash aggregate, no
   extra shuffle: the input is already partitioned by (key, bucket))
3. on that small bucket table, per key ordered by bucket: previous
   bucket's last time and the running count of breaks before the bucket
4. join back, finish the flag of each bucket's first row, and number
   sessions as offset + running sum inside (key, bucket).

Only step 3 groups by the bare key, and it sees one row per bucket.  The
result equals the plain window formulation exactly (tests compare both).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seqlab.functions.timecols import epoch_micros, micros_between, seconds_between

# Width of the time buckets that split a key's run across tasks.  A window task
# holds at most (peak answers per second of one key) x BUCKET rows, whatever the
# key's total volume; the per-key bucket table holds at most one row per active
# minute (525,600 a year).  Keys with extreme rates can also set max_bucket_rows.
BUCKET = 60
DAY = 86_400


def _field(name: str):
    """One-argument lambda for ``transform`` that picks a struct field."""
    return lambda s: s[name]


def _bucket(ts: str, bucket_seconds: int) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(int(bucket_seconds) * 1_000_000)).cast("long")


SUB_BITS = 20  # a bucket splits into at most 2**20 sub-buckets
MAX_BUCKET_ROWS = None  # opt-in: count-based splitting of bursting buckets
HOT_BROADCAST_ROWS = 1_000_000


def split_buckets(df: DataFrame, keys: list[str], ts: str, bucket_seconds: int = BUCKET,
                  max_bucket_rows: int | None = MAX_BUCKET_ROWS, out: str = "_b") -> DataFrame:
    """Add a bucket id ordered like time within ``keys``.  A (key, bucket) with
    more than ``max_bucket_rows`` rows is cut into f = ceil(rows / max) equal
    time slices, so one key bursting inside one bucket is still spread over
    tasks.  The hot list comes from one narrow partial aggregate and has at most
    rows / max_bucket_rows entries; a bounded count proves it small before it is
    broadcast (then the rows are not shuffled for it), otherwise it is joined
    normally."""
    coarse = _bucket(ts, bucket_seconds)
    x = df.withColumn("_cb", coarse)
    if not max_bucket_rows:
        return x.withColumn(out, F.col("_cb") * F.lit(1 << SUB_BITS)).drop("_cb")
    hot = (x.groupBy(*keys, "_cb").agg(F.count(F.lit(1)).alias("_cnt"))
           .filter(F.col("_cnt") > max_bucket_rows)
           .select(*keys, "_cb", F.least(F.ceil(F.col("_cnt") / F.lit(max_bucket_rows)),
                                         F.lit((1 << SUB_BITS) - 1)).cast("long").alias("_f")))
    if hot.limit(HOT_BROADCAST_ROWS + 1).count() <= HOT_BROADCAST_ROWS:
        hot = F.broadcast(hot)
    x = x.join(hot, on=[*keys, "_cb"], how="left")
    width_us = int(bucket_seconds) * 1_000_000
    offset = epoch_micros(ts) - F.col("_cb") * F.lit(width_us)
    sub = F.when(F.col("_f").isNull(), F.lit(0)).otherwise(F.floor(offset * F.col("_f") / F.lit(width_us)))
    return x.withColumn(out, F.col("_cb") * F.lit(1 << SUB_BITS) + sub.cast("long")).drop("_cb", "_f")


def _running_offset(small: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over earlier ``order`` rows of the same key (0 for the first)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return small.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


#: Rows without time that a task numbers together.
UNTIMED_ROWS = 100_000


def number_by_id(df: DataFrame, keys: list[str], tiebreak: str, out: str, most: int = UNTIMED_ROWS) -> DataFrame:
    """Number the rows of each key from 1 in order of an integer id, without one task for one key.

    A key's ids are cut into equal ranges, about one for each ``most`` rows, and each range of more than
    ``most`` rows once more (ids may come in clusters).  Rows are numbered inside a range (columns ``_h1``,
    ``_h2``), after the rows of earlier ranges; only the table of ranges is ordered by key.
    """
    x, levels = df, []
    for level in ("_h1", "_h2"):
        here = [*keys, *levels]
        span = x.groupBy(*here).agg(F.min(tiebreak).alias("_lo"), F.max(tiebreak).alias("_hi"), F.count(F.lit(1)).alias("_c"))
        ranges = F.ceil(F.col("_c") / F.lit(most))
        share = (F.col(tiebreak).cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo") + 1)
        x = x.join(span, here).withColumn(level, F.least(F.floor(share * ranges), ranges - 1).cast("long")).drop("_lo", "_hi", "_c")
        levels.append(level)
    counts = x.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(*levels).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*keys, *levels).orderBy(tiebreak))
    return x.withColumn("_place", inside).join(counts, [*keys, *levels]).withColumn(out, F.col("_before") + F.col("_place")).drop("_place", "_before")


def assign_sessions(
    df: DataFrame,
    gap_seconds: float = 1800,
    flavour: str = "per_character",
    user: str = "user_id",
    character: str = "gamecharacter_id",
    ts: str = "created_at",
    tiebreak: str = "id",
    null_ts: str = "drop",
    bucket_seconds: int = BUCKET,
    max_bucket_rows: int | None = MAX_BUCKET_ROWS,
) -> DataFrame:
    """Add ``prev_time``, ``time_diff`` (s), ``new_session`` and ``session_id``.

    flavour ``per_character``: previous time and numbering per (user, character)
    (the SQL scripts).  ``user_global``: previous time per (user, character) but
    numbering per user (the pandas pipeline, D-01).
    null_ts: ``drop`` (default), ``new`` (every null-time row opens a session, as
    pandas) or ``join`` (first null row joins the last session, as SQL) (D-03).
    A new session starts when there is no previous time or the gap is strictly
    greater than ``gap_seconds`` (W-03).  ``bucket_seconds`` / ``max_bucket_rows``
    control how a key's run is cut across tasks (``split_buckets``); results do not
    depend on them.
    """
    if flavour not in ("per_character", "user_global"):
        raise ValueError(f"unknown flavour {flavour!r}")
    if null_ts not in ("drop", "new", "join"):
        raise ValueError(f"unknown null_ts {null_ts!r}")
    keys = [user, character]
    gap_us = int(round(gap_seconds * 1_000_000))
    cols = df.columns
    base = df.filter(F.col(user).isNotNull() & F.col(character).isNotNull())  # D-04
    timed = base.filter(F.col(ts).isNotNull())

    # per-user numbering needs one bucket layout for all characters of a user
    split_keys = keys if flavour == "per_character" else [user]
    r1 = split_buckets(timed, split_keys, ts, bucket_seconds, max_bucket_rows)
    w_local = Window.partitionBy(*keys, "_b").orderBy(F.col(ts).asc_nulls_last(), F.col(tiebreak))
    r1 = r1.withColumn("_prev_local", F.lag(ts).over(w_local))

    buckets = r1.groupBy(*keys, "_b").agg(
        F.min(ts).alias("_bmin"),
        F.max(ts).alias("_bmax"),
        F.count_if(micros_between("_prev_local", ts) > gap_us).alias("_inner"),
    )
    wb = Window.partitionBy(*keys).orderBy("_b")
    buckets = buckets.withColumn("_prev_b", F.lag("_bmax").over(wb))
    buckets = buckets.withColumn(
        "_start",
        F.when(F.col("_prev_b").isNull() | (micros_between("_prev_b", "_bmin") > gap_us), 1).otherwise(0),
    ).withColumn("_breaks", F.col("_start") + F.col("_inner"))
    buckets = _running_offset(buckets, keys, "_b", "_breaks", "_off")

    r2 = r1.join(buckets.select(*keys, "_b", "_prev_b", "_off"), on=[*keys, "_b"], how="inner")
    prev = F.coalesce(F.col("_prev_local"), F.col("_prev_b"))
    r2 = r2.withColumn("prev_time", prev).withColumn(
        "new_session",
        F.when(F.col("prev_time").isNull() | (micros_between("prev_time", ts) > gap_us), 1).otherwise(0),
    )
    run = Window.partitionBy(*keys, "_b").orderBy(F.col(ts).asc_nulls_last(), F.col(tiebreak)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    if flavour == "per_character":
        r2 = r2.withColumn("session_id", F.col("_off") + F.sum("new_session").over(run))
        num_keys = keys
    else:
        ub = r2.groupBy(user, "_b").agg(F.sum("new_session").alias("_uflags"))
        ub = _running_offset(ub, [user], "_b", "_uflags", "_uoff")
        r2 = r2.join(ub.select(user, "_b", "_uoff"), on=[user, "_b"], how="inner")
        urun = Window.partitionBy(user, "_b").orderBy(F.col(ts).asc_nulls_last(), F.col(tiebreak)).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        r2 = r2.withColumn("session_id", F.col("_uoff") + F.sum("new_session").over(urun))
        num_keys = [user]
    r2 = r2.withColumn("session_id", F.col("session_id").cast("long"))
    r2 = r2.withColumn("time_diff", seconds_between("prev_time", ts))
    out_cols = cols + ["prev_time", "time_diff", "new_session", "session_id"]
    out = r2.select(*out_cols)
    if null_ts == "drop":
        return out

    # Null timestamps sort after all timed rows (ascending, nulls last), ordered by id.
    nulls = base.filter(F.col(ts).isNull())
    last = out.groupBy(*num_keys).agg(F.max("session_id").alias("_m"))
    if isinstance(nulls.schema[tiebreak].dataType, IntegralType):
        nulls = number_by_id(nulls, num_keys, tiebreak, "_r").drop("_h1", "_h2")
    else:  # no ranges of ids that are no numbers: one task for one key
        nulls = nulls.withColumn("_r", F.row_number().over(Window.partitionBy(*num_keys).orderBy(tiebreak)))
    nulls = nulls.join(last, on=num_keys, how="left")
    m = F.coalesce(F.col("_m"), F.lit(0))
    if null_ts == "new":
        sid = m + F.col("_r")
        flag = F.lit(1)
    else:  # join: first null row continues the last session when there is one
        sid = F.when(F.col("_m").isNull(), F.col("_r")).otherwise(m + F.col("_r") - 1)
        flag = F.when((F.col("_r") == 1) & F.col("_m").isNotNull(), 0).otherwise(1)
    nulls = nulls.select(
        *cols,
        F.lit(None).cast(out.schema["prev_time"].dataType).alias("prev_time"),
        F.lit(None).cast("double").alias("time_diff"),
        flag.cast("int").alias("new_session"),
        sid.cast("long").alias("session_id"),
    )
    return out.unionByName(nulls)


def assign_sessions_plain(
    df: DataFrame, gap_seconds: float = 1800, flavour: str = "per_character",
    user: str = "user_id", character: str = "gamecharacter_id", ts: str = "created_at", tiebreak: str = "id",
) -> DataFrame:
    """Textbook window sessionizer (lag + running sum).  Used as the test oracle
    for ``assign_sessions``; it keeps one (user, character) in one task."""
    keys = [user, character]
    gap_us = int(round(gap_seconds * 1_000_000))
    w = Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_last(), F.col(tiebreak))
    part = keys if flavour == "per_character" else [user]
    run = Window.partitionBy(*part).orderBy(F.col(ts).asc_nulls_last(), F.col(tiebreak)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = (
        df.filter(F.col(user).isNotNull() & F.col(character).isNotNull() & F.col(ts).isNotNull())
        .withColumn("prev_time", F.lag(ts).over(w))
        .withColumn("new_session", F.when(F.col("prev_time").isNull()
                                          | (micros_between("prev_time", ts) > gap_us), 1).otherwise(0))
        .withColumn("session_id", F.sum("new_session").over(run).cast("long"))
        .withColumn("time_diff", seconds_between("prev_time", ts))
    )
    return out


def session_table(
    df: DataFrame,
    keys: tuple[str, ...] = ("user_id", "gamecharacter_id", "session_id"),
    ts: str = "created_at",
    tiebreak: str = "id",
    array_cols: dict[str, str] | None = None,
    first_cols: dict[str, str] | None = None,
    mode_cols: dict[str, str] | None = None,
    unit: str = "seconds",
    chunk_size: int | None = None,
) -> DataFrame:
    """G-02..G-05: one row per session.

    ``array_cols`` {output: input}: parallel arrays in (ts, id) order, nulls kept
    (D-08) by collecting one struct per answer and sorting it once.
    ``first_cols``: value at the earliest (ts, id) (D-11, ``min_by``).
    ``mode_cols``: most frequent value, lowest on ties, null if all null (G-05).
    Scalars are computed with partial (map-side) aggregation; only the arrays
    need the whole session in one task, and only when asked for.  ``chunk_size``
    bounds that too: arrays are emitted as rows (session, ``chunk``) of at most
    ``chunk_size`` elements, positions coming from the skew-safe ``number_within``.
    """
    keys = list(keys)
    order = F.struct(F.col(ts).isNull(), F.col(ts), F.col(tiebreak))
    aggs = [
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.count(F.lit(1)).alias("n_questions"),
    ]
    for out, src in (first_cols or {}).items():
        aggs.append(F.min_by(F.col(src), order).alias(out))
    for out, src in (mode_cols or {}).items():
        aggs.append(F.mode(F.col(src), True).alias(out))
    if array_cols:
        fields = [F.col(ts).alias("_t"), F.col(tiebreak).alias("_i")] + [
            F.col(src).alias(f"_a{j}") for j, src in enumerate(array_cols.values())]
        aggs.append(F.array_sort(F.collect_list(F.struct(*fields))).alias("_arr"))
    if array_cols and chunk_size:
        from seqlab.operators.sections import number_within
        scalars = session_table(df, tuple(keys), ts, tiebreak, None, first_cols, mode_cols, unit)
        pos = number_within(df, keys, ts=ts, tiebreak=tiebreak, pos="_pos", total="_tot")
        pos = pos.withColumn("chunk", ((F.col("_pos") - 1) / F.lit(int(chunk_size))).cast("int"))
        st = F.struct(F.col("_pos"), *[F.col(src).alias(f"_a{j}") for j, src in enumerate(array_cols.values())])
        arr = pos.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(st)).alias("_arr"))
        for j, name in enumerate(array_cols):
            arr = arr.withColumn(name, F.transform("_arr", _field(f"_a{j}")))
        return scalars.join(arr.drop("_arr"), on=keys, how="inner")
    out = df.groupBy(*keys).agg(*aggs)
    scale = 60.0 if unit == "minutes" else 1.0
    out = out.withColumn("session_length", seconds_between("start_time", "end_time") / F.lit(scale))
    if array_cols:
        for j, name in enumerate(array_cols):
            out = out.withColumn(name, F.transform("_arr", _field(f"_a{j}")))
        out = out.drop("_arr")
    return out
