"""Position curves (Q-11..Q-19, Q-21..Q-23, W-06, W-07).

All curves are ``groupBy`` aggregates over the long table restricted to the
first n positions, so the shuffle carries at most n rows per section row and
every aggregate is partial (map-side combined).  No array is built.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.operators.sections import SECTION_KEYS, SESSION_KEYS, number_within, session_arm


#: Difficulty at the questions that every arm shares (F-08).
DIFFICULTY_PATTERN = {1: 1, 2: 2, 10: 1, 11: 2, 12: 2}


def whole_session_long(in_sessions: DataFrame, ts: str = "created_at", tiebreak: str = "id") -> DataFrame:
    """Long table of whole (unsplit) sessions: ``spos``, ``n_questions`` and the arm."""
    long = number_within(in_sessions, SESSION_KEYS, ts=ts, tiebreak=tiebreak, pos="spos", total="n_questions")
    return long.join(session_arm(in_sessions), on=SESSION_KEYS, how="inner")


def retention(rows: DataFrame, n: int = 12, by: list[str] | None = None) -> DataFrame:
    """Q-11: share of section rows reaching question i (``q_len >= i``), i = 1..n.
    Published as "Omission Rate"; omission = 1 - retention (D-17).  Input: one row
    per section row with ``q_len``."""
    by = by if by is not None else ["experiment_mode"]
    x = rows.select(*by, "q_len", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    return x.groupBy(*by, "i").agg(F.avg((F.col("q_len") >= F.col("i")).cast("double")).alias("retention_rate"))


def difficulty_mix(long: DataFrame, n: int = 12, levels=(1, 2, 3), by: list[str] | None = None) -> DataFrame:
    """Q-12: per (arm, pos) share of each difficulty level among non-null levels."""
    by = by if by is not None else ["experiment_mode"]
    x = long.filter(F.col("pos") <= n)
    aggs = [F.count("difficulty_level").alias("_nn")] + [
        F.count_if(F.col("difficulty_level") == lv).alias(f"_l{lv}") for lv in levels]
    g = x.groupBy(*by, "pos").agg(*aggs)
    stack = ", ".join(f"{lv}, _l{lv}" for lv in levels)
    g = g.select(*by, "pos", "_nn", F.expr(f"stack({len(levels)}, {stack}) as (level, _c)"))
    return g.select(*by, "pos", F.col("level").cast("int").alias("level"),
                    (F.col("_c") / F.col("_nn")).alias("share"))


def position_mean_se(long: DataFrame, value, n: int = 12, by: list[str] | None = None,
                     pos: str = "pos", names: list[str] | None = None) -> DataFrame:
    """Q-13: mean over non-null values and SE = population std / sqrt(all rows at
    the position, nulls included) (D-14).  Several values share one aggregate:
    columns ``mean_<name>``/``se_<name>``; a single value gives ``mean``/``se``."""
    by = by if by is not None else ["experiment_mode"]
    values = [value] if isinstance(value, str) else list(value)
    single = isinstance(value, str) and names is None
    names = names or values
    aggs = [F.count(F.lit(1)).alias("_n")]
    for v, nm in zip(values, names):
        aggs += [F.avg(v).alias(f"_m_{nm}"), F.stddev_pop(v).alias(f"_sd_{nm}")]
    g = long.filter(F.col(pos) <= n).groupBy(*by, pos).agg(*aggs)
    cols = []
    for nm in names:
        m, se = ("mean", "se") if single else (f"mean_{nm}", f"se_{nm}")
        cols += [F.col(f"_m_{nm}").alias(m), (F.col(f"_sd_{nm}") / F.sqrt("_n")).alias(se)]
    return g.select(*by, pos, *cols)


def band(curve: DataFrame, z: float = 1.96) -> DataFrame:
    """Q-14 / D-19: mean +- z * se."""
    return curve.withColumn("lower", F.col("mean") - z * F.col("se")).withColumn(
        "upper", F.col("mean") + z * F.col("se"))


def gap_curve(wlong: DataFrame, n: int = 12, by: list[str] | None = None) -> DataFrame:
    """Q-15: mean answer gap at question j = 1..n of sessions with at least n
    answers, skipping the lead gap (the gap at item j is ``time_diff`` of the
    (j+1)-th answer; a session of exactly n answers has no n-th gap).  SE divides
    by the number of sessions; then running sums of means and SEs (W-06)."""
    by = by if by is not None else ["experiment_mode"]
    s = wlong.filter(F.col("n_questions") >= n)
    sessions = s.filter(F.col("spos") == 1).groupBy(*by).agg(F.count(F.lit(1)).alias("_ns"))
    g = (s.filter((F.col("spos") >= 2) & (F.col("spos") <= n + 1))
         .withColumn("j", (F.col("spos") - 1).cast("int"))
         .groupBy(*by, "j").agg(F.avg("time_diff").alias("mean_gap"), F.stddev_pop("time_diff").alias("_sd")))
    g = g.join(sessions, on=by, how="inner").withColumn("se_gap", F.col("_sd") / F.sqrt("_ns"))
    w = Window.partitionBy(*by).orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select(*by, "j", "mean_gap", "se_gap", F.sum("mean_gap").over(w).alias("cum_gap"),
                    F.sum("se_gap").over(w).alias("cum_se"))


def step_times(long: DataFrame, n: int = 12, keys: list[str] | None = None, ts: str = "created_at",
               pos: str = "pos") -> DataFrame:
    """W-07: per answer at positions 2..n, ``delta`` = t(p) - t(p-1) and ``acc`` =
    t(p) - t(1) in seconds.  The window only ever holds the first n rows of a
    section, so it is bounded whatever the session size."""
    keys = keys or SECTION_KEYS
    from seqlab.functions.timecols import seconds_between
    x = long.filter(F.col(pos) <= n)
    w = Window.partitionBy(*keys).orderBy(pos)
    x = x.withColumn("_prev", F.lag(ts).over(w)).withColumn("_first", F.first(ts).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.filter(F.col(pos) >= 2).withColumn("delta", seconds_between("_prev", ts)).withColumn(
        "acc", seconds_between("_first", ts)).drop("_prev", "_first")


def median_by_position(steps: DataFrame, value: str, by: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """Q-16: exact median (midpoint for even counts) per (arm, position), nulls ignored."""
    from seqlab.operators.quantiles import exact_quantiles
    by = by if by is not None else ["experiment_mode"]
    return exact_quantiles(steps, value, [*by, pos], (0.5,), [f"median_{value}"])


def ragged_curve(long: DataFrame, value: str = "is_correct", by: list[str] | None = None,
                 pos: str = "pos", spread: str = "se") -> DataFrame:
    """Q-17: mean, spread and n per position over all lengths (no cap).  Spread is
    std_pop / sqrt(n) (``se``) or std_pop (``std``); 0 when n = 1."""
    by = by if by is not None else ["experiment_mode"]
    g = long.groupBy(*by, pos).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"),
                                   F.count(value).alias("n"))
    sp = F.col("_sd") / F.sqrt("n") if spread == "se" else F.col("_sd")
    return g.select(*by, pos, "mean", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(sp).alias("spread"), "n")


def rate_by_difficulty(long: DataFrame, n: int = 12, levels=(1, 2, 3)) -> DataFrame:
    """Q-18: correct rate per (difficulty level, position) on the full level x
    position grid (null where no answer has that level there)."""
    grid = long.sparkSession.range(1, n + 1).select(
        F.col("id").cast("int").alias("pos"),
        F.explode(F.array(*[F.lit(int(lv)) for lv in levels])).alias("difficulty_level"))
    g = long.filter(F.col("pos") <= n).groupBy("difficulty_level", "pos").agg(F.avg("is_correct").alias("rate"))
    return grid.join(g, on=["difficulty_level", "pos"], how="left")


def rates_at_positions(long: DataFrame, positions: list[int], value: str = "is_correct", z: float = 1.83,
                       by: list[str] | None = None) -> DataFrame:
    """Q-19: mean and z * std_samp / sqrt(n) of the value at chosen positions
    (non-null values only; 0 when n <= 1)."""
    by = by if by is not None else ["experiment_mode"]
    g = long.filter(F.col("pos").isin(positions) & F.col(value).isNotNull()).groupBy(*by, "pos").agg(
        F.avg(value).alias("rate"), F.stddev_samp(value).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    return g.select(*by, F.concat(F.lit("Q"), F.col("pos").cast("string")).alias("position"), "rate",
                    F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(z * F.col("_sd") / F.sqrt("_n")).alias("sem"))


def first_n_profile(long: DataFrame, n: int = 12, keys: list[str] | None = None) -> DataFrame:
    """Q-21: mean difficulty and counts of levels 1, 2, 3 over the first n answers."""
    keys = keys or SECTION_KEYS + ["experiment_mode"]
    return long.filter(F.col("pos") <= n).groupBy(*keys).agg(
        F.avg("difficulty_level").alias("difficulty_mean"),
        *[F.count_if(F.col("difficulty_level") == lv).alias(f"n_level{lv}") for lv in (1, 2, 3)])


def session_totals(wlong: DataFrame, n: int = 12, include_lead_gap: bool = True) -> DataFrame:
    """Q-22: per whole session the null-safe sum of gaps (the lead gap before the
    first answer included by default, D-12), the answer count, the over-n flag and
    the sum of gaps at items 1..n."""
    gap = F.col("time_diff") if include_lead_gap else F.when(F.col("spos") >= 2, F.col("time_diff"))
    return wlong.groupBy(*SESSION_KEYS, "experiment_mode", "n_questions").agg(
        F.coalesce(F.sum(gap), F.lit(0.0)).alias("total_length"),
        F.sum(F.when((F.col("spos") >= 2) & (F.col("spos") <= n + 1), F.col("time_diff"))).alias("gap_1_n"),
    ).withColumn("over_n", (F.col("n_questions") > n).cast("int"))


def head_tail(wlong: DataFrame, head: int = 2, tail: int = 12, level: int = 1, min_n: int = 10) -> DataFrame:
    """Q-23: correctness at 0-based items ``head`` and ``tail`` where both have
    difficulty ``level``, per first section: mean head, mean tail, n = sessions with
    a non-null head answer (n > min_n)."""
    h, t = head + 1, tail + 1
    s = wlong.filter(F.col("n_questions") > tail)
    per = s.groupBy(*SESSION_KEYS).agg(
        F.max(F.when(F.col("spos") == h, F.col("is_correct"))).alias("head_corr"),
        F.max(F.when(F.col("spos") == t, F.col("is_correct"))).alias("tail_corr"),
        F.max(F.when(F.col("spos") == h, F.col("difficulty_level"))).alias("head_diff"),
        F.max(F.when(F.col("spos") == t, F.col("difficulty_level"))).alias("tail_diff"),
        F.max(F.when(F.col("spos") == 1, F.col("section_id"))).alias("section"))
    per = per.filter((F.col("head_diff") == level) & (F.col("tail_diff") == level))
    return per.groupBy("section").agg(F.avg("head_corr").alias("head_mean"), F.avg("tail_corr").alias("tail_mean"),
                                      F.count("head_corr").alias("n")).filter(F.col("n") > min_n)
