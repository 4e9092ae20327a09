"""Sequence operators (Q-03..Q-10, Q-20, Q-24, J-09, J-10).

Everything runs on the long table (one row per answer with ``pos``): the
prescribed (control) sequence is a long table too, ``(section_id,
experiment_mode, pos, cq)``, joined on three typed keys (never a string
key).  Validity and prefix matching reduce to one number per section row,
the first position whose question differs from the control, found with a
``min`` aggregate (map-side combined); prefix curves then explode only the
n positions of each section row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlab.operators.sections import SECTION_KEYS

CTRL_KEYS = ["section_id", "experiment_mode"]


def control_from_wide(wide: DataFrame, n: int = 12, qcol: str = "Q{i}") -> DataFrame:
    """Q-05 / Q-24: Q1..Qn columns -> long ``(section_id, experiment_mode, pos, cq)``."""
    stack = ", ".join(f"{i}, `{qcol.format(i=i)}`" for i in range(1, n + 1))
    return wide.select(*CTRL_KEYS, F.expr(f"stack({n}, {stack}) as (pos, cq)")).withColumn(
        "pos", F.col("pos").cast("int"))


def control_to_wide(ctrl: DataFrame, n: int = 12) -> DataFrame:
    """Long control -> one row per (section, arm) with Q1..Qn (G-11 pivot on known values)."""
    return (ctrl.groupBy(*CTRL_KEYS).pivot("pos", list(range(1, n + 1))).agg(F.first("cq"))
            .select(*CTRL_KEYS, *[F.col(str(i)).alias(f"Q{i}") for i in range(1, n + 1)]))


def recode_arms(df: DataFrame, col: str = "sequence", out: str = "experiment_mode",
                mapping: dict | None = None) -> DataFrame:
    """F-13: arm label -> arm code (control 0, treatment1..3 -> 1..3)."""
    mapping = mapping or {"control": 0, "treatment1": 1, "treatment2": 2, "treatment3": 3}
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v)
    return df.withColumn(out, expr.cast("int"))


def section_id_lookup(questions: DataFrame, name_col: str = "section_name", id_col: str = "section_id",
                      order_col: str | None = None) -> DataFrame:
    """J-10: section name -> id, last duplicate wins (by ``order_col``, else the largest id)."""
    order = F.col(order_col) if order_col else F.col(id_col)
    return questions.groupBy(name_col).agg(F.max_by(F.col(id_col), order).alias(id_col))


def modal_control(long_data: DataFrame, n: int = 12) -> DataFrame:
    """Control sequences derived from the data: the lowest modal question at each
    position per (section, arm), over first sessions with at least n answers
    inside an arm."""
    return (long_data.filter((F.col("experiment_mode") != -1) & (F.col("pos") <= n))
            .groupBy(*CTRL_KEYS, "pos").agg(F.mode("question_id", True).alias("cq")))


def first_mismatch(long: DataFrame, ctrl: DataFrame, n: int = 12, carry: list[str] | None = None) -> DataFrame:
    """One row per section row: ``has_control`` and ``first_mismatch`` (first pos <= n
    whose question differs from the control, null when none; J-09, Q-03).

    ``carry`` fields of the first n answers ride along in the same aggregate as a
    ``first_n`` array of structs (at most n elements), so cohorts defined by
    validity can be expanded with ``inline`` instead of a join back."""
    keys = ctrl.select(*CTRL_KEYS).distinct().withColumn("has_control", F.lit(True))
    ln = long.filter(F.col("pos") <= n).join(ctrl, on=[*CTRL_KEYS, "pos"], how="left")
    aggs = [F.min(F.when(~F.col("question_id").eqNullSafe(F.col("cq")), F.col("pos"))).alias("first_mismatch")]
    if carry:
        aggs.append(F.array_sort(F.collect_list(F.struct("pos", *carry))).alias("first_n"))
    per = ln.groupBy(*SECTION_KEYS, "experiment_mode", "q_len").agg(*aggs)
    return (per.join(keys, on=CTRL_KEYS, how="left")
            .withColumn("has_control", F.coalesce(F.col("has_control"), F.lit(False))))


def _ok_through(k) -> F.Column:
    fm = F.col("first_mismatch")
    return F.col("has_control") & (fm.isNull() | (fm > k))


def seq_valid(checked: DataFrame, n: int = 12) -> DataFrame:
    """Q-06: control exists, at least n answers, first n equal the control."""
    return checked.withColumn("seq_valid", _ok_through(F.lit(n)) & (F.col("q_len") >= n))


def seq_valid_tolerant(checked: DataFrame, i: int) -> DataFrame:
    """Q-07: compare only the first min(len, i) items (missing control -> false)."""
    return checked.withColumn(f"seq_valid_less{i}inc", _ok_through(F.least(F.col("q_len"), F.lit(i))))


def prefix_curve(checked: DataFrame, n: int = 12, by: list[str] | None = None) -> DataFrame:
    """Q-08 / Q-09: share of rows whose first i questions equal the control, i = 1..n."""
    by = by or []
    x = checked.select(*by, "has_control", "first_mismatch", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    return x.groupBy(*by, "i").agg(F.avg(_ok_through(F.col("i")).cast("double")).alias("match_ratio"))


def position_match(long: DataFrame, ctrl: DataFrame, n: int = 12, by: list[str] | None = None) -> DataFrame:
    """Q-10: per position, share of rows whose question equals the control's
    (rows without a control count as not matching)."""
    by = by if by is not None else ["experiment_mode"]
    ln = long.filter(F.col("pos") <= n).join(ctrl, on=[*CTRL_KEYS, "pos"], how="left")
    hit = F.coalesce(F.col("question_id") == F.col("cq"), F.lit(False))
    return ln.groupBy(*by, "pos").agg(F.avg(hit.cast("double")).alias("match_ratio"))


def modal_conformity(long_data: DataFrame, positions=(1, 2, 6, 10, 11, 12), mode_arm: int | None = None) -> DataFrame:
    """Q-20: modal question per (arm, pos); ``all_mode`` = the row's question equals
    its arm's mode at every listed position.  ``mode_arm=3`` reproduces comparing
    every row with arm 3's modes (D-05)."""
    pos = list(positions)
    sub = long_data.filter(F.col("pos").isin(pos))
    modes = sub.groupBy("experiment_mode", "pos").agg(F.mode("question_id", True).alias("q_mode"))
    if mode_arm is not None:
        modes = modes.filter(F.col("experiment_mode") == mode_arm).drop("experiment_mode")
        j = sub.join(modes, on=["pos"], how="left")
    else:
        j = sub.join(modes, on=["experiment_mode", "pos"], how="left")
    ok = F.coalesce(F.col("question_id") == F.col("q_mode"), F.lit(False))
    return j.groupBy(*SECTION_KEYS, "experiment_mode").agg(
        (F.count_if(ok) == F.lit(len(pos))).alias("all_mode"))


def melt_positions(long: DataFrame, positions: list[int], value: str, keys: list[str]) -> DataFrame:
    """Q-24: the wide q_i columns in long form -> (keys, position, value) rows."""
    return long.filter(F.col("pos").isin(positions)).select(*keys, F.col("pos").alias("position"),
                                                            F.col(value).alias("value"))
