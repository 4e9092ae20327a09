"""Joins, dedup and summary helpers on small literal tables."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seqlab.operators import enrich as E
from seqlab.operators import summary as M
from seqlab.operators import sequences as S

T0 = datetime(2024, 1, 1)


def test_null_safe_join_and_sql_join(spark):
    fact = spark.createDataFrame([(1, None), (2, 5)], "id int, q int")
    dim = spark.createDataFrame([(None, "n"), (5, "five")], "q int, name string")
    sql = {r["id"]: r["name"] for r in E.join_dimension(fact, dim, "q").collect()}
    safe = {r["id"]: r["name"] for r in E.join_dimension(fact, dim, "q", null_safe=True).collect()}
    assert sql == {1: None, 2: "five"} and safe == {1: "n", 2: "five"}


def test_duplicate_dimension_keys(spark):
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q int, name string")
    fact = spark.createDataFrame([(10, 1)], "id int, q int")
    assert E.join_dimension(fact, dim, "q").count() == 2
    assert [r["q"] for r in E.assert_unique(dim, ["q"]).collect()] == [1]


def test_checked_broadcast_respects_bound(spark):
    small = spark.range(5)
    assert E.checked_broadcast(small, max_rows=10).count() == 5
    big = E.checked_broadcast(spark.range(50), max_rows=10)
    assert "broadcast" not in big._jdf.queryExecution().logical().toString().lower()


def test_keep_first_prefers_earliest_then_id_and_nulls_last(spark):
    rows = [(3, 1, T0, 7), (2, 1, T0, 8), (1, 1, None, 9), (4, 2, T0 + timedelta(1), 1)]
    df = spark.createDataFrame(rows, "id int, k int, created_at_utc8 timestamp_ntz, arm int")
    got = {r["k"]: r["arm"] for r in E.keep_first(df, ["k"], value_cols=["arm"]).collect()}
    assert got == {1: 8, 2: 1}


def test_semi_join_and_flag(spark):
    answers = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, user_id int")
    users = spark.createDataFrame([(1,), (1,)], "user_id int")
    assert E.semi_join_users(answers, users).count() == 2
    flags = {r["id"]: r["is_experiment"] for r in E.experiment_flag(answers, users).collect()}
    assert flags == {1: True, 2: True, 3: False}


def test_control_wide_long_roundtrip(spark):
    ctrl = spark.createDataFrame([(0, 1, p, 100 + p) for p in range(1, 13)],
                                 "section_id long, experiment_mode int, pos int, cq long")
    wide = S.control_to_wide(ctrl, 12)
    back = S.control_from_wide(wide, 12)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ctrl.collect()))


def test_union_labelled_and_positional_pattern(spark):
    a = spark.createDataFrame([(1,), (2,)], "experiment_mode int")
    b = spark.createDataFrame([(-1,)], "experiment_mode int")
    u = M.union_labelled([(a, None), (b, "non-filter")])
    assert sorted(r[0] for r in u.collect()) == ["1", "2", "non-filter"]
    rows = [(1, p, d) for p, d in [(1, 1), (2, 2), (3, 3)]] + [(2, p, d) for p, d in [(1, 1), (2, 1), (3, 3)]]
    df = spark.createDataFrame(rows, "s int, spos int, difficulty_level int")
    assert [r["s"] for r in M.positional_pattern(df, {1: 1, 2: 2}, ["s"]).collect()] == [1]


def test_histogram_last_bin_closed_and_constant(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)], "x double")
    h = {r["bin"]: r["n"] for r in M.histogram(df, "x", 10).collect()}
    assert h[10] == 2 and sum(h.values()) == 11
    c = M.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).collect()
    assert [(r["bin"], r["n"]) for r in c] == [(1, 2)]


def test_crosstab_fills_zero(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, False)], "arm int, h boolean")
    got = {r["arm"]: (r["homo"], r["mixed"]) for r in M.crosstab(df, "arm", "h", [True, False], ["homo", "mixed"]).collect()}
    assert got == {1: (2, 0), 2: (0, 1)}


def test_describe_and_box(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 100)], "g int, v double")
    d = M.describe(df, "v", ["g"]).first()
    assert (d["count"], d["p25"], d["p50"], d["p75"], d["max"]) == (5, 2.0, 3.0, 4.0, 100.0)
    b = M.box_summary(df, "v", ["g"]).first()
    assert (b["whisker_low"], b["whisker_high"], b["n_outliers"]) == (1.0, 4.0, 1)
