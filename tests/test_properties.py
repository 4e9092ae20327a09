"""Properties from the test strategy: numbering, counts, monotone curves, shares."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqlab.plans import pipeline as PL
from seqlab.plans.registry import QUERIES, load_all

ROOT = "/root/testdata/sf0.01"
load_all()


def test_session_numbers_start_at_one_and_never_decrease(spark):
    s = PL.in_sessions(spark, ROOT)
    w = Window.partitionBy("user_id", "gamecharacter_id").orderBy("created_at", "id")
    x = s.withColumn("_prev", F.lag("session_id").over(w))
    assert x.filter(F.col("_prev").isNull() & (F.col("session_id") != 1)).count() == 0
    assert x.filter(F.col("session_id") < F.col("_prev")).count() == 0
    assert x.filter((F.col("session_id") - F.col("_prev")) > 1).count() == 0


def test_session_counts_add_up(spark):
    cohort_rows = PL.cohort(spark, ROOT).where("created_at is not null").count()
    t = QUERIES["sessions_user_global"](spark, ROOT)
    assert t.agg(F.sum("answer_length")).first()[0] == cohort_rows
    arr_len = F.size(F.split("is_correct", ","))
    assert t.filter(arr_len != F.col("answer_length")).count() == 0


def test_positions_are_dense(spark):
    long = PL.long_table(spark, ROOT)
    g = long.groupBy("user_id", "gamecharacter_id", "session_id", "section_id", "q_len").agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("mx"), F.count_distinct("pos").alias("d"))
    assert g.filter((F.col("n") != F.col("q_len")) | (F.col("mx") != F.col("q_len")) | (F.col("d") != F.col("n"))).count() == 0


def test_retention_non_increasing(spark):
    r = QUERIES["retention_by_arm"](spark, ROOT).collect()
    by = {}
    for x in r:
        by.setdefault(x["experiment_mode"], {})[x["i"]] = x["retention_rate"]
    for curve in by.values():
        assert all(curve[i] >= curve[i + 1] for i in range(1, 12))


def test_difficulty_shares_sum_to_one(spark):
    d = QUERIES["difficulty_mix"](spark, ROOT).groupBy("experiment_mode", "pos").agg(F.sum("share").alias("s"))
    assert d.filter(F.abs(F.col("s") - 1) > 1e-5).count() == 0


def test_prefix_ratio_non_increasing(spark):
    r = {x["i"]: x["match_ratio"] for x in QUERIES["prefix_ratio"](spark, ROOT).collect()}
    assert all(r[i] >= r[i + 1] for i in range(1, 12))


def test_input_order_does_not_matter(spark):
    """Metamorphic: shuffling the input rows leaves the sessions unchanged."""
    from seqlab.operators.sessions import assign_sessions
    c = PL.cohort(spark, ROOT, PL.Params())
    a = assign_sessions(c, gap_seconds=3600 * 60).select("id", "session_id")
    b = assign_sessions(c.orderBy(F.rand(11)).repartition(5), gap_seconds=3600 * 60).select("id", "session_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_materialized_long_table_equals_lazy(spark):
    import tempfile
    p = PL.Params()
    path = tempfile.mkdtemp(prefix="seqlab-long-") + "/t"
    m = PL.materialize_long_table(spark, "/root/testdata/sf0.001", p, path)
    lazy = PL.long_table(spark, "/root/testdata/sf0.001", p)
    cols = ["id", "session_id", "pos", "q_len", "experiment_mode"]
    assert m.select(*cols).exceptAll(lazy.select(*cols)).count() == 0
    assert m.count() == lazy.count()
