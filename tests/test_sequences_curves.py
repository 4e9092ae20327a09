"""Sequence validity, retention, curves and medians on hand-made long tables."""
from datetime import datetime, timedelta

import pytest
import tempfile

from pyspark.sql import functions as F

from seqlab.operators import curves as C
from seqlab.operators import sequences as S

LONG = ("user_id long, gamecharacter_id long, session_id long, section_id long, pos int, q_len long, "
        "experiment_mode int, question_id long, is_correct int, difficulty_level int, created_at timestamp_ntz")
T0 = datetime(2024, 1, 1)


def long_rows(uid, seq, arm=1, section=0, corr=None, diff=None, step=60):
    n = len(seq)
    return [(uid, uid * 10, 1, section, i + 1, n, arm, q, (corr or [1] * n)[i], (diff or [1] * n)[i],
             T0 + timedelta(seconds=step * i)) for i, q in enumerate(seq)]


def control(spark, seq, arm=1, section=0):
    return spark.createDataFrame([(section, arm, i + 1, q) for i, q in enumerate(seq)],
                                 "section_id long, experiment_mode int, pos int, cq long")


@pytest.fixture(scope="module")
def validity(spark):
    ctrl_seq = list(range(1, 13))
    rows = (long_rows(1, ctrl_seq) + long_rows(2, ctrl_seq[:4] + [99] + ctrl_seq[5:])
            + long_rows(3, ctrl_seq[:4]) + long_rows(4, ctrl_seq, arm=2))
    long = spark.createDataFrame(rows, LONG)
    chk = S.first_mismatch(long, control(spark, ctrl_seq), 12)
    chk = S.seq_valid(chk, 12)
    for i in (4, 12):
        chk = S.seq_valid_tolerant(chk, i)
    return {r["user_id"]: r for r in chk.collect()}


def test_exact_validity(validity):
    assert [validity[u]["seq_valid"] for u in (1, 2, 3, 4)] == [True, False, False, False]


def test_tolerant_validity(validity):
    assert [validity[u]["seq_valid_less12inc"] for u in (1, 2, 3, 4)] == [True, False, True, False]
    assert [validity[u]["seq_valid_less4inc"] for u in (1, 2, 3, 4)] == [True, True, True, False]


def test_prefix_curve_non_increasing(spark, validity):
    ctrl_seq = list(range(1, 13))
    rows = long_rows(1, ctrl_seq) + long_rows(2, ctrl_seq[:4] + [99] + ctrl_seq[5:]) + long_rows(4, ctrl_seq, arm=2)
    long = spark.createDataFrame(rows, LONG)
    chk = S.first_mismatch(long, control(spark, ctrl_seq), 12)
    curve = {r["i"]: r["match_ratio"] for r in S.prefix_curve(chk, 12).collect()}
    assert curve[1] == pytest.approx(2 / 3) and curve[5] == pytest.approx(1 / 3)
    assert all(curve[i] >= curve[i + 1] for i in range(1, 12))


def test_retention(spark):
    rows = spark.createDataFrame([(1, 12), (1, 6), (1, 1)], "experiment_mode int, q_len long")
    r = {x["i"]: x["retention_rate"] for x in C.retention(rows, 12).collect()}
    assert r[1] == 1.0 and r[2] == pytest.approx(2 / 3) and r[6] == pytest.approx(2 / 3)
    assert r[7] == pytest.approx(1 / 3) and r[12] == pytest.approx(1 / 3)


def test_difficulty_mix_ignores_nulls(spark):
    rows = [(u, u, 1, 0, 1, 12, 1, 1, 1, d, T0) for u, d in [(1, 1), (2, 2), (3, None)]]
    mix = {r["level"]: r["share"] for r in C.difficulty_mix(spark.createDataFrame(rows, LONG), 12).collect()}
    assert mix == {1: 0.5, 2: 0.5, 3: 0.0}


def test_position_se_counts_all_sessions(spark):
    rows = [(u, u, 1, 0, 1, 12, 1, 1, c, 1, T0) for u, c in [(1, 1), (2, None), (3, 0)]]
    out = C.position_mean_se(spark.createDataFrame(rows, LONG), "is_correct", 12).first()
    assert out["mean"] == pytest.approx(0.5) and out["se"] == pytest.approx(0.5 / 3 ** 0.5)


def test_ragged_single_value_spread_zero(spark):
    rows = long_rows(1, list(range(13))) + long_rows(2, list(range(12)))
    out = {r["pos"]: r for r in C.ragged_curve(spark.createDataFrame(rows, LONG)).collect()}
    assert out[13]["n"] == 1 and out[13]["spread"] == 0.0 and out[1]["n"] == 2


def test_median_even_count_is_midpoint(spark):
    df = spark.createDataFrame([(1, 2, float(v)) for v in (1, 2, 3, 10)], "experiment_mode int, pos int, delta double")
    assert C.median_by_position(df, "delta").first()["median_delta"] == 2.5


def test_step_times(spark):
    rows = long_rows(1, [1, 2, 3], step=10)
    st = {r["pos"]: (r["delta"], r["acc"]) for r in C.step_times(spark.createDataFrame(rows, LONG), 12).collect()}
    assert st == {2: (10.0, 10.0), 3: (10.0, 20.0)}


def test_mode_lowest_on_ties_and_null_when_empty(spark):
    from seqlab.operators.sections import session_arm
    df = spark.createDataFrame([(1, 2), (1, 1), (1, 1), (1, 2), (2, None), (3, 3)], "k long, x int")
    got = {r["k"]: r["m"] for r in session_arm(df, ["k"], "x", "m", fill=None).collect()}
    assert got == {1: 1, 2: None, 3: 3}


def test_volume_codes(spark):
    from seqlab.functions.scalar import volume_code
    df = spark.createDataFrame([("ㄧ年級",), ("一年級",), ("總複習",), ("五年級上",)], "v string")
    got = [(r[0], r[1]) for r in df.select(volume_code("v"), volume_code("v", strict=True)).collect()]
    assert got == [(1, 1), (1, 0), (0, 0), (5, 5)]


def test_exact_quantiles_match_percentile(spark):
    """Skew-safe quantiles equal Spark's percentile, with a hot group and ties."""
    import random
    from seqlab.operators.quantiles import exact_quantiles
    rnd = random.Random(1)
    rows = [(0, float(rnd.randint(0, 50))) for _ in range(5000)] + [(1, float(v)) for v in (1, 2, 3, 10)] + \
           [(2, 7.0)] + [(3, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in
           exact_quantiles(df, "v", ["g"], (0.25, 0.5, 0.9), ["a", "b", "c"]).collect()}
    exp = {r["g"]: tuple(r["q"]) for r in df.groupBy("g").agg(
        F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q")).collect() if r["q"] is not None}
    assert set(got) == {0, 1, 2}
    for k in got:
        assert got[k] == pytest.approx(exp[k])
    assert got[1][1] == 2.5


def test_exact_quantiles_do_not_depend_on_the_layout(spark):
    """200,000 values in three groups, one of them null, without reuse of exchanges."""
    from seqlab.operators.quantiles import exact_quantiles
    df = spark.range(200_000, numPartitions=7).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END AS g", "pow(rand(5), 9) * 1e6 AS v").repartition(5)
    df = df.withColumn("v", F.when(F.col("g") == "y", F.round("v")).otherwise(F.col("v")))
    path = tempfile.mkdtemp(prefix="seqlab-q-") + "/t"
    df.write.parquet(path)
    df = spark.read.parquet(path)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r["g"]: (r["a"], r["b"], r["c"]) for r in exact_quantiles(df, "v", ["g"], (0.25, 0.5, 0.75), ["a", "b", "c"]).collect()}
        all_rows = exact_quantiles(df, "v", [], (0.5,), ["m"], count_name="n").first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = {r["g"]: tuple(r["q"]) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    assert set(got) == {"x", "y", None}
    for g, q in want.items():
        assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(got[g], q, strict=True))
    assert all_rows["n"] == 200_000 and abs(all_rows["m"] - df.agg(F.percentile("v", F.lit(0.5))).first()[0]) < 1e-6


def test_null_groups_stay_in_summaries(spark):
    from seqlab.operators import summary as M
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 9.0), (1, 5.0), (1, None)], "g int, v double")
    d = {r["g"]: (r["count"], r["p50"]) for r in M.describe(df, "v", ["g"]).collect()}
    assert d == {None: (3, 2.0), 1: (1, 5.0)}
    assert {r["g"]: r["median"] for r in M.box_summary(df, "v", ["g"]).collect()} == {None: 2.0, 1: 5.0}
    h = spark.createDataFrame([(1, None), (1, 5), (2, None), (2, None), (3, 4), (3, 4), (4, 4), (4, 5)], "k int, section_id int")
    assert {r["k"]: r["is_homo"] for r in M.homogeneity(h, ["k"]).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_null_sections_are_numbered(spark):
    from datetime import datetime, timedelta
    from seqlab.operators.sections import number_within
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None if i % 2 else 7, t + timedelta(minutes=i), i) for i in range(10)],
                               "u int, section_id int, created_at timestamp_ntz, id int")
    got = {(r["id"]): (r["pos"], r["q_len"]) for r in number_within(df, ["u", "section_id"]).collect()}
    assert got == {i: (i // 2 + 1, 5) for i in range(10)}
