"""Sources and sinks: CSV with a byte-order mark, JSON lines, parquet round trip, distinct view."""
import tempfile

from seqlab.sources import tables as T


def test_csv_bom_header_and_recode(spark):
    from seqlab.operators.sequences import control_from_wide, recode_arms
    d = tempfile.mkdtemp(prefix="seqlab-csv-")
    path = f"{d}/seq.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("section_id,sequence," + ",".join(f"Q{i}" for i in range(1, 13)) + "\n")
        f.write("7,treatment2," + ",".join(str(i) for i in range(1, 13)) + "\n")
    df = T.read_csv_table(spark, path)
    assert df.columns[0] == "section_id"
    df = recode_arms(df)
    long = control_from_wide(df, 12).collect()
    assert len(long) == 12 and {r["experiment_mode"] for r in long} == {2}
    assert [r["cq"] for r in sorted(long, key=lambda r: r["pos"])] == list(range(1, 13))


def test_json_lines_parquet_and_views(spark):
    d = tempfile.mkdtemp(prefix="seqlab-io-")
    src = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    src.write.mode("overwrite").json(f"{d}/j")
    assert T.read_json_lines(spark, f"{d}/j", "k long, v string").count() == 3
    T.write_table(src, f"{d}/p")
    dv = T.read_distinct_view(spark, f"{d}/p", "dedup_view")
    assert dv.count() == 2
    names = [r["tableName"] for r in T.list_tables(spark).collect()]
    assert "dedup_view" in names


def test_samples(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    a = T.hash_sample(df, ["k"]).count()
    assert a == T.hash_sample(df, ["k"]).count() and 800 < a < 1200
    assert 800 < T.sample_rows(df, 1 / 3, 42).count() < 1200


def test_csv_schema_is_enforced_and_bad_rows_are_kept(spark):
    import pytest
    path = tempfile.mkdtemp(prefix="seqlab-csv-") + "/rows.csv"
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("course_id,course_name\n1,one\nx,two\n3,\"three, quoted\"\n")
    with pytest.raises(ValueError, match="header"):
        T.read_csv_table(spark, path, "course_id long, name string")
    rows = T.read_csv_table(spark, path, "course_id long, course_name string", corrupt="bad").collect()
    assert [tuple(r) for r in rows] == [(1, "one", None), (None, "two", "x,two"), (3, "three, quoted", None)]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        T.read_csv_table(spark, path, "course_id long, course_name string").collect()


def test_json_lines_that_are_none(spark):
    import pytest
    path = tempfile.mkdtemp(prefix="seqlab-json-") + "/rows.json"
    with open(path, "w") as f:
        f.write('{"k": 1, "v": [1, null]}\n{"k": 2, "v": "text"}\nnot json\n')
    rows = T.read_json_lines(spark, path, "k long, v array<int>", corrupt="bad").collect()
    assert [(r.k, r.v, r.bad) for r in rows] == [(1, [1, None], None), (2, None, '{"k": 2, "v": "text"}'), (None, None, "not json")]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        T.read_json_lines(spark, path, "k long, v array<int>").collect()


def test_exact_sample_size(spark):
    from seqlab.sources.sampling import sample_exact
    df = spark.range(1000).withColumnRenamed("id", "k").repartition(5)
    one = sorted(r.k for r in sample_exact(df, ["k"]).collect())
    assert len(one) == 333 == len(set(one)) and one == sorted(r.k for r in sample_exact(df.repartition(3), ["k"]).collect())
    assert one != sorted(r.k for r in sample_exact(df, ["k"], seed=7).collect())
    same = df.selectExpr("if(k < 700, null, k) as k", "k as v")  # most rows share a key
    got = sample_exact(same, ["k"], 0.5).collect()
    assert len(got) == 500 == len({r.v for r in got})
    assert sample_exact(df, ["k"], 0.0).count() == 0 and sample_exact(df, ["k"], 1.0).count() == 1000
    assert sample_exact(df.limit(0), ["k"]).count() == 0
