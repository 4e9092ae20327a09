"""Driver contract: entry runs, every query has a builder, SQL oracles agree.

Every registered query is compared with its oracle at sf0.001
(``SEQLAB_ORACLE_SF`` names another folder).
"""
import os

import pytest

import __spark_entry__ as E
from seqlab.plans.check import compare, duck
from seqlab.plans.registry import ORACLE, QUERIES, load_all

load_all()

def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "n_questions" in df.columns and "time_elapsed" in df.columns


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(q) and len(QUERIES) >= 110
    assert set(QUERIES) - set(ORACLE) == {"correct_fe_logit", "sample_sessions"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    sf = os.environ.get("SEQLAB_ORACLE_SF", "/root/testdata/sf0.001")
    r = compare(spark, duck(sf), name, QUERIES[name], ORACLE.get(name), sf)
    if r.get("oracle", 1) is None:
        assert r["rows"] > 0, r
    else:
        assert r["cols_ok"] and r["values_ok"], r
