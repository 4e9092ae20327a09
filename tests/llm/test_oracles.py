"""Every registered query of the subpackage against its SQL, at the smallest size."""
import pytest

from seqlab.llm.queries import ORACLE, QUERIES
from seqlab.plans.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    r = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert r["rows"] > 0 and r["cols_ok"] and r["values_ok"], r


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
