import pytest

from corpusloom.llm import queries
from oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, FOLDER), queries.oracle_sql()[name], FOLDER)
