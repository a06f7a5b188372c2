import pytest

from corpusloom.plans import catalogue
from oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, FOLDER), catalogue.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from corpusloom.operators import retrieval as R
    from corpusloom.operators.blocks import Filter
    from corpusloom.plans.runtime import read

    vectors = read(spark, FOLDER, "embeddings")
    queries = vectors.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plan = R.knn(queries, vectors, 3, [Filter("label", "gt", 3)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(label,3)" in plan and "WindowGroupLimit" in plan
    plan = catalogue.QUERIES["doc_language_partition_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string,source:string,n_chars:bigint>" in plan or "text" not in plan.split("ReadSchema")[1][:120]
