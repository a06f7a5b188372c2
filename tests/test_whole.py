import re

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.plans import catalogue
from corpusloom.sources import html as H


def test_every_query_is_answered(spark):
    rows = [(i, [float(i % 17), float(i % 5), float(-(i % 11))]) for i in range(250)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    expected = {i: [j for _, j in sorted((-sum(x * y for x, y in zip(v, w)), j) for j, w in rows)[:3]] for i, v in rows}
    for found in (R.knn(queries, vectors, 3), R.knn_quantized(queries, vectors, 3, 3, oversampling=100.0)):
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == expected


def test_lists_and_tables_at_any_depth_of_an_item_are_kept():
    page = "<ul><li>one<div><ul><li>two<span><ol><li>three</li></ol></span></li></ul></div></li><li>four<div><table><tr><td>a1</td><td>a2</td></tr><tr><td>b1</td><td>b2</td></tr></table></div></li><li>five<table><tr><td>alone</td></tr></table></li></ul><dl><dd><table><tr><td>c1</td><td>c2</td></tr></table></dd></dl>"
    blocks = H.blocks_of(page)
    words = re.findall(r"\w+", " ".join(content for _, content, _ in blocks))
    assert all(words.count(w) == 1 for w in ("one", "two", "three", "four", "a1", "a2", "b1", "b2", "five", "alone", "c1", "c2"))
    assert [kind for _, _, kind in blocks].count("table") == 2


def test_every_item_is_reranked_over_its_whole_list(spark, tmp_path):
    spark.createDataFrame([(i, "q") for i in range(90)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, "x" * (i % 7)) for i in range(40 * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["rerank_listwise_window"](spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {i: 14 if i < 30 else 13 for i in range(90)}


def test_order_keys_do_not_meet_customers_at_any_size(spark, tmp_path):
    rows = [(5, 1), (10_000_010, 1), (10_000_005, 2), (10_000_000, 3)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalogue.QUERIES["bipartite_components"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 5), (2, 1, 10_000_005), (3, 1, 10_000_000)]
