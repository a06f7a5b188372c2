import corpus_pipeline
from corpusloom.llm import shingles, substrings
from pyspark.sql import functions as F


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf_dir).write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert frames[-1].columns == columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = frames[1].join(labels, "doc_id")
    assert kept.where("quality = 0").count() < 0.1 * docs.join(labels, "doc_id").where("quality = 0").count()
    assert kept.where("quality = 1").count() > 0.97 * docs.join(labels, "doc_id").where("quality = 1").count()
    groups = shingles.near_components(frames[1]).groupBy("component").agg(F.min("doc_id").alias("doc_id"))
    assert {r.doc_id for r in frames[2].collect()} == {r.doc_id for r in groups.collect()}
    cut = substrings.remove_repeats(frames[2])
    assert {(r.doc_id, r.text) for r in frames[3].collect()} == {(r.doc_id, r.text) for r in cut.collect()}
    assert cut.where("n_removed > 0").count() > 0
    assert frames[3].where("n_chars <> length(text)").count() == 0
    assert frames[4].join(frames[3].select("doc_id"), "doc_id", "left_anti").count() == 0
    packed = frames[5].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.where("n > 4096").count() == 0
    assert frames[5].where("piece = 0").count() == frames[4].count()


def test_odd_rows(spark, tmp_path):
    rows = [(1, "A good text with words. " * 9, "en", "s", 5), (2, None, None, None, None), (None, "A good text with words. " * 9, "en", None, 5), (1, "A good text with words. " * 9, "en", "s", 5), (3, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, given in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert (corpus_pipeline.run(spark, folder).count() > 0) == bool(given)


def test_columns_of_any_name_pass_through(spark, tmp_path):
    text = "A good text with words. " * 9
    rows = [(1, text, "en", "s", 5, 7, 8, 9, "k", 1), (2, text + "more of it all", "en", "s", 5, 17, 18, 19, "l", 2), (3, None, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, n_removed int, copies int, name string, threshold int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} <= {r[5:] for r in rows}, name
    assert stage is corpus_pipeline.mix and corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == 3
