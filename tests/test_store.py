import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blocks as B
from corpusloom.operators import dialogue as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import registry as RG
from corpusloom.operators import rerank as RR
from corpusloom.operators import retrieval as R
from corpusloom.operators import sequences as S


def rows_of(spark, ids, label="a"):
    return spark.createDataFrame([(i, f"{label}{i}", float(i)) for i in ids], "id long, name string, x double")


def test_versions_of_a_collection(spark, tmp_path):
    c = R.Collection(spark, f"file://{tmp_path}", "c", indexed=("x",))
    assert not c.exists() and R.list_collections(spark, f"file://{tmp_path}") == []
    c.add(rows_of(spark, [1, 2, 2, 3]))
    c.add(rows_of(spark, [3, 4], "b"))
    assert {r.id: r.name for r in c.read().collect()} == {1: "a1", 2: "a2", 3: "a3", 4: "b4"}
    c.upsert(rows_of(spark, [4, 5], "z"))
    assert {r.id: r.name for r in c.read().collect()} == {1: "a1", 2: "a2", 3: "a3", 4: "z4", 5: "z5"}
    assert c.versions() == [1, 2, 3] and c.read(1).count() == 3
    (tmp_path / "c" / "rows" / "half").mkdir()  # a writer that died before its version was listed
    assert c.read().count() == 5
    c.snapshot("s")
    c.upsert(rows_of(spark, range(1, 6), "bad"))
    c.load("s")
    c.clean()
    assert c.versions() == [5] and {r.name for r in c.read().collect()} == {"a1", "a2", "a3", "z4", "z5"}
    assert len(list((tmp_path / "c" / "rows").iterdir())) == 1
    assert c.payload_types() == {"name": "keyword", "x": "float"}
    assert R.list_collections(spark, f"file://{tmp_path}") == ["c"]
    c.drop()
    assert not c.exists()


def corpus(spark):
    words = ["paris city river", "berlin city wall", "photo synthesis leaf", "telephone inventor bell", "river fish water"]
    meta = [(i, w.title(), "", w, "en" if i % 2 else "de", dt.datetime(2024, 1, 1 + i), ["x", str(i)]) for i, w in enumerate(words)]
    blocks = spark.createDataFrame(meta, "id long, document_title string, section_title string, content string, language string, last_edit_date timestamp, tags array<string>")
    return RG.embed_documents(blocks, RG.HashedWords(32))[0]


def embed(queries):
    return RG.embed_queries(queries, RG.HashedWords(32), RG.EmbeddingModel("h", 32, query_template="{query}"))


def test_search_with_payload_filters_and_rerank(spark):
    stored = corpus(spark)
    found = R.search(R.SearchRequest(["river water fish", "city wall"], 2), stored, embed).collect()
    best = {r.query_id: r.id for r in found if r["rank"] == 1}
    assert best == {0: 4, 1: 1} and all(r.content and r.language for r in found) and len(found) == 4
    only = R.search(R.SearchRequest("city", 5, [B.Filter("language", "eq", "de"), B.Filter("last_edit_date", "gt", dt.datetime(2024, 1, 1))]), stored, embed).collect()
    assert {r.id for r in only} == {2, 4}
    lexical = lambda x: RR.rerank_pointwise(x, RR.lexical_score("query", "content"))
    ranked = R.search(R.SearchRequest("telephone", 1, rerank=True, num_blocks_to_rerank=5), stored, embed, lexical).collect()
    assert [r.id for r in ranked] == [3]
    assert R.warm_up(stored, embed) > 0


def test_web_search_falls_back_to_unranked(spark):
    stored = corpus(spark)
    names = spark.createDataFrame([("de", "German")], "language string, display_name string")

    def refuses(_):
        raise RuntimeError("filtered")

    found = R.web_search("river", stored, embed, refuses, names).collect()
    assert len(found) == 5 and {r.language for r in found} == {"German", "en"}
    turned = R.web_search("river", stored, embed, lambda x: RR.rerank_pointwise(x, -F.col("similarity"))).orderBy("rank").collect()
    assert [r.similarity for r in turned] == sorted(r.similarity for r in found)


def test_calls_of_ten_queries(spark):
    asked = []

    def call(some):
        asked.append(len(some))
        return spark.createDataFrame([(i, q) for i, q in enumerate(some) if q != "none"], "query_id long, answer string")

    queries = [f"q{i}" if i != 13 else "none" for i in range(23)]
    found = R.search_calls(queries, call)
    assert asked == [10, 10, 3] and {r.query_id: r.answer for r in found.collect()} == {i: q for i, q in enumerate(queries) if i != 13}
    assert [r.query_id for r in R.unanswered(spark.range(23).withColumnRenamed("id", "query_id"), found).collect()] == [13]
    with pytest.raises(ValueError):
        R.search_calls(queries, lambda some: spark.createDataFrame([(11,)], "query_id long"))


def test_cells_find_what_exact_search_finds(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(40, 16)) * 0.2 for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, i % 3, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    cells = R.Cells.fit(vectors, "embedding", 12)
    store = R.Collection(spark, f"file://{tmp_path}", "v", "vec_id", "cell")
    store.add(cells.assign(vectors, "embedding"))
    plan = R.knn_cells(queries, store.read(), cells, 5, 16, probes=2)
    exact = {(r.query_id, r.vec_id) for r in R.knn(queries, vectors, 5).collect()}
    found = {(r.query_id, r.vec_id) for r in R.knn_cells(queries, store.read(), cells, 5, 16, probes=3, oversampling=8.0).collect()}
    assert len(exact & found) / len(exact) > 0.9
    assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString().lower() or "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()
    few = R.knn_cells(queries, store.read(), cells, 5, 16, probes=3, filters=[B.Filter("label", "eq", 1)]).join(vectors, "vec_id")
    assert few.where("label <> 1").count() == 0


def test_embedder_batches_and_rejects(spark):
    calls = []

    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        calls.append(len(texts))
        return RG.HashedWords(8)(texts)

    rows = [(i, "t", "", "bad" if i == 7 else f"word{i}") for i in range(20)] + [(20, "t", "s", None)]
    blocks = spark.createDataFrame(rows, "id long, document_title string, section_title string, content string").coalesce(1)
    good, bad = RG.embed_documents(blocks, model, batch=6)
    assert {r.id for r in good.collect()} == set(range(21)) - {7}
    assert [(r.id, r.fault) for r in bad.collect()] == [(7, "ValueError: no")]
    assert all(abs(sum(a * a for a in r.vector) - 1) < 1e-9 for r in good.collect())
    cut = RG.embed_documents(blocks.where("id = 1"), RG.HashedWords(8), dimensions=4)[0].first().vector
    assert len(cut) == 4
    with pytest.raises(ValueError):
        RG.embed_queries(blocks, model, RG.EmbeddingModel("m", 8), 4)
    assert RG.HashedWords(4)(["", "ß ß"])[0].tolist() == [0.0] * 4


def test_upload(spark):
    gate = lambda name, size=10, taken=(): B.upload_gate(name, size, set(taken))
    assert gate("my file?.jsonl") == B.Upload("my_file-.jsonl", None)
    assert gate("a.jsonl", taken=["a.jsonl", "a_v2.jsonl"]).name == "a_v3.jsonl"
    assert gate("a.exe").refused and gate("a.jsonl", 1 << 40).refused


def test_peek_text_only_and_first(spark, tmp_path):
    rows_of(spark, range(9)).write.parquet(f"{tmp_path}/p")
    assert B.peek(spark, f"file://{tmp_path}/p", 4).count() == 4
    kinds = spark.createDataFrame([(1, "text"), (2, "table"), (3, None)], "id int, block_type string")
    assert [r.id for r in B.text_only(kinds).orderBy("id").collect()] == [1, 3]
    ties = spark.createDataFrame([("k", 1, "b", {"x": 1}), ("k", 1, "a", {"x": 2}), ("k", 2, "c", None)], "k string, o int, v string, m map<string,int>")
    for n in (1, 5):
        assert [(r.v, r.m) for r in B.first_per_key(ties.repartition(n), ["k"], ["o"]).collect()] == [("a", {"x": 2})]


def test_old_blocks_keep_unknown_columns(spark):
    old = spark.createDataFrame([(7, "T", "Top > Deep > X", "text", "1:5:24", "Ann", 3, '{"week": 2}')], "id long, article_title string, full_section_title string, content_string string, last_edit_date string, speaker string, page int, block_metadata string")
    row = B.migrate_old_blocks(old).first()
    assert (row.document_title, row.section_title, row.content, row.last_edit_date) == ("T", "Deep > X", "text", "2024-01-05")
    assert row.block_metadata == '{"week": 2,"speaker":"Ann","page":3}' and "speaker" not in row.asDict() and "id" not in row.asDict()
    bare = B.migrate_old_blocks(old.select("article_title", "content_string"))
    assert bare.columns == ["document_title", "content"]


def test_claims_and_options(spark):
    claims = spark.createDataFrame([(1, "SUPPORTS"), (1, "SUPPORTS"), (2, "SUPPORTS"), (2, "REFUTES"), (3, None)], "g int, label string")
    assert {r.g: r.verified for r in E.all_supported(claims, "g").collect()} == {1: True, 2: False, 3: False}


def test_softmax_of_large_scores(spark):
    from corpusloom.functions import values as V

    got = spark.createDataFrame([(1, 800.0), (1, 799.0)], "g int, s double").select(V.softmax(F.col("s"), ["g"]).alias("p")).collect()
    assert sorted(round(r.p, 6) for r in got) == [0.268941, 0.731059]


def test_rouge_and_lexical_scores(spark):
    import random

    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert RR.longest_common(a, b) == plain(a, b)
    d = spark.createDataFrame([("Größe München", "die größe von münchen"), ("نمونه متن", "متن دیگر"), ("", "x")], "q string, c string")
    assert [r[0] for r in d.select(RR.lexical_score("q", "c")).collect()] == [1.0, 0.5, 0.0]


def test_reranking_in_batches(spark):
    d = spark.createDataFrame([(q, i, f"c{i}", i + 1) for q in (1, 2) for i in range(5)], "query_id long, doc_id long, content string, rank int")
    got = RR.rerank_batches(d, lambda rows: rows["doc_id"] % 3).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got[:5]] == [2, 1, 4, 0, 3] and got[0].rerank_score == 2.0


def test_simulation_modes_and_batches(spark):
    passages = spark.createDataFrame([(i, f"Title {i}", "First one. Second one.") for i in range(12)], "dialogue_id long, title string, passage string")
    inputs = D.simulation_inputs(passages, "passage")
    assert inputs.first().prompt.endswith("\nFirst one.") and inputs.first().topic.startswith("Title")
    hops = spark.createDataFrame([(1, "A", "pa", "B", "pb")], "dialogue_id long, title_1 string, paragraph_1 string, title_2 string, paragraph_2 string")
    assert D.simulation_inputs(hops, "multihop").first().topic == "A and B"
    for mode, rows in (("nothing", passages), ("topic", passages)):
        with pytest.raises(ValueError):
            D.simulation_inputs(rows, mode)
    sizes = []

    def agent(rows):
        sizes.append(rows.count())
        return rows.select("dialogue_id", F.upper("utterance").alias("agent_utterance"))

    user = lambda history, prompt: F.when((history != "") & prompt.startswith("Title 3"), "").otherwise(F.concat(F.lit("User: ask "), F.substring_index(prompt, "\n", 1)))
    out = D.simulate_batches(inputs, user, agent, 2, 5)
    assert out.count() == 23 and max(sizes) == 5
    text = {r.dialogue_id: r.text for r in D.dialogue_text(out, inputs).collect()}
    assert text[3] == "Topic: Title 3\nUser: ask Title 3\nChatbot: ASK TITLE 3\n\n=====\n" and text[1].count("User: ") == 2


def test_exports(spark, tmp_path):
    topics = spark.createDataFrame([(1, "a"), (2, "b")], "dialogue_id long, topic string")
    turns = spark.createDataFrame([(1, 0, "hi", "ho")], "dialogue_id long, turn_id int, user_utterance string, agent_utterance string")
    D.export_topics(topics, f"file://{tmp_path}/t")
    D.export_dialogues(turns, topics, f"file://{tmp_path}/d")
    assert spark.read.json(f"file://{tmp_path}/t").count() == 2
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/d").collect()] == ["Topic: a", "User: hi", "Chatbot: ho", "", "=====", ""]


def test_words_and_lists(spark, tmp_path):
    (tmp_path / "words").write_text("The\nof\n\nAnd\nrare\n")
    assert S.frequent_words(spark, f"file://{tmp_path}/words", 4) == {"the", "of", "and"}
    assert S.short_translation("Berlin (city)", "x") == "Berlin" and S.short_translation("The", "x", frozenset({"the"})) == ""
    assert S.short_translation("1984", "x") == "" and S.short_translation("Rome", "of ROME") == "" and S.short_translation(None, "x") == ""
    topics = spark.createDataFrame([("a",), ("b",), ("c",)], "t string")
    assert [r.t for r in S.repeat_round_robin(topics, 7, "t").orderBy("slot").collect()] == list("abcabca")
    assert S.repeat_round_robin(topics, -1, "t").count() == 3 and S.repeat_round_robin(topics.limit(0), 5, "t").count() == 0


def test_percentiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.lognormal(3, 2, 700)).tolist()
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double").repartition(5)
    got = {r.percent: r.value for r in S.percentiles(df, "x").collect()}
    assert all(abs(got[float(p)] - np.percentile(x, p)) < 1e-9 for p in range(0, 101, 5))
    edges = [float(np.percentile(x, p)) for p in range(0, 101, 5)]
    assert [r.n for r in S.bucket_counts(df, "x", edges).orderBy("bucket").collect()] == np.histogram(x, edges)[0].tolist()
    assert S.percentiles(df.limit(0), "x").count() == 0


def test_packing_is_greedy_and_streams(spark):
    import random

    from corpusloom.functions.text import TOKEN

    import regex

    rng = random.Random(4)
    rows = [(d, i, rng.choice(["a", "b"]) if rng.random() < 0.3 else "a", " ".join(["w"] * rng.randint(0, 12)) or "x") for d in range(6) for i in range(rng.randint(1, 200))]
    blocks = spark.createDataFrame([(d, f"doc {d}", i, s, c) for d, i, s, c in rows], "doc long, document_title string, at int, section_title string, content string").repartition(4)
    want, count = [], lambda s: len(regex.findall(TOKEN, s))
    last = None
    for d, i, s, c in sorted(rows):
        if last and last[0] == d and last[1] == s and last[3] + count(c) < 30:
            last[2] += " " + c
            last[3] += count(c)
        else:
            last = [d, s, c, count(f"doc {d} > {s} {c}")]
            want.append(last)
    got = B.pack_blocks(blocks, 30, ["doc"], "at").orderBy("doc", "pack").collect()
    assert [[r.doc, r.section_title, r.content, r.num_tokens] for r in got] == want
