import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dialogue as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import registry as G


def test_outputs(spark):
    rows = [('Yes. You Search "cats".', "No", 'The result is "SUPPORTS".', "a 90/100\nb N/A\nc 70/100\nd x\nUser: q\nResponse after applying this feedback: Better text "), ("No need", "Yes", 'the fact-checking result is "not enough info"', "odd"), ("hm", "", "", "")]
    df = spark.createDataFrame(rows, "a string, g string, v string, r string")
    got = df.select(E.search_decision(F.col("a")).alias("d"), E.verification_label(F.col("v")).alias("l"), E.refinement(F.col("r")).alias("r")).collect()
    assert [(x.d.decision, x.d.query) for x in got] == [("Yes", "cats"), ("No", ""), ("", "")]
    assert [x.l for x in got] == ["SUPPORTS", "NOT ENOUGH INFO", "REFUTES"]
    assert (got[0].r.scores, got[0].r.text) == ([90, 100, 70, 100], "Better text") and got[1].r.scores == []


def test_means(spark):
    out = spark.createDataFrame([("p", 'Yes. You "a b".', 'Yes. You "a c".'), ("p", "No", 'Yes. You "x".')], "prompt string, prediction string, gold string")
    prompts = spark.createDataFrame([("p",), ("q",)], "prompt string")
    m = {r.prompt: r for r in E.means_by_prompt(out, prompts, {k: E.METRICS[k] for k in ("decision", "query_rouge_l", "label", "refined_scores")}).collect()}
    assert m["p"].decision == 50 and m["p"].query_rouge_l == pytest.approx(0.25) and m["p"].label == 100 and m["q"].n == 0 and m["q"].decision is None


def test_registry(spark):
    r = G.Registry(lambda c: c.corpus_id)
    r.add(G.Corpus("News", "news"))
    assert r.get("news").name == "News" and r.table(spark).first().corpus_id == "news"
    with pytest.raises(KeyError):
        r.get("none")
    assert G.EmbeddingModel("m", 256, query_template="query: {query}").query_text("x") == "query: x"
    assert G.free_name("a.jsonl", {"a.jsonl", "a_v2.jsonl"}) == "a_v3.jsonl" and G.free_name("a.jsonl", set()) == "a.jsonl"


def test_simulated_dialogues(spark):
    topics = spark.createDataFrame([(1, "cats"), (2, "")], "dialogue_id long, topic string")
    user = lambda h, t: F.when(t != "", F.concat(F.lit("User: about "), t, F.lit(" "), F.length(h).cast("string")))
    agent = lambda d: d.withColumn("agent_utterance", F.concat(F.lit("re: "), "utterance"))
    rows = sorted(map(tuple, D.simulate(topics, user, agent, 2).collect()))
    assert rows == [(1, 0, "about cats 0", "re: about cats 0"), (1, 1, "about cats 45", "re: about cats 45")]
    assert D.first_sentence is not None
    s = spark.createDataFrame([("One sentence. Two.",), ("no stop",)], "s string").select(D.first_sentence("s")).collect()
    assert [x[0] for x in s] == ["One sentence.", "no stop"]
