"""Labels and scores read out of model outputs, compared with gold outputs by prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.rerank import rouge_l

# Phrases of the outputs.
SUPPORT_PHRASES = ('is "supports"', "no fact-checking is needed for this claim", "the fact-checking result is not applicable to this response")
UNKNOWN_PHRASE = 'the fact-checking result is "not enough info"'
REVISED_MARKS = ("Revised response after applying this feedback:", "Response after applying this feedback:")


def search_decision(output: Column) -> Column:
    """struct<decision, query>: 'Yes' with the quoted query, 'No', or empty where malformed."""
    found = F.regexp_extract(strip(output), r'^Yes\. You.*"([^"]*)"', 1)
    yes = strip(output).rlike(r'^Yes\. You.*"[^"]*"')
    decision = F.when(yes, "Yes").when(output.startswith("No"), "No").otherwise("")
    return F.struct(decision.alias("decision"), F.when(yes, found).otherwise("").alias("query"))


def verification_label(output: Column) -> Column:
    low = F.lower(output)
    supports = F.lit(False)
    for phrase in SUPPORT_PHRASES:
        supports = supports | low.contains(phrase)
    return F.when(supports, "SUPPORTS").when(low.contains(UNKNOWN_PHRASE), "NOT ENOUGH INFO").otherwise("REFUTES")


def all_supported(claims: DataFrame, group: str, label: str = "label") -> DataFrame:
    """(group, verified): whether every claim of a group is labelled as supported; a null label is not."""
    return claims.groupBy(group).agg(F.bool_and(F.coalesce(F.col(label) == "SUPPORTS", F.lit(False))).alias("verified"))


def refinement(output: Column) -> Column:
    """struct<scores array<int>, text>: four or five criteria lines' scores (100 where not applicable), and the revised text."""
    mark = "|".join(REVISED_MARKS)
    parts = F.split(output, mark, 2)
    lines = F.split(strip(F.element_at(F.split(F.get(parts, F.lit(0)), "User:"), 1)), "\n")
    last = lambda s: F.element_at(F.split(strip(s), " "), -1)
    score = lambda s: F.when((last(s) == "N/A") | s.contains("this criterion is not applicable"), 100).otherwise(F.coalesce(F.element_at(F.split(last(s), "/"), 1).try_cast("int"), F.lit(100)))
    scores = F.when(F.size(lines).between(4, 5), F.transform(lines, score)).otherwise(F.array().cast("array<int>"))
    return F.struct(scores.alias("scores"), strip(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text"))


def score_agreement(predicted: Column, gold: Column) -> Column:
    """Percent of equal scores, by place; null without predicted scores."""
    same = F.aggregate(F.zip_with(predicted, gold, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(predicted) > 0, 100.0 * same / F.size(predicted))


def means_by_prompt(outputs: DataFrame, prompts: DataFrame, metrics: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Mean of each metric(prediction, gold) by prompt, and n; prompts without outputs come with n = 0."""
    scored = outputs.select("prompt", *[f(F.col("prediction"), F.col("gold")).alias(k) for k, f in metrics.items()])
    means = scored.groupBy("prompt").agg(*[F.avg(k).alias(k) for k in metrics], F.count("*").alias("n"))
    return prompts.select("prompt").distinct().join(means, "prompt", "left").withColumn("n", F.coalesce("n", F.lit(0)))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "decision": lambda p, g: F.when(search_decision(p)["decision"] == search_decision(g)["decision"], 100.0).otherwise(0.0),
    "query_rouge_l": lambda p, g: rouge_l(search_decision(g)["query"], search_decision(p)["query"]),
    "label": lambda p, g: F.when(verification_label(p) == verification_label(g), 100.0).otherwise(0.0),
    "refined_rouge_l": lambda p, g: rouge_l(refinement(g)["text"], refinement(p)["text"]),
    "refined_scores": lambda p, g: score_agreement(refinement(p)["scores"], refinement(g)["scores"]),
}
