"""Dialogues as tables: the turn graph over pluggable model hooks, logs, simulated users."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.operators.blocks import near_dedup_ordered
from corpusloom.operators.ordering import with_global_index
from corpusloom.plans.runtime import materialize


@dataclass
class Config:
    """Depths before and after reranking, for queries and claims; whether the draft is refined."""

    query_pre: int = 20
    query_post: int = 3
    claim_pre: int = 10
    claim_post: int = 2
    refine: bool = False

    def __post_init__(self) -> None:
        if self.query_pre < self.query_post or self.claim_pre < self.claim_post:
            raise ValueError("depth before reranking must not be smaller than after")


@dataclass
class Hooks:
    """Column-valued models: each maps columns to a column, in SQL or as a pandas UDF.

    queries(history) and claims(history) -> array<string>; summary(utterance, content) -> text with one line
    for each finding or 'None'; draft(history, passages) and refine(draft) -> text.
    """

    queries: Callable[[Column], Column]
    claims: Callable[[Column], Column]
    summary: Callable[[Column, Column], Column]
    draft: Callable[[Column, Column], Column]
    refine: Callable[[Column], Column] = lambda x: x


def run_turns(turns: DataFrame, search: Callable[[DataFrame, int], DataFrame], hooks: Hooks, config: Config | None = None) -> DataFrame:
    """One turn for many dialogues at once.

    ``turns``: dialogue_id, history, utterance. ``search`` maps (query_id, query) and a
    depth to (query_id, rank, title, url, content). Both branches, queries and claims, are one
    plan; their results are de-duplicated in order, summarised, cited and renumbered.
    Returns dialogue_id, search_query, llm_claims, agent_utterance, references.
    """
    config = config or Config()
    asked = turns.withColumn("search_query", hooks.queries(F.col("history"))).withColumn("llm_claims", hooks.claims(F.col("history")))

    def branch(column: str, number: int, depth: int) -> DataFrame:
        each = asked.select("dialogue_id", F.posexplode(column).alias("i", "query")).withColumn("query_id", F.concat_ws("/", F.lit(column), "dialogue_id", "i"))
        found = search(each.select("query_id", "query"), depth)
        return found.join(each.select("query_id", "dialogue_id", "i"), "query_id").select("dialogue_id", F.lit(number).alias("branch"), "i", "rank", "title", "url", "content")

    both = branch("search_query", 0, config.query_post).unionByName(branch("llm_claims", 1, config.claim_post))
    order = Window.partitionBy("dialogue_id").orderBy("branch", "i", "rank")
    both = both.withColumn("place", F.row_number().over(order)).withColumn("tokens", T.words("content"))
    kept = near_dedup_ordered(both, ["dialogue_id"], "place", "tokens").join(turns.select("dialogue_id", "utterance"), "dialogue_id")
    kept = kept.withColumn("summary", T.lines_to_list(hooks.summary(F.col("utterance"), F.col("content")))).where("size(summary) > 0")
    reference = F.struct("place", "title", "url", "content", "summary")
    gathered = kept.groupBy("dialogue_id").agg(F.array_sort(F.collect_list(reference)).alias("references"))
    kind = gathered.schema["references"].dataType
    out = asked.join(gathered, "dialogue_id", "left").withColumn("references", F.coalesce("references", F.array().cast(kind)))
    passages = T.result_string(F.transform("references", lambda r: F.struct(r["title"].alias("title"), F.array_join(r["summary"], "\n").alias("content"))), limit=10)
    draft = hooks.draft(F.col("history"), passages)
    out = out.withColumn("__said", hooks.refine(draft) if config.refine else draft)
    text, references = T.shift_references("__said", "references")
    return out.select("dialogue_id", "search_query", "llm_claims", text.alias("agent_utterance"), references.alias("references"))


def log_rows(dialogues: DataFrame, experiment: str, system: str, turns: str = "turns") -> DataFrame:
    """One row for each turn of array<struct<user_utterance, agent_utterance, ...>>, the turn itself as JSON."""
    each = dialogues.select("dialogue_id", F.posexplode(turns).alias("turn_id", "t"))
    return each.select(
        F.concat_ws("-", F.lit(experiment), "dialogue_id", "turn_id").alias("_id"), F.lit(experiment).alias("experiment_id"), F.col("dialogue_id").alias("dialog_id"), "turn_id", F.lit(system).alias("system_name"),
        F.col("t.user_utterance").alias("user_utterance"), F.col("t.agent_utterance").alias("agent_utterance"), F.to_json("t").alias("agent_log_object"),
    )


def first_sentence(passage: Column | str) -> Column:
    """Up to the first full stop, question or exclamation mark that ends a word."""
    c = F.col(passage) if isinstance(passage, str) else passage
    return F.regexp_extract(c, r"(?s)^\s*(.*?(?:[.!?](?=\s|$)|$))", 1)


# What a simulated user is told about, by mode, and how many dialogues are simulated together.
MODES = {"topic": ("topic",), "passage": ("title", "passage"), "multihop": ("title_1", "paragraph_1", "title_2", "paragraph_2")}
BATCH = 10


def simulation_inputs(rows: DataFrame, mode: str) -> DataFrame:
    """(dialogue_id, topic, prompt) of a mode's inputs; a passage is cut to its first sentence, two paragraphs are one topic."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(MODES)}")
    missing = [c for c in MODES[mode] if c not in rows.columns]
    if missing:
        raise ValueError(f"mode {mode!r} needs columns {missing}")
    said = F.concat_ws
    topic, prompt = {
        "topic": lambda: (F.col("topic"), F.col("topic")),
        "passage": lambda: (F.col("title"), said("\n", "title", first_sentence("passage"))),
        "multihop": lambda: (said(" and ", "title_1", "title_2"), said("\n", "title_1", "paragraph_1", "title_2", "paragraph_2")),
    }[mode]()
    return rows.select("dialogue_id", topic.alias("topic"), prompt.alias("prompt"))


def simulate(topics: DataFrame, user: Callable[[Column, Column], Column], agent: Callable[[DataFrame], DataFrame], turns: int) -> DataFrame:
    """Whole dialogues about ``topics`` (dialogue_id, topic, and prompt if the user is told more): dialogue_id, turn_id, user_utterance, agent_utterance.

    ``user`` maps history and prompt to an utterance; ``agent`` maps (dialogue_id, history, utterance) to
    (dialogue_id, agent_utterance). All dialogues take each turn together; one whose user says nothing ends.
    """
    state = topics.select("dialogue_id", F.col("prompt" if "prompt" in topics.columns else "topic").alias("prompt"), F.lit("").alias("history"))
    done = None
    for turn in range(turns):
        said = T.remove_prefix(user(F.col("history"), F.col("prompt")))
        state = state.withColumn("utterance", said).where(F.coalesce("utterance", F.lit("")) != "")
        answered = agent(state.select("dialogue_id", "history", "utterance")).select("dialogue_id", "agent_utterance")
        state = materialize(state.join(answered, "dialogue_id"), "simulated-turn")
        rows = state.select("dialogue_id", F.lit(turn).alias("turn_id"), F.col("utterance").alias("user_utterance"), "agent_utterance")
        done = rows if done is None else done.unionByName(rows)
        line = F.concat(F.lit("User: "), "utterance", F.lit("\nChatbot: "), "agent_utterance", F.lit("\n"))
        state = state.select("dialogue_id", "prompt", F.concat("history", line).alias("history"))
    return done


def simulate_batches(topics: DataFrame, user: Callable[[Column, Column], Column], agent: Callable[[DataFrame], DataFrame], turns: int, batch: int = BATCH) -> DataFrame:
    """As ``simulate``, with at most ``batch`` dialogues in the agent's hands at a time, for agents that call paced services."""
    numbered = materialize(with_global_index(topics, [F.col("dialogue_id")], "__n"), "simulated-topics")
    parts = [simulate(numbered.where(F.col("__n").between(at, at + batch - 1)).drop("__n"), user, agent, turns) for at in range(0, numbered.count(), batch)]
    return reduce(DataFrame.unionByName, parts) if parts else simulate(numbered.drop("__n"), user, agent, turns)


def dialogue_text(turns: DataFrame, topics: DataFrame) -> DataFrame:
    """(dialogue_id, text): one dialogue as text under its topic, ended by a rule; what an export of dialogues writes. Dialogues without turns are left out."""
    line = F.concat(F.lit("User: "), F.coalesce("user_utterance", F.lit("")), F.lit("\nChatbot: "), F.coalesce("agent_utterance", F.lit("")), F.lit("\n\n"))
    said = turns.groupBy("dialogue_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", line.alias("line")))), lambda x: x["line"]), "").alias("said"))
    return topics.join(said, "dialogue_id").select("dialogue_id", F.concat(F.lit("Topic: "), T.strip("topic"), F.lit("\n"), "said", F.lit("=====\n")).alias("text"))


def export_topics(topics: DataFrame, path: str) -> None:
    """Topics as JSON Lines, an object each."""
    topics.write.mode("overwrite").json(path)


def export_dialogues(turns: DataFrame, topics: DataFrame, path: str) -> None:
    """Dialogues as text files, see ``dialogue_text``."""
    dialogue_text(turns, topics).select("text").write.mode("overwrite").text(path)
