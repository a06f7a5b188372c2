"""Reranking of result lists by pluggable scorers, and metrics of rankings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.functions import values as V

# Window and step of listwise reranking.
WINDOW_SIZE, WINDOW_STEP = 20, 10


def lexical_score(query: Column | str, content: Column | str) -> Column:
    """Share of the query's distinct lower-case words, in any script, found in the text: the deterministic stand-in for a model's score."""
    q = F.array_distinct(T.words(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.words(content))) / F.size(q)).otherwise(F.lit(0.0))


def rerank_pointwise(results: DataFrame, score: Column, group: str = "query_id", rank: str = "rank") -> DataFrame:
    """New ranks by descending score; ties keep their order. Adds rerank_score."""
    order = Window.partitionBy(group).orderBy(F.desc("rerank_score"), F.col("__old"))
    scored = results.withColumnRenamed(rank, "__old").withColumn("rerank_score", score)
    return scored.withColumn(rank, F.row_number().over(order)).drop("__old")


def slide_windows(items: list, choose: Callable[[list], list[int]], size: int = WINDOW_SIZE, step: int = WINDOW_STEP) -> list:
    """Reorder overlapping windows from the tail to the head; ``choose`` gives 0-based places, those it leaves out are dropped."""
    end = len(items)
    start = end - size
    while end > 0:
        start = max(start, 0)
        picked = [i for i in dict.fromkeys(choose(items[start:end])) if 0 <= i < end - start]
        items = items[:start] + [items[start + i] for i in picked] + items[end:]
        if start == 0:
            break
        end, start = end - step, start - step
    return items


def rerank_listwise(results: DataFrame, choose: Callable[[pd.DataFrame], list[int]], group: str = "query_id", rank: str = "rank", size: int = WINDOW_SIZE, step: int = WINDOW_STEP) -> DataFrame:
    """New ranks by sliding windows; ``choose`` gets a window's rows. One query's list is one group, at most a few hundred rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(rank, kind="stable").reset_index(drop=True)
        order = slide_windows(list(rows.index), lambda window: choose(rows.loc[window]), size, step)
        out = rows.loc[order].copy()
        out[rank] = range(1, len(out) + 1)
        return out

    return results.groupBy(group).applyInPandas(run, results.schema)


def parse_ranking(text: Column | str) -> Column:
    """0-based places from {"ranked_passage_ids": [...]} (1-based, repeats and non-positive dropped); a list is found in damaged JSON too."""
    text = F.col(text) if isinstance(text, str) else text
    listed = F.regexp_extract(text, r"ranked_passage_ids\"?\s*:\s*\[([^\]]*)", 1)
    numbers = F.transform(F.regexp_extract_all(listed, F.lit(r"-?\d{1,9}"), 0), lambda s: s.cast("int") - 1)
    return F.array_distinct(F.filter(numbers, lambda i: i >= 0))


def rerank_batches(results: DataFrame, score: Callable[[pd.DataFrame], pd.Series], group: str = "query_id", rank: str = "rank") -> DataFrame:
    """As ``rerank_pointwise`` with a model that scores a frame of rows (query, content and all other columns) at a time.

    Rows stay where they are while they are scored, in Arrow batches of several queries; only scores decide about the one exchange by query.
    """
    columns = results.columns

    def run(batches):
        for rows in batches:
            yield rows.assign(__score=score(rows).to_numpy(dtype=float))[[*columns, "__score"]]

    scored = results.mapInPandas(run, StructType([*results.schema.fields, StructField("__score", DoubleType())]))
    return rerank_pointwise(scored, F.col("__score"), group, rank).drop("__score")


def compare_rerankers(found: DataFrame, relevant: DataFrame, rerankers: dict[str, Callable[[DataFrame], DataFrame]], ks: tuple[int, ...] = (10,), id_column: str = "vec_id") -> DataFrame:
    """(reranker, k, queries, ndcg, average_precision, recall, precision): means over queries before ('none') and after each reranker."""
    out = None
    for name, rerank in {"none": lambda x: x, **rerankers}.items():
        ranked = rerank(found)
        for k in ks:
            metrics = ranking_metrics(ranked, relevant, k, id_column)
            means = metrics.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in metrics.columns[1:]])
            one = means.select(F.lit(name).alias("reranker"), F.lit(k).alias("k"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def list_scores(ranked: Column | str) -> Column:
    """1 - i/n for the i-th of a ranked array."""
    c = F.col(ranked) if isinstance(ranked, str) else ranked
    return F.transform(c, lambda x, i: V.list_score(i, F.size(c)))


def ranking_metrics(results: DataFrame, relevant: DataFrame, k: int, id_column: str = "vec_id") -> DataFrame:
    """query_id, ndcg, average_precision, recall, precision at k with binary relevance.

    ``results`` (query_id, id, rank) and ``relevant`` (query_id, id); queries without
    relevant rows are left out, those without results score 0. Ideal gains come from counts alone.
    """
    wanted = relevant.select("query_id", id_column).distinct()
    hits = results.where(F.col("rank") <= k).select("query_id", id_column, "rank").join(wanted, ["query_id", id_column])
    hits = hits.withColumn("seen", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = hits.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("seen") / F.col("rank")).alias("precisions"), F.count("*").alias("hits"))
    total = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    best = F.least("relevant", F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), best.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(got, "query_id", "left").select(
        "query_id", zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("precisions") / best).alias("average_precision"),
        zero(F.col("hits") / F.col("relevant")).alias("recall"), zero(F.col("hits") / F.lit(k)).alias("precision"),
    )


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit by bit: a word of ``a`` updates all of ``b`` in a few operations on one long number."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    whole = (1 << len(b)) - 1
    free = whole
    for x in a:
        used = free & at.get(x, 0)
        free = (free + used | free - used) & whole
    return len(b) - free.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of lower-case words; no stemming. 0 if either has no words."""
    import re

    def one(r: str | None, c: str | None) -> float:
        x, y = (re.findall(r"[a-z0-9]+", (s or "").lower()) for s in (r, c))
        n = longest_common(x, y)
        return 2 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([one(r, c) for r, c in zip(reference, candidate)], dtype=float)
