"""Ordered operators: boundaries, islands, histories, heads and tails, histograms, look-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.ordering import running_total, with_global_index


def section_boundaries(headers: DataFrame, key: str, order: str, start: str, end: str, length: str) -> DataFrame:
    """Adds body_start and body_end: from a header's end to the next one's start, the last to the document's length."""
    w = Window.partitionBy(key).orderBy(order)
    return headers.withColumn("body_start", F.col(end)).withColumn("body_end", F.coalesce(F.lead(start).over(w), F.col(length)))


def assign_interval(points: DataFrame, intervals: DataFrame, key: str, start: str, end: str, low: str, high: str, place: str) -> DataFrame:
    """For each point row the first interval of its key (by ``place``) that contains [start, end]; null if none does.

    Intervals of a key are gathered into one ordered array, so every point is kept once and no pairs are made.
    """
    item = F.struct(place, F.col(low).alias("__low"), F.col(high).alias("__high"))
    lists = intervals.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__all"))
    inside = F.filter("__all", lambda x: (F.col(start) >= x["__low"]) & (F.col(end) <= x["__high"]))
    return points.join(lists, key, "left").withColumn(place, F.get(inside, F.lit(0))[place]).drop("__all")


def assign_disjoint(points: DataFrame, intervals: DataFrame, key: str, start: str, end: str, low: str, high: str, place: str) -> DataFrame:
    """As ``assign_interval`` where a key's intervals do not overlap, as sections do not: one sort by key and position, nothing gathered.

    The interval that begins last before a point's start is the only one that can hold it.
    """
    names = points.columns
    kept = F.struct(*names).alias("__row")
    a = points.select(F.col(key).alias("__key"), F.col(start).alias("__at"), F.lit(1).alias("__side"), kept, F.lit(None).cast(f"struct<high:{intervals.schema[high].dataType.simpleString()},place:{intervals.schema[place].dataType.simpleString()}>").alias("__of"))
    b = intervals.select(F.col(key).alias("__key"), F.col(low).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(F.col(high).alias("high"), F.col(place).alias("place")).alias("__of"))
    last = F.last("__of", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = a.unionByName(b).withColumn("__of", last).where("__side = 1").select("__row.*", "__of")
    return found.withColumn(place, F.when(F.col(end) <= F.col("__of.high"), F.col("__of.place"))).drop("__of")


def merge_islands(rows: DataFrame, keys: list[str], order: str, start: str, end: str, content: str, separator: str = "\n\n") -> DataFrame:
    """Join runs of rows whose start is the previous row's end: keys, start, end, content, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(start) == F.lag(end).over(w), 0).otherwise(1)
    numbered = rows.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda x: x["c"]), separator)
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), joined.alias(content), F.count("*").alias("n")).drop("__island")


def concat_by_section(rows: DataFrame, keys: list[str], order: str, content: str, separator: str = "\n\n") -> DataFrame:
    """Texts of equal keys joined in order; first_order tells where a key was first seen."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))), lambda x: x["c"]), separator)
    return rows.groupBy(*keys).agg(joined.alias(content), F.min(order).alias("first_order"))


def dialogue_history(turns: DataFrame, dialogue: str, turn: str, speaker: str, utterance: str, previous: int) -> DataFrame:
    """Adds history: the last ``previous`` rows' lines 'speaker: text' without citations, and the row's own line."""
    line = F.concat(F.col(speaker), F.lit(": "), F.regexp_replace(F.coalesce(utterance, F.lit("")), r" ?\[\d+\]", ""))
    w = Window.partitionBy(dialogue).orderBy(turn).rowsBetween(-previous, 0)
    return turns.withColumn("__line", line).withColumn("history", F.array_join(F.collect_list("__line").over(w), "\n")).drop("__line")


def head_and_tail(rows: DataFrame, n: int, score: str, tie: str) -> DataFrame:
    """The ``n`` best and ``n`` worst by score, both in descending order: adds part ('head' or 'tail') and place.

    Both ends are top-k plans; needs 2n rows or fewer come twice.
    """
    head = rows.orderBy(F.desc(score), tie).limit(n).withColumn("part", F.lit("head"))
    tail = rows.orderBy(score, F.desc(tie)).limit(n).withColumn("part", F.lit("tail"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc(score), tie))
    return head.unionByName(tail).withColumn("place", place)


def percentiles(rows: DataFrame, value: str, points: list[float] | None = None) -> DataFrame:
    """(percent, value), exact, with linear interpolation; every fifth percent if no points are given. Nulls are left out.

    Values are counted first, then a distributed running total tells which value stands at a place, so neither all
    rows nor all values meet in one task. Without values there are no rows.
    """
    points = points if points is not None else [float(p) for p in range(0, 101, 5)]
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    totals = running_total(counted, [F.col("v")], "n")
    size = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not size:
        return rows.sparkSession.createDataFrame([], "percent double, value double")
    at = {p: p / 100 * (size - 1) for p in points}
    wanted = F.array(*[F.lit(i) for i in sorted({int(f(x)) for x in at.values() for f in (math.floor, math.ceil)})])
    here = F.filter(wanted, lambda i: (i >= F.col("before")) & (i < F.col("upto")))
    found = {r["i"]: r["v"] for r in totals.select(F.explode(here).alias("i"), "v").collect()}  # two for each point
    ends = {p: (found[math.floor(x)], found[math.ceil(x)], x - math.floor(x)) for p, x in at.items()}
    return rows.sparkSession.createDataFrame([(float(p), low + share * (high - low)) for p, (low, high, share) in ends.items()], "percent double, value double")


def bucket_counts(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bucket, low, high, n) of values in [edge i, edge i+1), the last bucket with its upper edge; values outside are left out."""
    last = len(edges) - 2
    passed = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value))) - 1
    inside = rows.where(F.col(value).between(float(edges[0]), float(edges[-1]))).groupBy(F.least(passed, F.lit(last)).alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(last + 1)], "bucket int, low double, high double")
    return every.join(inside, "bucket", "left").select("bucket", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def log_histogram(rows: DataFrame, value: str, bins: int = 5000, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n, share) over ``bins`` logarithmic bins of [low, high], by default the values' own range; each value weighs 100 / sum of all.

    Values outside go to the end bins; those that are not positive count as ``low``.
    """
    positive = rows.where(F.col(value).isNotNull())
    if low is None or high is None:
        least, most = positive.where(F.col(value) > 0).agg(F.min(value), F.max(value)).first()
        low, high = float(low if low is not None else least or 1), float(high if high is not None else most or 1)
    width = (math.log(high) - math.log(low)) / bins or 1.0
    at = F.floor((F.log(F.greatest(F.col(value).cast("double"), F.lit(low))) - math.log(low)) / width)
    binned = positive.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    everything = binned.agg(F.sum("total").alias("all"))
    return binned.join(F.broadcast(everything)).select("bin", "n", (100.0 * F.col("n") / F.col("all")).alias("share"))  # one row


def first_file_wins(rows: DataFrame, title: str, path: str) -> DataFrame:
    """All rows of a title's first file, by name; rows of that title in later files go."""
    first = rows.groupBy(title).agg(F.min(path).alias(path))
    return rows.join(first, [title, path], "left_semi")


def uncached(titles: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Titles that the cache does not have; one that was looked up without success counts as cached."""
    return titles.join(cached.select(key), key, "left_anti")


def keep_roots(articles: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Articles whose name is a root; all of them where nothing is known about redirects."""
    return articles if roots.isEmpty() else articles.join(roots.select(name), name, "left_semi")


def translate_two_paths(entities: DataFrame, translations: DataFrame, redirects: DataFrame, entity: str = "entity") -> DataFrame:
    """Adds translation: the entity's own, else that of its redirect root; an empty one counts as found.

    ``translations`` (key, value), ``redirects`` (node, root); sides are broadcast or shuffled by Spark's own size rules.
    """
    own = translations.select(F.col("key").alias("__k1"), F.col("value").alias("__v1"))
    roots = redirects.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    via = translations.select(F.col("key").alias("__k2"), F.col("value").alias("__v2"))
    out = entities.join(own, F.col(entity) == F.col("__k1"), "left").join(roots, F.col(entity) == F.col("__n"), "left").join(via, F.col("__r") == F.col("__k2"), "left")
    return out.withColumn("translation", F.coalesce("__v1", "__v2")).drop("__k1", "__v1", "__n", "__r", "__k2", "__v2")


def short_translation(english: str | None, context: str, frequent: frozenset[str] = frozenset()) -> str:
    """The part of a name before its parenthesis; empty for frequent words, names without letters and those the context holds."""
    short = (english or "").split("(")[0].strip()
    if not any(c.isalpha() for c in short) or (english or "").lower() in frequent or short.lower() in context.lower():
        return ""
    return short


def frequent_words(spark: SparkSession, path: str, n: int) -> frozenset[str]:
    """The first ``n`` lines of a word list, in lower case: a list kept by hand, small by its parameter."""
    return frozenset(r["value"].strip().lower() for r in spark.read.text(path).limit(n).collect() if r["value"].strip())


def translated_name(entity: Column | str, translation: Column | str, context: Column | str, frequent: frozenset[str] | list[str] | None = None) -> Column:
    """'X (in English: Y)'; X alone for frequent words, names without letters, and those the context holds."""
    e, t, c = (F.col(x) if isinstance(x, str) else x for x in (entity, translation, context))
    short = F.regexp_replace(F.regexp_replace(t, r"(?s)\(.*$", ""), r"^\s+|\s+$", "")
    common = F.lower(t).isin(sorted(frequent)) if frequent else F.lit(False)
    use = t.isNotNull() & ~common & short.rlike(r"\p{L}") & ~F.contains(F.lower(c), F.lower(short))
    return F.when(F.coalesce(use, F.lit(False)), F.concat(e, F.lit(" (in English: "), short, F.lit(")"))).otherwise(e)


def repeat_round_robin(topics: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows: the topics in order, again and again; adds slot (from 0). -1 takes each topic once; topics are numbered without a single-task sort."""
    numbered = with_global_index(topics, [F.col(order)], "__i")
    count = numbered.count()
    if not count:
        return topics.withColumn("slot", F.lit(0).cast("long"))
    slots = topics.sparkSession.range(count if n < 0 else n).withColumnRenamed("id", "slot")
    return slots.withColumn("__i", F.col("slot") % count).join(numbered, "__i").drop("__i")
