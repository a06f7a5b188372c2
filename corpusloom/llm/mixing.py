"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. A source that must give up part of itself
keeps the documents whose hash is at most a threshold; the threshold comes
from a histogram of tokens by source and hash bucket, of which only the
bucket on the boundary is refined, so nothing is sorted and raising a target
only ever adds documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.ordering import with_global_index
from corpusloom.plans.runtime import broadcast_if_small, materialize

#: Buckets by which one pass narrows a threshold, as bits of the hash; 63 bits are used in all.
BUCKET_BITS = 12
HASH_BITS = 63


def word_count(text: Column) -> Column:
    """Maximal runs of bytes that are not ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): weighted shares of ``share`` of all sizes; what lies above ``cap`` times a source is shared anew."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = with_global_index(sources, [F.col("source").asc_nulls_last()], "place")
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.select("source", "source_size", F.element_at(wheel, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * float(cap)).alias("most"))
    sources = materialize(sources, "mix-sources")
    budget = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    rate, before = 0.0, -1
    while True:  # the rate only rises and each round caps another source, else it ends
        capped = F.col("weight") * rate > F.col("most")
        n, full, free = sources.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == before or not free:
            break
        before, rate = n, (budget - full) / free
    return sources.select("source", "source_size", F.least(F.col("most"), F.col("weight") * rate).alias("target"))


def mix_hash(docs: DataFrame) -> Column:
    """63 bits that decide about a row; equal for rows equal in doc_id, source and text."""
    return F.shiftrightunsigned(F.xxhash64(docs["doc_id"], docs["source"], docs["text"]), 1)


def plan_mix(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The plan of each source, from (source, mix_hash, size): every document ``whole`` times, once more up to ``threshold``.

    Of rows that share the hash ``edge`` (equal rows on the boundary) ``edge_take`` are taken once more; null where there are none.
    """
    targets = _targets(sizes, weights, share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(ratio).cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")
    thresholds = _thresholds(sizes, plan.where("rest > 0").select("source", "rest"))
    found = plan.select(F.col("source").alias("__s"), "source_size", "target", "whole").join(thresholds, F.col("source").eqNullSafe(F.col("__s")), "left")
    return materialize(found.select(F.col("__s").alias("source"), "source_size", "target", "whole", "threshold", "edge", "edge_take"), "mix-thresholds")


def _sizes(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", mix_hash(docs).alias("mix_hash"), word_count(docs["text"]).alias("size")), "mix-sizes")


def _with_copies(rows: DataFrame, source: str, plan: DataFrame) -> DataFrame:
    """``rows`` (with mix_hash) and their source's plan, with copies int."""
    plan = plan.withColumnRenamed("source", "__s")
    planned = rows.join(broadcast_if_small(plan), F.col(source).eqNullSafe(F.col("__s")))
    copies = lambda more: (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int")
    if plan.where("edge IS NOT NULL").isEmpty():
        return planned.withColumn("copies", copies(F.col("mix_hash") <= F.col("threshold")))
    on_edge = F.coalesce(F.col("mix_hash") == F.col("edge"), F.lit(False))
    inner = planned.where(~on_edge).withColumn("copies", copies(F.col("mix_hash") <= F.col("threshold")))
    # equal rows are numbered where they lie, after those of the parts before: no task gets them all
    edge = materialize(planned.where(on_edge).withColumn("__at", F.spark_partition_id()), "mix-edge")
    before = Window.partitionBy("__hash").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = edge.groupBy(F.col("mix_hash").alias("__hash"), F.col("__at").alias("__part")).count().withColumn("__shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("mix_hash", "__at").orderBy("mix_hash"))
    numbered = edge.withColumn("__place", place).join(materialize(shifts.drop("count"), "mix-shifts"), (F.col("mix_hash") == F.col("__hash")) & (F.col("__at") == F.col("__part")))
    return inner.unionByName(numbered.withColumn("copies", copies(F.col("__place") + F.col("__shift") <= F.col("edge_take"))).select(*inner.columns))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Decide how often each document is taken.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share ``share`` of all words; no source exceeds ``cap`` times its own
    words. A source at r times its words takes every document floor(r) times
    and, once more, those under its threshold, chosen so that the source's sum
    comes as near to its target as one document allows.

    Input: doc_id, source, text; other columns are ignored, so their names
    cannot clash. Output: doc_id, source, size long, source_size long, target
    double, copies int. Null text has size 0; null doc_id hashes like any
    value; an empty table gives an empty result. Texts of any length are counted whole. Rows
    equal in doc_id, source and text are interchangeable: where the boundary runs through them, as many as needed are taken.
    """
    sizes = _sizes(docs)
    return _with_copies(sizes, "source", plan_mix(sizes, weights, share, cap)).select("doc_id", "source", "size", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them: left out, once, or repeated; same columns as ``docs``. Texts are not shuffled."""
    plan = plan_mix(_sizes(docs), **options).select("source", "whole", "threshold", "edge", "edge_take")
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), mix_hash(docs).alias("mix_hash"), docs["source"].alias("__source"))
    taken = _with_copies(keyed, "__source", plan).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), "copies")).alias("__i")).select("__row.*")


def _thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, threshold, edge, edge_take): documents with hash <= threshold, and ``edge_take`` of those with hash ``edge``, sum nearest to ``rest``.

    ``open`` holds, per source, the bucket still to be refined: its first hash,
    and the words below it.
    """
    open_ = wanted.select(F.col("source").alias("__s"), "rest", F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("below"))
    left, done = HASH_BITS, None
    while left > 0:
        step = min(BUCKET_BITS, left)
        held = F.shiftright("mix_hash", left) == F.shiftright("low", left) if left < HASH_BITS else F.lit(True)
        inside = sizes.where("size > 0").join(broadcast_if_small(open_), F.col("source").eqNullSafe(F.col("__s")) & held)
        left -= step
        cell = inside.groupBy("__s", "rest", "below", F.shiftright("mix_hash", left).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("mix_hash").alias("first"), F.max("mix_hash").alias("last"))
        order = Window.partitionBy("__s").orderBy("cell")
        cell = cell.withColumn("upto", F.col("below") + F.sum("words").over(order)).withColumn("under", F.col("upto") - F.col("words"))
        boundary = cell.where("under < rest").groupBy("__s").agg(F.max_by(F.struct("rest", "cell", "words", "rows", "first", "last", "upto", "under"), "cell").alias("b")).select("__s", "b.*")
        boundary = materialize(boundary, "mix-boundary")
        single = (F.col("first") == F.col("last")) | (F.col("upto") <= F.col("rest"))
        take = F.least(F.floor((F.col("rest") - F.col("under")) * F.col("rows") / F.col("words") + 0.5), F.col("rows"))  # rows of one hash are equal
        settled = boundary.where(single).withColumn("take", F.when(F.col("upto") <= F.col("rest"), F.col("rows")).otherwise(take)).select(
            F.col("__s").alias("source"), F.when(F.col("take") == F.col("rows"), F.col("last")).otherwise(F.col("first") - 1).alias("threshold"),
            *[F.when((F.col("take") > 0) & (F.col("take") < F.col("rows")), F.col(c)).alias(name) for c, name in (("first", "edge"), ("take", "edge_take"))],
        )
        done = settled if done is None else done.unionByName(settled)
        open_ = boundary.where(~single).select("__s", "rest", F.shiftleft("cell", left).alias("low"), F.col("under").alias("below"))
        if open_.isEmpty():
            break
    return done
