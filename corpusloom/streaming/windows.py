"""Structured Streaming over event files: windows with watermarks, incremental upserts, dialogue state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land in a folder; the trigger's size is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 hour", ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums in windows side by side; works on streams and on tables."""
    return sliding(events, width, None, keys, late, ts, value)


def sliding(events: DataFrame, width: str, slide: str | None, keys: list[str], late: str = "1 hour", ts: str = "ts", value: str = "value") -> DataFrame:
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    out = seen.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str = "1 hour", ts: str = "ts", value: str = "value") -> DataFrame:
    """Windows that end ``gap`` after their last event."""
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    out = seen.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n", "total")


def changed_only(articles: DataFrame, key: str, edited: str, late: str = "30 days") -> DataFrame:
    """Each (key, edit time) once, however often its files come again."""
    return articles.withWatermark(edited, late).dropDuplicatesWithinWatermark([key, edited])


def upsert_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], upsert: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch through ``transform`` into an idempotent ``upsert``; ends when the source is drained."""
    return stream.writeStream.foreachBatch(lambda df, _: upsert(transform(df))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_dialogues(turns: DataFrame) -> DataFrame:
    """Per dialogue_id the turns so far and the last utterance, kept as state across micro-batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last_turn, last = state.get if state.exists else (0, -1, "")
        for pdf in batches:
            n += len(pdf)
            newest = pdf.sort_values("turn").iloc[-1]
            if int(newest["turn"]) >= last_turn:
                last_turn, last = int(newest["turn"]), str(newest["utterance"])
        state.update((n, last_turn, last))
        yield pd.DataFrame([(key[0], n, last)], columns=["dialogue_id", "turns", "last_utterance"])

    return turns.groupBy("dialogue_id").applyInPandasWithState(update, "dialogue_id long, turns long, last_utterance string", "turns long, last_turn long, last string", "update", GroupStateTimeout.NoTimeout)
