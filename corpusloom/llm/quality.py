"""Quality classifier: gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import boosting
from corpusloom.llm._text import blocks, buffers, mix, words_of
from corpusloom.plans.runtime import materialize

FEATURES = (
    "log_words", "mean_word", "long_words", "upper", "digits", "punctuation", "non_ascii", "bars", "marked_words", "shouting_words", "lone_marks",
    "distinct", "repeated_neighbours", "longest_repeat", "commonest", "distinct_pairs", "words_per_line", "distinct_lines", "stops", "short_words", "capitalised",
)
#: Labelled rows used for fitting at most, those of the smallest hashes.
SAMPLE_ROWS = 20_000

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 punctuation, 5 other ASCII, 6 above ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[128:] = 6


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return c[first[1:]] - c[first[:-1]]


def _distinct(names: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct names, count of the commonest) per document; names count by 40 of their bits within one document."""
    if not len(names):
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (names >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    top[owner[begin]] = np.maximum.reduceat(np.diff(np.append(first, len(key))), begin)
    return np.bincount(owner, minlength=n).astype(float), top


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block; empty texts give zeros."""
    n = len(offsets) - 1
    words = words_of(data, offsets)
    doc, names = words.doc, words.hashes()
    size = (words.end - words.start).astype(float)
    many = np.diff(words.first).astype(float)
    per, nb = np.maximum(many, 1), np.maximum(np.diff(offsets), 1)
    kind = _KIND[data]
    of = {k: _sums(kind == k, offsets) for k in (2, 3, 4, 6)}
    marks = np.concatenate([[0], np.cumsum(kind == 4)])
    uppers = np.concatenate([[0], np.cumsum(kind == 2)])
    lowers = np.concatenate([[0], np.cumsum(kind == 1)])
    in_word = lambda c: c[words.end] - c[words.start]
    punct, upper, lower = in_word(marks), in_word(uppers), in_word(lowers)
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    head = kind[words.start] if len(words.start) else np.zeros(0, np.uint8)
    same = np.zeros(len(names), bool)
    same[1:] = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
    run = np.arange(len(names)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(names)))) if len(names) else np.zeros(0)
    longest = np.zeros(n)
    if len(doc):
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        longest[doc[begin]] = np.maximum.reduceat(run + 1, begin)
    pairs = np.zeros(0, np.uint64) if len(names) < 2 else mix(names[:-1] * np.uint64(3) ^ names[1:])
    inner = doc[:-1] == doc[1:] if len(names) > 1 else np.zeros(0, bool)
    distinct, top = _distinct(names, doc, n)
    pair_kinds, _ = _distinct(pairs[inner], doc[:-1][inner], n)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1.0
    # a line's name is the sum of its words' names by place; repeated lines share one
    line = breaks[words.start] + doc if len(doc) else np.zeros(0, np.int64)
    fresh = np.ones(len(line), bool)
    fresh[1:] = line[1:] != line[:-1]
    begin = np.flatnonzero(fresh)
    place = np.arange(len(line)) - np.repeat(begin, np.diff(np.append(begin, len(line)))) if len(line) else np.zeros(0, np.int64)
    line_names = np.add.reduceat(mix(names + mix(place.astype(np.uint64))), begin) if len(begin) else np.zeros(0, np.uint64)
    line_doc = doc[begin] if len(begin) else np.zeros(0, np.int64)
    line_kinds, _ = _distinct(line_names, line_doc, n)
    filled = np.bincount(line_doc, minlength=n) if len(line_doc) else np.zeros(n)
    share = lambda hits: _sums(hits, words.first) / per
    columns = [
        np.log1p(many), _sums(size, words.first) / per, share(size > 20), of[2] / nb, of[3] / nb, of[4] / nb, of[6] / nb, _sums(data == 124, offsets) / nb, share((punct >= 2) & (size > punct)), share((upper >= 2) & (lower == 0)), share(punct == size),
        distinct / per, share(same), longest / per, top / per, pair_kinds / np.maximum(many - 1, 1), many / lines, line_kinds / np.maximum(filled, 1), share(last == 46), share(size <= 2), share(head == 2),
    ]
    return np.where((many > 0)[:, None], np.stack(columns, axis=1), 0.0)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<float>) of every whole text, one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = document_statistics(*buffers(batch.column(1))).astype(np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, features array<float>")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor)).cast("int")


def fit_quality(features: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, trainable: Column | None = None) -> boosting.Trees:
    """Fit on at most ``sample_rows`` labelled rows (a documented bound): those with the smallest hashes of doc_id.

    Null labels and null ids take no part; a repeated label row counts once, and of
    contradicting labels the larger holds. Of rows that repeat an id the smallest statistics are learnt,
    so the fit is the same however rows are dealt. Without labels every score is 0.5.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    marked = marked if trainable is None else marked.where(trainable)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("features").alias("features")).toArrow().sort_by("doc_id")
    x = np.array(rows["features"].combine_chunks().flatten(), dtype=float).reshape(-1, len(FEATURES))
    return boosting.fit(x, np.array(rows["label"], dtype=float))


def filter_quality(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, threshold: float = 0.3) -> DataFrame:
    """The documents scored ``threshold`` or higher, as they are; the texts are read where they lie and not shuffled.

    Rows are judged each by their own text, so repeated rows, null ids and equal texts share a
    fate; null and empty texts have all-zero statistics. Without labels every row stays. All columns stay, an empty table stays empty.
    """
    trainable = remainder(F.col("doc_id"), held_out_of) != 0
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(trainable).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    model = fit_quality(statistics(docs.join(F.broadcast(named), "doc_id", "left_semi")), labels, trainable=trainable)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(model.predict(document_statistics(*buffers(batch.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_quality(features: DataFrame, model: boosting.Trees) -> DataFrame:
    """(doc_id, score 0 to 1) for each row of ``statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(x))], ["doc_id", "score"])

    return features.select("doc_id", "features").mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from labelled documents whose ``remainder(doc_id, held_out_of)`` is not 0. The
    score sees the text alone, so equal texts score equally. Null and empty texts have all-zero statistics and
    are scored like others, texts of any length are read whole; repeated rows and rows with null doc_id are
    scored each. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    features = materialize(statistics(docs), "quality-statistics")
    model = fit_quality(features, labels, trainable=remainder(F.col("doc_id"), held_out_of) != 0)
    scored = score_quality(features, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), held_out_of) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
