"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Single words count with their beginnings too, so that inflected forms that no
label has shown share weight with those it has. A document is the set of its hashed features; every whole text is read. The
per-coordinate rates and the L1 penalty leave few non-zero weights, which are
all that scoring broadcasts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._text import Words, blocks, buffers, mix, words_of
from corpusloom.llm.quality import remainder

#: log2 of the number of coordinates; bounds the weights at 2**20 numbers.
HASH_BITS = 20
#: Labelled rows used for fitting at most, those of the smallest hashes.
SAMPLE_ROWS = 12_000
#: Rows that the learner holds at a time.
FIT_BATCH = 500

#: Bytes of the beginnings of words that are features of their own.
STEM_BYTES = (4, 5, 6, 7)

_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _bare(words: Words) -> Words:
    """The words without ASCII punctuation at their ends; words of punctuation alone stay as they are."""
    if not len(words.start):
        return words
    at = np.arange(len(words.data))
    solid = ~_MARKS[words.data]
    after = np.minimum.accumulate(np.where(solid, at, len(at))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, at, -1))
    start, end = after[words.start], before[words.end - 1] + 1
    some = start < words.end
    return Words(words.data, np.where(some, start, words.start), np.where(some, end, words.end), words.first)


def document_features(data: np.ndarray, offsets: np.ndarray, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every word, its beginnings, pair of neighbours, and pair that skips one word; with repeats."""
    words = _bare(words_of(data, offsets, lower=True))
    doc, name = words.doc, words.hashes()
    down = np.uint64(64 - bits)
    docs, coordinates = [doc], [name >> down]
    for k in STEM_BYTES:
        long = np.flatnonzero(words.end - words.start > k)
        docs.append(doc[long])
        coordinates.append(Words(words.data, words.start[long], words.start[long] + k, words.first).hashes(seed=k) >> down)
    for kind, gap in ((1, 1), (2, 2)):
        if len(name) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            coordinates.append(mix(name[:-gap][same] * np.uint64(2 * kind + 1) + name[gap:][same]) >> down)
    return np.concatenate(docs), np.concatenate(coordinates).astype(np.int64)


@dataclass
class Sparse:
    """Non-zero weights, by coordinate."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = HASH_BITS

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, where = document_features(data, offsets, self.bits)
        table = np.full(1 << self.bits, -1, np.int32)
        table[self.at] = np.arange(len(self.at))
        which = table[where]
        hit = which >= 0
        key = np.unique(doc[hit] * max(1, len(self.at)) + which[hit])  # a feature counts once
        total = np.bincount(key // max(1, len(self.at)), self.weight[key % max(1, len(self.at))] if len(key) else None, n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


class Learner:
    """FTRL-proximal: z and n per coordinate; weights exist only where |z| exceeds the L1 penalty."""

    def __init__(self, bits: int = HASH_BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the bias, without penalty
        self.bits = bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, bias = self.z[at], at == len(self.z) - 1
        l1 = np.where(bias, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + np.where(bias, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, features: np.ndarray, label: float) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def model(self) -> Sparse:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return Sparse(at, w[at], float(w[-1]), self.bits)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", trainable: Column | None = None, sample_rows: int = SAMPLE_ROWS, passes: int = 4) -> Sparse:
    """Fit on at most ``sample_rows`` labelled rows (a documented bound): those with the smallest hashes of doc_id.

    Null labels and ids take no part; of contradicting labels the larger holds. Of rows that
    repeat an id the text of the smallest hash is learnt, once, so that the driver's learner
    gets the features of ``sample_rows`` documents at most, in the order of their ids' hashes. Without labelled documents all weights are zero.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    marked = marked if trainable is None else marked.where(trainable)
    chosen = marked.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            doc, where = document_features(*buffers(batch.column(2)))
            key = np.unique((doc << HASH_BITS) | where)
            offsets = np.searchsorted(key, np.arange(batch.num_rows + 1) << HASH_BITS).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array((key & ((1 << HASH_BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["at", "label", "features"])

    named = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    picked = named.groupBy("doc_id", "at", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("at", "label", "one.text")
    table = picked.mapInArrow(run, "at long, label double, features array<int>").toArrow().sort_by([("at", "ascending"), ("label", "ascending")])
    learner = Learner()
    labels_of, lists = np.array(table["label"]), table["features"].combine_chunks()
    offsets, flat = np.array(lists.offsets), np.array(lists.values)
    for _ in range(passes):
        for i in range(table.num_rows):
            learner.learn(flat[offsets[i] : offsets[i + 1]], labels_of[i])
    return learner.model()


def score_toxicity(docs: DataFrame, model: Sparse) -> DataFrame:
    """(doc_id, score) of every whole text; null text is empty and scores by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**HASH_BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.predict(*buffers(batch.column(1))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 4, held_out_at: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns only from labelled documents whose ``remainder`` is not ``held_out_at``; without
    labels every score is 0.5. Null and empty texts score by the bias alone, texts of any length are read
    whole, equal texts score equally. Repeated rows and rows with null doc_id are scored each; extra
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    held = lambda: remainder(F.col("doc_id"), held_out_of) == held_out_at
    scored = score_toxicity(docs, fit_toxicity(docs, labels, trainable=~held()))
    return scored.select("doc_id", held().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
