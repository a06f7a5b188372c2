"""Substring dedup by recompression.

Every window of ``window`` words takes one interior symbol of the recompressed
text as its anchor, by a rule that reads the window alone; equal windows thus
have equal anchors. Neighbouring windows with one anchor form a segment, and
segments of different documents meet on the anchor's name. Segments of a name that cover the same
words are one kind, and all but the first document's repeat whole; where a name has several
kinds, the first segment of each has its windows compared one by one. Rows and
exchanges hold names and fingerprints, a few for each window length of text;
texts move only for documents that share something.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm import recompression
from corpusloom.llm._text import Words, blocks, buffers, mix, words_of
from corpusloom.plans.runtime import free, materialize

WINDOW = 50
#: Document ids that are broadcast to pick documents; with more, texts are joined by shuffle.
BROADCAST_IDS = 500_000

_BASES = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))
_SEGMENT = "name long, kind long, check long, doc_id long, body long, at int, windows int"


class Rolling:
    """Fingerprints of word ranges, two independent 64-bit polynomials of the words' names."""

    def __init__(self, names: np.ndarray):
        n = len(names)
        self.sums, self.back = [], []
        for k, base in enumerate(_BASES):
            inverse = np.uint64(pow(int(base), -1, 2**64))
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))
            self.back.append(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)])))
            values = mix(names + np.uint64(k + 1))
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:n], dtype=np.uint64)]))

    def of(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        return mix((self.sums[k][end] - self.sums[k][start]) * self.back[k][start] + (end - start).astype(np.uint64))


def _window_starts(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, document) of every window of a block."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc], doc


def block_segments(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(document, name, kind, check, first window, windows) of each segment of a block; ``kind`` and ``check`` are independent fingerprints of all its words and the anchor's place."""
    names = words.hashes()
    starts, doc = _window_starts(words.first, window)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    levels = recompression.parse(names, words.first, recompression.rounds_for(window))
    level, symbol, name = recompression.anchors(levels, starts, window)
    new = np.ones(len(starts), bool)
    new[1:] = (level[1:] != level[:-1]) | (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(starts)))
    begin, end = starts[head], starts[head] + many + window - 1
    place = np.zeros(len(head), np.int64)
    for number, l in enumerate(levels):
        own = level[head] == number
        place[own] = begin[own] - l.start[symbol[head[own]]]
    rolling = Rolling(names)
    kind, check = (mix(rolling.of(begin, end, k) ^ mix(name[head] + place.view(np.uint64) * _BASES[1 - k])) for k in (0, 1))
    return doc[head], name[head], kind, check, begin - words.first[doc[head]], many


def segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """name, kind, check, doc_id, body (hash of the text), at, windows: the segments of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            doc, name, kind, check, at, many = block_segments(words_of(*buffers(batch.column(1))), window)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in (name, kind, check)), batch.column(0).take(take), batch.column(2).take(take), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32))],
                ["name", "kind", "check", "doc_id", "body", "at", "windows"],
            )

    return _keyed(docs).mapInArrow(run, _SEGMENT)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("body"))


def _texts_of(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """The documents that ``lists`` (doc_id, body, items) names, once each, with their items; only their texts are shuffled when the ids can be broadcast."""
    ids = lists.select("doc_id").distinct()
    keyed = _keyed(docs)
    if ids.count() <= BROADCAST_IDS:
        keyed = keyed.join(F.broadcast(ids), "doc_id", "left_semi")
    return keyed.dropDuplicates(["doc_id", "body"]).join(lists, ["doc_id", "body"])


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, body, runs array<struct<at, windows>>): windows of each document whose words also start in a document with a smaller doc_id."""
    parts = materialize(segments(docs, window), "segments")
    names = parts.groupBy("name").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("smallest < largest").select("name")
    names = materialize(names, "shared-names")  # written, so that the join has exchanges of its own, and a hot name's rows are split
    shared = materialize(parts.join(names, "name").distinct(), "shared-segments")  # rows that repeat a document count once
    free(parts, names)

    # all segments of a kind have the same windows: in a document after the first one of the kind each of them starts earlier
    kinds = materialize(shared.groupBy("name", "kind", "check").agg(F.min(F.struct("doc_id", "body", "at", "windows")).alias("first")), "segment-kinds")
    mixed = kinds.groupBy("name").agg((F.count("*") > 1).alias("mixed"))
    held = materialize(shared.join(materialize(kinds.join(mixed, "name"), "kinds-by-name"), ["name", "kind", "check"]), "segments-with-first")
    later = held.where("doc_id > first.doc_id").select("doc_id", "body", F.array(F.struct("at", "windows")).alias("runs"))

    # where a name has several kinds, a window of a first segment may start earlier in another kind: those are compared one by one
    firsts = kinds.join(mixed.where("mixed"), "name", "left_semi").select("first.*")
    lists = materialize(firsts.groupBy("doc_id", "body").agg(F.collect_list(F.struct("at", "windows")).alias("items")), "first-segments")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = words_of(*buffers(batch.column(1)))
            rolling = Rolling(words.hashes())
            items = batch.column(3)
            flat = items.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.asarray(items.value_lengths()))
            many, at = (np.asarray(flat.field(c)).astype(np.int64) for c in ("windows", "at"))
            each = np.repeat(np.arange(len(many)), many)
            index = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            start = words.first[row[each]] + at[each] + index
            owner = pa.array(row[each])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(rolling.of(start, start + window, k).view(np.int64)) for k in (0, 1)), batch.column(0).take(owner), batch.column(2).take(owner), pa.array(at[each].astype(np.int32)), pa.array(index.astype(np.int32))],
                ["w0", "w1", "doc_id", "body", "at", "index"],
            )

    windows = _texts_of(docs, lists).select("doc_id", "text", "body", "items").mapInArrow(spread, "w0 long, w1 long, doc_id long, body long, at int, index int")
    windows = materialize(windows, "segment-windows")
    first = materialize(windows.groupBy("w0", "w1").agg(F.min("doc_id").alias("smallest")), "first-windows")
    owned = windows.join(first, ["w0", "w1"]).groupBy("doc_id", "body", "at").agg(F.collect_list(F.struct("index", "smallest")).alias("found"))
    owned = materialize(owned, "segment-owners")
    free(windows, first)
    covered = lambda at: F.transform(F.filter("found", lambda x: x["smallest"] < F.col("doc_id")), lambda x: F.struct((at + x["index"]).alias("at"), F.lit(1).alias("windows")))
    ones = owned.select("doc_id", "body", covered(F.col("at")).alias("runs"))
    # another segment of the first one's own document has the same windows
    again = held.where("mixed AND doc_id = first.doc_id AND (body <> first.body OR at <> first.at)")
    again = again.select("doc_id", "body", F.col("at").alias("place"), F.col("first.doc_id").alias("d"), F.col("first.body").alias("b"), F.col("first.at").alias("a"))
    of_first = owned.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), F.col("at").alias("a"), "found")
    same = again.join(of_first, ["d", "b", "a"]).select("doc_id", "body", covered(F.col("place")).alias("runs"))
    part = ones.unionByName(same).where("size(runs) > 0")
    return later.unionByName(part).groupBy("doc_id", "body").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _kept_text(words: Words, kept: np.ndarray, docs: int) -> pa.Array:
    """The kept words of each document joined by one space."""
    at = np.flatnonzero(kept)
    doc = words.doc[at]
    size = words.end[at] - words.start[at]
    gap = np.ones(len(at), np.int64)
    if len(at):
        gap[np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))] = 0
    length = size + gap
    out = np.full(length.sum(), 32, np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.cumsum(length) - size, size) + inside] = words.data[np.repeat(words.start[at], size) + inside]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, length, docs) if len(at) else np.zeros(docs))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), docs, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with each text's kept words joined by one space, and n_words, n_removed (long).

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id; windows are those of the input. Null text
    becomes the empty text with no words; a text under ``window`` words loses nothing; one of any length is worked on
    whole, in about 30 times its words' 8 bytes. Rows with null doc_id lose nothing and
    cover nothing. Rows that repeat a doc_id are judged each, against smaller
    ids only. All columns stay; ones named n_words or n_removed are replaced. An empty table gives an empty result.
    """
    found = materialize(repeated_windows(docs, window), "repeated-windows")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    kept = [f for f in docs.schema.fields if f.name in names]
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = words_of(*buffers(batch.column(text_at)))
            gone = np.zeros(len(words.start) + 1, np.int64)
            runs = batch.column(len(names))
            if runs.null_count < len(runs):
                flat = runs.flatten()
                row = np.repeat(np.arange(len(runs)), np.asarray(runs.value_lengths().fill_null(0)))
                at = words.first[row] + np.asarray(flat.field("at"))
                np.add.at(gone, at, 1)
                np.subtract.at(gone, at + np.asarray(flat.field("windows")) + window - 1, 1)
            kept_words = np.cumsum(gone[:-1]) == 0
            n = np.diff(words.first)
            left = np.concatenate([[0], np.cumsum(kept_words)])
            columns = batch.columns[: len(names)]
            columns[text_at] = _kept_text(words, kept_words, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(n - np.diff(left[words.first]))], [*names, "n_words", "n_removed"])

    rows = docs.select(*names)
    lists = found.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("runs").alias("__runs"))
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__body"))
    ids = lists.select("__id").distinct()
    if ids.count() <= BROADCAST_IDS:
        named = F.col("doc_id").eqNullSafe(F.col("__id"))
        touched = rows.join(F.broadcast(ids), named, "left_semi").join(lists, same, "left").select(*names, "__runs")
        free = rows.join(F.broadcast(ids), named, "left_anti").select(*names, F.lit(None).cast(lists.schema["__runs"].dataType).alias("__runs"))
        return touched.mapInArrow(run, schema).unionByName(free.mapInArrow(run, schema))
    return rows.join(lists, same, "left").select(*names, "__runs").mapInArrow(run, schema)
