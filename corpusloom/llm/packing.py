"""Best-fit packing by large-item matching.

Only piece lengths decide a packing, and there are at most ``capacity`` of
them, so the packing is planned on the histogram of lengths: a bounded
problem at any input size. Pieces above one third of the capacity are matched
greedily, two to a bin at most; shorter ones go, longest first, into the
tightest gap that holds them. The plan is a list of runs, and every piece finds
its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.llm._text import blocks, buffers, words_of
from corpusloom.plans.runtime import broadcast_if_small, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a worker remembers; then it starts anew, so memory stays bounded.
CACHED_WORDS = 1_000_000
#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 100_000

_tokenizers: dict = {}


class WordIds:
    """Ids of words that contain no ASCII white space, remembered between blocks.

    The tokenizer must split text at white space before anything else, so that the ids
    of a text are those of its words in turn; one that does not is refused. Words are known by their 64-bit names.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.forget()
        ids = lambda text: self.model.encode(text, add_special_tokens=False).ids
        for left, right in (("Some", "words"), ("x", "."), ("1", "2"), ("\u00e9", "\u4e2d")):
            for gap in (" ", "\n", "\t", "\x0b", "\x0c", "\r", "  ", " \n\n "):
                if ids(f"{gap}{left}{gap}{right}{gap}") != ids(left) + ids(right):
                    raise ValueError(f"{path} does not split text at white space alone: {gap!r} changes the ids of {left!r} and {right!r}")

    def forget(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def places_of(self, words) -> np.ndarray:
        """For each word its number in this table; unknown words are encoded first."""
        names, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(names) > CACHED_WORDS and len(self.keys):
            self.forget()
        at = np.searchsorted(self.keys, names)
        known = np.zeros(len(names), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == names[inner]
        if not known.all():
            new = names[~known]
            found = [e.ids for e in self.model.encode_batch_fast([words.text(i).decode() for i in first[~known]], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            n = len(self.offsets) - 1
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, lengths.sum())])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            where = np.searchsorted(self.keys, new)
            self.keys, self.places = np.insert(self.keys, where, new), np.insert(self.places, where, np.arange(n, n + len(new)))
            at = np.searchsorted(self.keys, names)
        return self.places[at][inverse]


def _ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start:start+length] for each, end to end."""
    ends = np.cumsum(length)
    return values[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def document_ids(batch: pa.RecordBatch, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a block of texts, ``end_id`` after each."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    table = _tokenizers[path]
    words = words_of(*buffers(batch.column(batch.schema.get_field_index("text"))))
    place = table.places_of(words)
    length = np.insert(table.offsets[place + 1] - table.offsets[place], words.first[1:], 1)
    start = np.insert(table.offsets[place], words.first[1:], len(table.ids))
    sums = np.concatenate([[0], np.cumsum(length)])
    ids = _ragged(np.append(table.ids, np.uint32(end_id)), start, length)
    return ids.astype("<u4"), np.append(0, sums[words.first[1:] + np.arange(1, batch.num_rows + 1)])


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of a document's ids: doc_id, piece, start, length, ids_crc32.

    Null text is empty; an empty document is the end id alone. Only documents
    longer than ``capacity`` are cut. Rows with null or repeated doc_id keep
    their own pieces. Texts of any length are encoded whole. Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            ids, offsets = document_ids(batch, tokenizer_path, end_id)
            n = -(-np.diff(offsets) // capacity)
            row = np.repeat(np.arange(batch.num_rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(offsets)[row] - start)
            raw, at = memoryview(ids).cast("B"), (offsets[row] + start) * 4
            crc = np.fromiter((zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist())), np.int64, len(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Pack lengths given by count: (runs, number of bins).

    A run (length, rank, n, bin, width, offset) places the pieces of that
    length with ranks rank..rank+n-1: the q-th goes to bin + q % width at
    offset + q // width * length.
    """
    left = {k: int(v) for k, v in counts.items() if v > 0}
    total = dict(left)
    runs: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, bins)
    sizes: list[int] = []
    bins = 0

    def place(length: int, n: int, first: int, width: int, offset: int) -> None:
        runs.append((length, total[length] - left[length], n, first, width, offset))
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, n))

    third = capacity // 3
    large = sorted((k for k in left if k > third), reverse=True)
    for a in large:
        for b in large:
            if left[a] and b <= capacity - a and left[b]:
                n = min(left[a], left[b]) if a != b else left[a] // 2
                if n:
                    place(a, n, bins, n, 0)
                    place(b, n, bins, n, a)
                    leave(capacity - a - b, bins, n)
                    bins += n
        if left[a]:
            n = left[a]
            place(a, n, bins, n, 0)
            leave(capacity - a, bins, n)
            bins += n
    for s in sorted((k for k in left if k <= third), reverse=True):
        while left[s]:
            i = bisect_left(sizes, s)
            if i == len(sizes):  # no gap holds it: new bins, as full of it as they get
                per = capacity // s
                n = -(-left[s] // per)
                leave(capacity, bins, n)
                bins += n
                continue
            gap = sizes.pop(i)
            for first, n in sorted(gaps.pop(gap)):
                if not left[s]:
                    leave(gap, first, n)
                    continue
                per = gap // s
                full = min(n, left[s] // per)
                if full:
                    place(s, full * per, first, full, capacity - gap)
                    leave(gap - per * s, first, full)
                rest = min(left[s], per) if full < n else 0
                if rest:
                    place(s, rest, first + full, 1, capacity - gap)
                    leave(gap - rest * s, first + full, 1)
                leave(gap, first + full + bool(rest), n - full - bool(rest))
    return np.array(sorted(runs), np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give every piece a sequence_id and an offset in it; rows equal in all columns are interchangeable.

    Needs doc_id, piece, length and ids_crc32 columns (lengths 1 to ``capacity``) and keeps every
    column; columns named sequence_id and offset are replaced. The driver
    gets one count per length, at most ``capacity`` numbers.
    """
    spark = pieces.sparkSession
    # the salt is written with the pieces; equal rows of different tasks have different ones, so that no row is so frequent that one task ranks it
    named = F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id())
    written = materialize(pieces.drop("sequence_id", "offset").withColumn("__salt", named), "pieces")
    total = written.count()
    salts = max(64, total // RANKED_TOGETHER)
    salted = written.withColumn("__salt", F.pmod("__salt", F.lit(salts)).cast("int"))
    pieces = written.drop("__salt")
    counted = materialize(salted.groupBy("length", "__salt").count(), "lengths")
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("count")).collect()}
    runs, _ = plan_bins(counts, capacity)
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counted.select(F.col("length").alias("__length"), F.col("__salt").alias("__of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(broadcast_if_small(shift), (F.col("length") == F.col("__length")) & (F.col("__salt") == F.col("__of")))
    ranked = ranked.select(*pieces.columns, (F.col("__rank") + F.col("__shift")).alias("__rank"))
    plan = spark.sparkContext.broadcast(runs)  # a few runs for each length, whatever the input's size
    names = [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        span = int((table[:, 1] + table[:, 2]).max(initial=0)) + 1
        keys = table[:, 0] * span + table[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64) for c in ("length", "__rank"))
            r = table[np.searchsorted(keys, length * span + rank, side="right") - 1]
            q = rank - r[:, 1]
            columns = [b.column(b.schema.get_field_index(c)) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(r[:, 3] + q % r[:, 4]), pa.array(r[:, 5] + q // r[:, 4] * length)], names)

    return ranked.mapInArrow(run, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Cut, then pack; see ``cut_pieces`` and ``pack``."""
    return pack(cut_pieces(docs, tokenizer_path, capacity, end_id), capacity)
