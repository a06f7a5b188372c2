"""Small dimensions: corpora, embedding models, free names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from corpusloom.functions import text as T


@dataclass(frozen=True)
class Corpus:
    name: str
    corpus_id: str
    description: str = ""
    starters: tuple[str, ...] = ()
    public: bool = True


@dataclass(frozen=True)
class EmbeddingModel:
    name: str
    dimension: int
    max_tokens: int = 8192
    query_template: str = "{query}"
    truncatable: bool = False

    def query_text(self, query: str) -> str:
        return self.query_template.format(query=query)


@dataclass(frozen=True)
class HashedWords:
    """An embedder that needs no model: every word of a text adds 1 or -1 to one of ``dimension`` places, as its MD5 digest says; length one.

    A word's place are the digest's first seven hexadecimal digits modulo ``dimension``, its sign the eighth's lowest bit.
    """

    dimension: int = 256

    def __call__(self, texts: list[str]) -> np.ndarray:
        import regex

        out = np.zeros((len(texts), self.dimension))
        known: dict[str, tuple[int, int]] = {}
        for i, text in enumerate(texts):
            for word in regex.findall(T.WORD, text.lower()):
                if word not in known:
                    digest = hashlib.md5(word.encode()).hexdigest()
                    known[word] = int(digest[:7], 16) % self.dimension, 1 - 2 * (int(digest[7], 16) & 1)
                place, sign = known[word]
                out[i, place] += sign
        length = np.sqrt((out * out).sum(axis=1))
        return out / np.where(length > 0, length, 1)[:, None]


def _embedded(rows: DataFrame, text: str, vector: str, model: Callable[[list[str]], np.ndarray], dimensions: int | None, batch: int, tries: int) -> DataFrame:
    """Adds ``vector`` (cut to ``dimensions``, length one) and __fault; a batch that fails is tried again, then text by text."""
    columns = rows.columns
    at = columns.index(text)

    def one(texts: list[str]) -> np.ndarray:
        found = np.asarray(model(texts), dtype=float)[:, :dimensions]
        length = np.sqrt((found * found).sum(axis=1))
        return found / np.where(length > 0, length, 1)[:, None]

    def careful(texts: list[str]) -> tuple[list, list]:
        for _ in range(tries):
            try:
                return [v.tolist() for v in one(texts)], [None] * len(texts)
            except Exception as fault:  # noqa: BLE001  what a model raises is its own affair
                last = f"{type(fault).__name__}: {fault}"
        if len(texts) == 1:
            return [None], [last]
        vectors, faults = zip(*(careful([t]) for t in texts))
        return [v[0] for v in vectors], [f[0] for f in faults]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                vectors, faults = careful([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(faults, pa.string())], [*columns, vector, "__fault"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(vector, ArrayType(DoubleType())), StructField("__fault", StringType())]))


def embed_queries(queries: DataFrame, model: Callable[[list[str]], np.ndarray], info: EmbeddingModel, dimensions: int | None = None) -> DataFrame:
    """(query_id, query) with query_vector: the model's template around each query, cut to ``dimensions`` where the model allows it, length one."""
    if dimensions and dimensions < info.dimension and not info.truncatable:
        raise ValueError(f"vectors of {info.name} cannot be cut")
    before, _, after = info.query_template.partition("{query}")
    asked = queries.withColumn("__text", F.concat(F.lit(before), F.coalesce("query", F.lit("")), F.lit(after)))
    return _embedded(asked, "__text", "query_vector", model, dimensions, 64, 2).drop("__text", "__fault")


def embed_documents(blocks: DataFrame, model: Callable[[list[str]], np.ndarray], vector: str = "vector", dimensions: int | None = None, batch: int = 64, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(blocks with ``vector``, rejected blocks with their ``fault``): title and content of each, in batches; a failing batch is tried again, then taken apart."""
    text = T.embedding_text(T.full_title("document_title", "section_title"), F.coalesce("content", F.lit("")))
    found = _embedded(blocks.withColumn("__text", text), "__text", vector, model, dimensions, batch, tries).drop("__text")
    return found.where("__fault IS NULL").drop("__fault"), found.where("__fault IS NOT NULL").drop(vector).withColumnRenamed("__fault", "fault")


@dataclass
class Registry:
    """Look-up by one key; an unknown key is an error."""

    key: Callable[[object], str]
    items: dict[str, object] = field(default_factory=dict)

    def add(self, item: object) -> None:
        self.items[self.key(item)] = item

    def get(self, key: str) -> object:
        if key not in self.items:
            raise KeyError(f"{key!r} is not registered; known: {sorted(self.items)}")
        return self.items[key]

    def table(self, spark: SparkSession) -> DataFrame:
        """All items as rows, to be broadcast."""
        return spark.createDataFrame([vars(i) for i in self.items.values()])


def free_name(name: str, taken: set[str], suffix: str = ".jsonl") -> str:
    """``name``, or with _v2, _v3, ... before its suffix if it is taken."""
    stem = name.removesuffix(suffix)
    candidate, number = name, 2
    while candidate in taken:
        candidate, number = f"{stem}_v{number}{suffix}", number + 1
    return candidate
