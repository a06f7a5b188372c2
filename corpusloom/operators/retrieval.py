"""Vector collections: storage, exact and quantised filtered search, result shaping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.functions import values as V
from corpusloom.operators.blocks import Filter, compile_filters, first_per_key
from corpusloom.plans.runtime import materialize

# Limits of one request.
MAX_QUERIES, MAX_QUERY_CHARACTERS, MAX_BLOCKS = 100, 512, 300


@dataclass
class SearchRequest:
    """1..100 queries of 1..512 characters, 1..300 blocks; the rerank depth is at least the number of blocks."""

    query: str | list[str]
    num_blocks: int = 3
    filters: list[Filter] = field(default_factory=list)
    rerank: bool = False
    num_blocks_to_rerank: int = 0

    def __post_init__(self) -> None:
        if isinstance(self.query, str):
            self.query = [self.query]
        if not 1 <= len(self.query) <= MAX_QUERIES:
            raise ValueError(f"1 to {MAX_QUERIES} queries")
        if not all(isinstance(q, str) and 1 <= len(q) <= MAX_QUERY_CHARACTERS for q in self.query):
            raise ValueError(f"queries have 1 to {MAX_QUERY_CHARACTERS} characters")
        if not 1 <= self.num_blocks <= MAX_BLOCKS or not 0 <= self.num_blocks_to_rerank <= MAX_BLOCKS:
            raise ValueError(f"1 to {MAX_BLOCKS} blocks")
        if not self.rerank or self.num_blocks_to_rerank < self.num_blocks:
            self.num_blocks_to_rerank = self.num_blocks


def _top(pairs: DataFrame, score: Column, k: int, id_column: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_column)
    return pairs.withColumn("similarity", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, filters: Iterable[Filter] = (), id_column: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """Exact search by inner product: query_id, ``id_column``, similarity, rank, ties to the smaller id.

    ``queries`` (query_id, query_vector) are answered whole, in blocks of about ``MAX_QUERIES``, each broadcast; the
    filter reaches the scan of ``vectors``, and each task keeps its own best before rows meet.
    """
    filters = list(filters)
    return _by_blocks(queries, lambda few: _knn_block(few, vectors, k, filters, id_column, vector, exclude_self))


def _by_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answers of all queries; rows of one query_id are in one block."""
    many = -(-queries.count() // MAX_QUERIES)
    if many < 2:
        return answer(queries)
    block = F.pmod(F.xxhash64("query_id"), F.lit(many))
    return reduce(DataFrame.unionByName, [answer(queries.where(block == i)) for i in range(many)])


def _knn_block(queries: DataFrame, vectors: DataFrame, k: int, filters: Iterable[Filter], id_column: str, vector: str, exclude_self: bool) -> DataFrame:
    wanted = compile_filters(filters)
    stored = vectors if wanted is None else vectors.where(wanted)
    few = queries.select("query_id", "query_vector")
    pairs = stored.select(id_column, F.col(vector).alias("__v")).join(F.broadcast(few))
    if exclude_self:
        pairs = pairs.where(F.col("query_id") != F.col(id_column))
    return _top(pairs, V.dot("query_vector", "__v"), k, id_column).select("query_id", id_column, "similarity", "rank")


def knn_quantized(queries: DataFrame, vectors: DataFrame, k: int, dimensions: int, oversampling: float = 3.0, filters: Iterable[Filter] = (), id_column: str = "vec_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """Candidates by the Hamming distance of sign bits, ``oversampling`` times k of them, then exact scores; columns and blocks as ``knn``."""
    filters = list(filters)
    return _by_blocks(queries, lambda few: _quantized_block(few, vectors, k, dimensions, oversampling, filters, id_column, vector, exclude_self))


def _quantized_block(queries: DataFrame, vectors: DataFrame, k: int, dimensions: int, oversampling: float, filters: Iterable[Filter], id_column: str, vector: str, exclude_self: bool) -> DataFrame:
    wanted = compile_filters(filters)
    stored = vectors if wanted is None else vectors.where(wanted)
    few = queries.select("query_id", "query_vector", V.sign_bits("query_vector", dimensions).alias("__q"))
    bits = F.col("__bits") if "__bits" in stored.columns else V.sign_bits(vector, dimensions)
    pairs = stored.select(id_column, F.col(vector).alias("__v"), bits.alias("__b")).join(F.broadcast(few))
    if exclude_self:
        pairs = pairs.where(F.col("query_id") != F.col(id_column))
    order = Window.partitionBy("query_id").orderBy("__d", id_column)
    near = pairs.withColumn("__d", V.differing_bits("__q", "__b")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= int(k * oversampling))
    return _top(near, V.dot("query_vector", "__v"), k, id_column).select("query_id", id_column, "similarity", "rank")


def with_probabilities(results: DataFrame, digits: int = 3) -> DataFrame:
    """Add probability: softmax of similarity within each query; both rounded."""
    p = V.softmax(F.col("similarity"), ["query_id"])
    return results.withColumn("probability", F.round(p, digits)).withColumn("similarity", F.round("similarity", digits))


class Collection:
    """A named set of (id, vector, payload): Parquet folders, and a list of those that make up each version.

    A version counts once its list is written, after all of its rows; readers take the newest list. So a writer that dies
    leaves the version before it whole. Folders are partitioned by ``partition`` if given; rows are sorted by
    ``indexed`` payload columns inside files, so that their statistics let scans skip, and ids have Bloom filters.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, id_column: str = "id", partition: str | None = None, indexed: tuple[str, ...] = ()):
        self.spark, self.path, self.id, self.partition, self.indexed = spark, f"{root.rstrip('/')}/{name}", id_column, partition, indexed

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._fs(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()) if fs.exists(where) else []

    def exists(self) -> bool:
        return bool(self.versions())

    def drop(self) -> None:
        where, fs = self._fs(self.path)
        fs.delete(where, True)

    def _folders(self, version: int | None = None) -> list[str]:
        version = self.versions()[-1] if version is None else version
        return [r["value"] for r in self.spark.read.text(f"{self.path}/versions/{version}").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the newest."""
        folders = self._folders(version)
        frames = [self.spark.read.parquet(f"{self.path}/rows/{f}") for f in folders]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _commit(self, rows: DataFrame, keep: list[str]) -> None:
        """Write ``rows`` as one more folder and make it, with the folders ``keep``, the next version."""
        folder = uuid.uuid4().hex
        if self.indexed:
            rows = rows.sortWithinPartitions(*self.indexed)
        writer = rows.write.option("parquet.bloom.filter.enabled#" + self.id, "true")
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.path}/rows/{folder}")
        number = (self.versions() or [0])[-1] + 1
        draft, fs = self._fs(f"{self.path}/versions/.{folder}")
        out = fs.create(draft)
        out.write(bytearray("\n".join([*keep, folder]), "utf-8"))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/versions/{number}")[0]):
            raise RuntimeError(f"version {number} of {self.path} was written by another")

    def _first(self, rows: DataFrame) -> DataFrame:
        return first_per_key(rows, [self.id], [])

    def add(self, rows: DataFrame) -> None:
        """Append rows whose id is new; of rows that repeat an id the smallest is kept. Rows already stored are not rewritten."""
        rows = self._first(rows)
        if self.exists():
            rows = rows.join(self.read().select(self.id), self.id, "left_anti")
        self._commit(rows, self._folders() if self.exists() else [])

    def upsert(self, rows: DataFrame) -> None:
        """New rows replace stored ones of the same id, in a new version; of rows that repeat an id the smallest is kept."""
        rows = self._first(rows)
        if self.exists():
            rows = self.read().join(rows.select(self.id), self.id, "left_anti").unionByName(rows, allowMissingColumns=True)
        self._commit(rows, [])

    def clean(self, keep: int = 1) -> None:
        """Delete versions but the newest ``keep``, and folders that none of those names."""
        old = self.versions()[:-keep]
        used = {f for v in self.versions()[-keep:] for f in self._folders(v)}
        for v in old:
            where, fs = self._fs(f"{self.path}/versions/{v}")
            fs.delete(where, False)
        where, fs = self._fs(f"{self.path}/rows")
        for name in [s.getPath().getName() for s in fs.listStatus(where)]:
            if name not in used:
                fs.delete(self._fs(f"{self.path}/rows/{name}")[0], True)

    def snapshot(self, label: str) -> str:
        """A copy of the newest version's rows beside the collection."""
        to = f"{self.path}.snapshot-{label}"
        self.read().write.parquet(to)
        return to

    def load(self, label: str) -> None:
        """A snapshot's rows as the newest version."""
        self._commit(self.spark.read.parquet(f"{self.path}.snapshot-{label}"), [])

    def payload_types(self) -> dict[str, str]:
        """The index type of each payload column: keyword, integer, float, bool or datetime; others have none."""
        names = {"string": "keyword", "array<string>": "keyword", "boolean": "bool", "date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime", "float": "float", "double": "float"}
        found = {c: names.get(kind) or ("integer" if kind in ("tinyint", "smallint", "int", "bigint") else "") for c, kind in self.read().dtypes if c != self.id}
        return {c: kind for c, kind in found.items() if kind}


def list_collections(spark: SparkSession, root: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return sorted(n for n in names if ".snapshot-" not in n and Collection(spark, root, n).exists())


#: Vectors that cell centres are fitted on at most, and rounds of that fit.
CENTRE_ROWS, CENTRE_ROUNDS = 20_000, 8


@dataclass
class Cells:
    """An inverted file over a collection: every vector belongs to the cell of its nearest centre, and a query looks into a few cells."""

    centres: np.ndarray

    @staticmethod
    def fit(vectors: DataFrame, vector: str, cells: int) -> Cells:
        """Centres by rounds of nearest means over a bounded sample, the vectors of the smallest hashes."""
        rows = vectors.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector), vector).limit(CENTRE_ROWS).toArrow()
        x = np.asarray(rows[vector].combine_chunks().flatten(), dtype=np.float32).reshape(rows.num_rows, -1)
        centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(CENTRE_ROUNDS if len(x) else 0):
            own = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            count = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
        return Cells(centres)

    def assign(self, rows: DataFrame, vector: str, name: str = "cell", probes: int | None = None) -> DataFrame:
        """Adds the cell of each vector, or with ``probes`` the array of a query's cells, those of the largest inner product with their centres first."""
        centres = rows.sparkSession.sparkContext.broadcast(self.centres)  # as many as cells were asked for
        columns = rows.columns
        at = columns.index(vector)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = centres.value
            bias = 0 if probes else (c**2).sum(axis=1) / 2
            for batch in batches:
                x = np.asarray(batch.column(at).flatten(), dtype=np.float32).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, c.shape[1]), np.float32)
                score = x @ c.T - bias
                if probes:
                    best = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
                    found = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
                else:
                    found = pa.array(score.argmax(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*columns, name])

        kind = ArrayType(IntegerType()) if probes else IntegerType()
        return rows.where(F.col(vector).isNotNull()).mapInArrow(run, StructType([*rows.schema.fields, StructField(name, kind)]))


def knn_cells(queries: DataFrame, stored: DataFrame, cells: Cells, k: int, dimensions: int, probes: int = 8, oversampling: float = 3.0, filters: Iterable[Filter] = (), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate search: the ``probes`` nearest cells of ``stored`` (with cell, partitioned by it), sign bits there, exact scores for ``oversampling`` times k.

    Only the cells that some query of a block looks into are read. Columns as ``knn``.
    """
    filters = list(filters)

    def answer(few: DataFrame) -> DataFrame:
        asked = cells.assign(few.select("query_id", "query_vector"), "query_vector", "cells", probes).select("query_id", "query_vector", F.explode("cells").alias("cell"))
        asked = asked.withColumn("__q", V.sign_bits("query_vector", dimensions))
        wanted = compile_filters(filters)
        rows = stored if wanted is None else stored.where(wanted)
        rows = rows.select("cell", id_column, F.col(vector).alias("__v"), V.sign_bits(vector, dimensions).alias("__b"))
        pairs = rows.join(F.broadcast(asked), "cell")  # a block of queries, ``probes`` rows each
        order = Window.partitionBy("query_id").orderBy("__d", id_column)
        near = pairs.withColumn("__d", V.differing_bits("__q", "__b")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= int(k * oversampling))
        return _top(near, V.dot("query_vector", "__v"), k, id_column).select("query_id", id_column, "similarity", "rank")

    return _by_blocks(queries, answer)


def search(request: SearchRequest, collection: DataFrame, embed: Callable[[DataFrame], DataFrame], rerank: Callable[[DataFrame], DataFrame] | None = None, id_column: str = "id", vector: str = "vector") -> DataFrame:
    """Embed, filter, search, rerank if asked, and cut to ``num_blocks``.

    ``embed`` maps (query_id, query) to (query_id, query, query_vector); ``rerank`` maps results with query, rank and payload to the same
    rows with a new ``rank``. Retrieves the rerank depth first, so reranking can bring new blocks in. The payload of the few rows
    found is read by their ids, which are broadcast: a request finds at most ``MAX_QUERIES`` x ``MAX_BLOCKS`` rows.
    """
    spark = collection.sparkSession
    queries = embed(spark.createDataFrame(list(enumerate(request.query)), "query_id long, query string"))
    found = materialize(knn(queries, collection, request.num_blocks_to_rerank, request.filters, id_column, vector), "found")
    payload = collection.drop(vector).join(F.broadcast(found.select(id_column).distinct()), id_column, "left_semi")
    found = payload.join(F.broadcast(with_probabilities(found)), id_column).join(F.broadcast(queries.select("query_id", "query")), "query_id")
    if request.rerank and rerank is not None:
        found = rerank(found)
    return found.where(F.col("rank") <= request.num_blocks)


#: Queries of one call of a search service, and blocks that a web search shows.
QUERIES_PER_CALL, WEB_BLOCKS = 10, 100


def search_calls(queries: list[str], call: Callable[[list[str]], DataFrame], per_call: int = QUERIES_PER_CALL) -> DataFrame:
    """Results of any number of queries from a service that takes ``per_call`` at a time: ``call`` gives (query_id, ...) for its list, numbered from 0.

    A query without results stays without rows; a call that answers a query it was not asked is an error.
    """
    parts = []
    for at in range(0, len(queries), per_call):
        some = queries[at : at + per_call]
        rows = call(some)
        if not rows.where(~F.coalesce(F.col("query_id").between(0, len(some) - 1), F.lit(False))).isEmpty():
            raise ValueError("a result belongs to none of the queries")
        parts.append(rows.withColumn("query_id", F.col("query_id") + F.lit(at)))
    return reduce(DataFrame.unionByName, parts)


def unanswered(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id) of the queries that have no result; an empty frame says that every query was matched."""
    return queries.select("query_id").distinct().join(results.select("query_id").distinct(), "query_id", "left_anti")


def web_search(query: str, collection: DataFrame, embed: Callable[[DataFrame], DataFrame], rerank: Callable[[DataFrame], DataFrame], names: DataFrame | None = None, **options) -> DataFrame:
    """One query, ``WEB_BLOCKS`` blocks, reranked; unranked where reranking fails. ``names`` (language, display_name) makes codes readable."""
    request = SearchRequest(query, num_blocks=WEB_BLOCKS)
    found = materialize(search(request, collection, embed, **options), "web-results")
    try:
        found = materialize(rerank(found), "web-reranked")
    except Exception:  # noqa: BLE001  a model that refuses must not lose the results
        pass
    if names is None or "language" not in found.columns:
        return found
    shown = found.join(F.broadcast(names.select("language", "display_name")), "language", "left")  # one row for each language
    return shown.withColumn("language", F.coalesce("display_name", "language")).drop("display_name")


#: What a search is tried with before it serves.
WARM_UP_QUERIES = ("Tell me about the city of Paris", "Wer hat das Telefon erfunden?", "¿Qué es la fotosíntesis?")


def warm_up(collection: DataFrame, embed: Callable[[DataFrame], DataFrame], queries: tuple[str, ...] = WARM_UP_QUERIES, **options) -> int:
    """Rows found by a first request in several languages; loads code, models and file lists."""
    return search(SearchRequest(list(queries)), collection, embed, **options).count()
