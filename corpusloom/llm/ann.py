"""Approximate nearest neighbours: multiprobe p-stable hashing.

Largest inner product becomes nearest distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm. Each table hashes a vector by
floor((a.x + b) / w) for several Gaussian a, made orthogonal so that none repeats what another tells, with b such that
a cell ends at the median and splits the vectors in halves. How a query's neighbours scatter around it is
measured on a sample: a query then visits, in each table, perturbed buckets in the order of their estimated
success, the share of its neighbours that fall there, weighed against the share of all vectors that do.
Buckets are dealt to tasks, a query goes once to each task that holds one of its buckets,
candidates of all tables merge there, and their exact inner products are ranked. The best of all tasks merge by query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm._text import mix
from corpusloom.plans.runtime import broadcast_if_small, materialize

#: A vector is stored once for each table, so there are few.
TABLES, FUNCTIONS = 2, 10
#: Bucket widths tried, from wide (one bucket) to narrow until two in turn are no better, in standard deviations of the sample's projections; and buckets that a query visits in a table at most.
WHOLE, PROBES = 1000.0, 1000
WIDTHS = (WHOLE, 8.0, 4.0, 3.0, 2.5, 2.0, 1.0, 0.5)
#: Of the settings with this recall on the sample's queries, the one that examines the fewest vectors is taken. With fewer than
#: ``FEW`` vectors for each neighbour wanted, all neighbours must be found.
SAMPLE_RECALL, FEW = 0.93, 10
#: Vectors fitted on at most, and queries among them whose true neighbours among all vectors are found for the fit.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 100
#: Steps to either side that one function may be perturbed by, and how much a bucket's share of all vectors counts against it.
STEPS, WEIGHT = 2, 0.7
#: A cell with no more than this share of a query's neighbours is not perturbed to where all queries have others.
UNLIKELY = 1e-6
#: Vectors of one bucket in one task; a larger bucket is cut, and its queries visit every part.
BUCKET_ROWS = 20_000
HOT_BUCKETS = 50_000
#: Vector entries (one for each table) in one task, about, and tasks at least; a query leaves its best from each task it visits.
TASK_ROWS, TASKS = 80_000, 24
#: Of how many vectors one is in the sample that gives each query a floor, and such vectors at most.
FLOOR_SHARE, FLOOR_ROWS = 32, 50_000
#: Candidates that a task holds before it keeps each query's best, and that a merging task gets, about.
HELD, MERGED = 400_000, 1_000_000


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution's share below z, from a table."""
    return np.interp(z, _GRID, _SHARE)


_GRID = np.linspace(-8, 8, 3201)
_SHARE = np.array([0.5 + 0.5 * erf(z / 2**0.5) for z in _GRID])


def cheapest_sums(cost: np.ndarray, move: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, move), by rising cost: for each row the ``most`` cheapest ways to pick one of the last axis for every function.

    ``cost`` and ``move`` are rows x functions x choices; what is picked adds up.
    """
    total, moved = np.zeros((len(cost), 1)), np.zeros((len(cost), 1), np.int64)
    for j in range(cost.shape[1]):
        total = (total[:, :, None] + cost[:, j, None, :]).reshape(len(cost), -1)
        moved = (moved[:, :, None] + move[:, j, None, :]).reshape(len(cost), -1)
        if total.shape[1] > most:
            kept = np.argpartition(total, most - 1, axis=1)[:, :most]
            total, moved = np.take_along_axis(total, kept, axis=1), np.take_along_axis(moved, kept, axis=1)
    order = np.argsort(total, axis=1, kind="stable")
    return np.take_along_axis(total, order, axis=1), np.take_along_axis(moved, order, axis=1)


def _orthogonal(a: np.ndarray) -> np.ndarray:
    """Columns turned orthogonal, as many at a time as there are rows, of the length that Gaussian columns have on average."""
    rows = len(a)
    return np.concatenate([np.linalg.qr(a[:, at : at + rows])[0] for at in range(0, a.shape[1], rows)], axis=1) * rows**0.5


@dataclass
class Index:
    """The hash functions, fixed by seed, dimension, largest component, largest norm and width, and how neighbours scatter."""

    scale: float  # vectors are divided by it before anything is squared
    norm: float
    width: float
    dimension: int
    mean: np.ndarray | float = 0.0  # of all vectors' projections, by function
    spread: np.ndarray | float = 1.0
    pull: float = 1.0  # a neighbour's projection is expected at mean + pull x the query's distance from it
    scatter: float = 0.1  # around that, as a share of the spread
    probes: int = 100
    tables: int = TABLES
    functions: int = FUNCTIONS
    seed: int = 7

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.a = _orthogonal(rng.normal(size=(self.dimension + 1, self.tables * self.functions)))
        self.b = rng.uniform(0, 1, self.tables * self.functions)
        self.names = rng.integers(-(2**62), 2**62, self.tables * self.functions) | 1
        self.salts = rng.integers(-(2**62), 2**62, self.tables)

    def project(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale / self.norm
        return x @ self.a[:-1] + np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))[:, None] * self.a[-1]

    def project_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return (q / np.sqrt((q * q).sum(axis=1))[:, None]) @ self.a[:-1]

    def _cells(self, p: np.ndarray) -> np.ndarray:
        return np.floor(p / self.width + self.b).astype(np.int64)

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        named = (cells * self.names).reshape(len(cells), self.tables, self.functions)
        return named.sum(axis=2) + self.salts

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return self._keys(self._cells(self.project(x)))

    def visits(self, q: np.ndarray) -> np.ndarray:
        """The buckets that each query visits: its own, then perturbed ones, best first: queries x tables x (1 + probes)."""
        p = self.project_queries(q)
        centre = self.mean + self.pull * (p - self.mean)
        home = self._cells(centre)
        steps = np.arange(-STEPS, STEPS + 1)
        low = (home[:, :, None] + steps - self.b[:, None]) * self.width
        wide = lambda mean, spread: _below((low + self.width - mean) / spread) - _below((low - mean) / spread)
        spread = np.broadcast_to(self.spread, self.b.shape)[:, None]
        near = wide(centre[:, :, None], self.scatter * spread)
        all_ = wide(np.broadcast_to(self.mean, self.b.shape)[:, None], spread)
        cost = WEIGHT * np.log(all_ + 1e-9) - np.log(near + 1e-9)
        move = np.broadcast_to(steps * self.names[:, None], cost.shape)
        likely = max(1, int((near > UNLIKELY).sum(axis=2).max(initial=1)))
        if likely < len(steps):
            kept = np.argpartition(cost, likely - 1, axis=2)[:, :, :likely]
            cost, move = np.take_along_axis(cost, kept, axis=2), np.take_along_axis(move, kept, axis=2)
        keys, out, own_keys = self._keys(home), [], self.buckets(q)
        for t in range(self.tables):
            own = slice(t * self.functions, (t + 1) * self.functions)
            _, moved = cheapest_sums(cost[:, own], move[:, own], self.probes)
            out.append(np.concatenate([own_keys[:, t, None], keys[:, t, None] + moved], axis=1))
        return np.stack(out, axis=1)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scale, norm) of a task: the largest component, and the largest norm in units of it."""
    scale, norm = 0.0, 0.0
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0), b.num_rows)
            size = float(np.abs(x).max())
            here = float(np.sqrt(((x / size) ** 2).sum(axis=1)).max())
            larger = max(scale, size)
            scale, norm = larger, max(norm * (scale / larger), here * (size / larger))
    if scale:
        yield pa.RecordBatch.from_arrays([pa.array([scale]), pa.array([norm])], ["scale", "norm"])


def _true_neighbours(vectors: DataFrame, queries: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query's place, neighbour) of the ``k`` largest inner products among all of ``vectors`` (item, v), by one pass over them."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast((queries, items))  # SAMPLE_QUERIES vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = sent.value
        held: list[np.ndarray] = [np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)]
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                item = np.asarray(part.column(0))
                score = q @ _matrix(part.column(1), part.num_rows).T
                score[own[:, None] == item[None, :]] = -np.inf
                score, item = np.concatenate([held[0], score], axis=1), np.concatenate([held[1], np.broadcast_to(item, score.shape)], axis=1)
                if score.shape[1] > k:
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, item = np.take_along_axis(score, top, axis=1), np.take_along_axis(item, top, axis=1)
                held = [score, item]
        some = np.isfinite(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[0]), pa.array(held[1][some]), pa.array(held[0][some])], ["query", "item", "score"])

    found = vectors.select("item", "v").mapInArrow(run, "query long, item long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    found = materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query", "item"), "sample-neighbours")
    rows = vectors.join(F.broadcast(found), "item").select("query", "v").toArrow()  # SAMPLE_QUERIES x k rows
    return np.asarray(rows["query"]), _matrix(rows["v"].combine_chunks(), rows.num_rows)


def fit_index(vectors: DataFrame, k: int) -> Index | None:
    """Measure how neighbours scatter and choose width and probes, on a bounded sample; None without vectors.

    ``vectors`` is (item, v). The sample are the ``SAMPLE_ROWS`` vectors of the smallest hashes; the neighbours of
    ``SAMPLE_QUERIES`` of them are sought among all vectors, so recall is measured at the input's own density.
    """
    sizes = vectors.select("v").mapInArrow(_sizes, "scale double, norm double").toArrow()  # a row for each task
    if not sizes.num_rows:
        return None
    scale = max(sizes["scale"].to_pylist())
    norm = max(n * (s / scale) for s, n in zip(sizes["scale"].to_pylist(), sizes["norm"].to_pylist()))
    rows = vectors.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).select("item", "v").toArrow()
    x, items = _matrix(rows["v"].combine_chunks(), rows.num_rows), np.asarray(rows["item"])
    some = np.unique(np.linspace(0, len(x) - 1, min(SAMPLE_QUERIES, len(x))).astype(int))
    of, near = _true_neighbours(vectors, x[some], items[some], k)
    index = Index(scale, norm, 1.0, x.shape[1], probes=PROBES)
    p, q = index.project(x), index.project_queries(x[some])
    index.mean, index.spread = p.mean(axis=0), np.maximum(p.std(axis=0), 1e-6)
    middle = np.median(p, axis=0)

    def set_width(width: float) -> None:
        index.width = width * float(np.median(index.spread))
        index.b = (0.5 if width == WHOLE else 0.0) - middle / index.width

    best = None
    if len(near):
        base, there = ((q[of] - index.mean) / index.spread).ravel(), ((index.project(near) - index.mean) / index.spread).ravel()
        index.pull = float((base @ there) / max(base @ base, 1e-12))
        index.scatter = float(max(np.sqrt(((there - index.pull * base) ** 2).mean()), 1e-3))
        need = int(np.ceil(len(near) * (SAMPLE_RECALL if len(x) >= FEW * k else 1.0)))
        worse = 0
        for width in WIDTHS:
            set_width(width)
            buckets, hits = index.buckets(x), index.buckets(near)
            visits = index.visits(x[some])
            met = np.concatenate([first_visit(v, hits[of == i]) for i, v in enumerate(visits)])
            probes = int(np.partition(met, need - 1)[need - 1])  # the own bucket is the first of 1 + probes
            enough = probes <= PROBES
            probes = min(probes, PROBES)
            share = np.mean([(first_visit(v, buckets) <= probes).mean() for v in visits])
            fit = (not enough, share if enough else -(met <= probes).mean(), width, max(probes, 1))
            worse = 0 if best is None or fit < best else worse + 1
            best = min(best or fit, fit)
            if worse == 2:
                break
    width, index.probes = best[2:] if best else (WHOLE, 1)
    set_width(width)
    return index


def first_visit(visits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """For each vector (a row of buckets by table) how many buckets of a table one query (a row of buckets by table) visits before it meets it; a large number if it never does."""
    out = np.full(len(buckets), 1 << 40)
    for t, row in enumerate(visits):
        order = np.argsort(row, kind="stable")
        at = order[np.minimum(np.searchsorted(row[order], buckets[:, t]), len(row) - 1)]
        out = np.where(row[at] == buckets[:, t], np.minimum(out, at), out)
    return out


def clean_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): usable vectors, one for each id.

    Null, empty and zero vectors and those holding null or non-finite
    components take no part, nor do rows with null id or with another length than
    most vectors have (the longer of equals). Of rows that repeat an id the one with the smallest vector stays.
    Extra columns are ignored, whatever their names; an empty table gives an empty one.
    """
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = table.where(F.col(id_column).isNotNull() & v.isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))
    usable = materialize(usable.select(F.col(id_column).cast("long").alias("id"), v.alias("v")), "vectors")
    repeated = materialize(usable.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        several = usable.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        usable = materialize(usable.join(repeated, "id", "left_anti").unionByName(several), "vectors-once")
    size = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return usable.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _top(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, once each item."""
    order = np.argsort(-score)
    by = query[order]
    order = order[np.argsort(by.astype(np.uint16) if len(by) and 0 <= by.min() and by.max() < 1 << 16 else by, kind="stable")]
    q, i, s = query[order], item[order], score[order]
    if ((q[1:] == q[:-1]) & (s[1:] == s[:-1]) & (i[1:] != i[:-1])).any():
        order = np.lexsort((item, -score, query))
        q, i = query[order], item[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])  # an item has one score, so its repeats are neighbours
    order = order[fresh]
    q = query[order]
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    return order[np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < k]


def rank_task(v: np.ndarray, v_keys: tuple[np.ndarray, np.ndarray], q: np.ndarray, q_keys: tuple[np.ndarray, np.ndarray], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score), by query: the k best of each query among the vectors it shares a bucket with, but for those below its ``floor``.

    Keys are (bucket, row), sorted by bucket. Products in single precision, with the error they can have, tell which pairs are scored in double.
    """
    floor = np.full(len(q), -np.inf) if floor is None else floor.copy()  # a score that k vectors are known to reach
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held, most = 0, max(HELD, 2 * k * len(q))
    names, first = np.unique(v_keys[0], return_index=True)
    last = np.append(first[1:], len(v_keys[0]))
    q_first, q_last = np.searchsorted(q_keys[0], names, "left"), np.searchsorted(q_keys[0], names, "right")
    v_size, q_size = np.abs(v).max(initial=1e-300), np.maximum(np.abs(q).max(axis=1, initial=0), 1e-300)
    v_rough, q_rough = (v / v_size).astype(np.float32), (q / q_size[:, None]).astype(np.float32)
    slack = (v.shape[1] + 2) * 2.0**-23 * np.linalg.norm(q_rough, axis=1) * np.linalg.norm(v_rough, axis=1).max(initial=0)

    def rough(floor: np.ndarray, i) -> np.ndarray:
        """The least rough product of a pair of queries ``i`` whose score may reach the floor; a floor near underflow rules nothing out."""
        return np.where(np.abs(floor) < 1e-290, -np.inf, floor / v_size / q_size[i] - 2 * slack[i]).astype(np.float32)

    low = rough(floor, slice(None))

    def squeeze() -> None:
        nonlocal parts, held, low
        a, b, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
        at = _top(a, b, s, k)
        parts, held = [(a[at], b[at], s[at])], len(at)
        count = np.bincount(a[at], minlength=len(q))
        lowest = np.full(len(q), np.inf)
        np.minimum.at(lowest, a[at], s[at])
        floor[count >= k] = lowest[count >= k]
        low = rough(floor, slice(None))

    for g in np.flatnonzero(q_last > q_first):
        rows = v_keys[1][first[g] : last[g]]
        near = v_rough[rows].T
        for at in range(q_first[g], q_last[g], 2000):
            who = q_keys[1][at : min(at + 2000, q_last[g])]
            product = q_rough[who] @ near
            if len(rows) >= k:
                new = np.flatnonzero(np.isneginf(floor[who]))
                if len(new):
                    i = who[new]
                    floor[i] = (np.partition(product[new], len(rows) - k, axis=1)[:, len(rows) - k] - slack[i]) * v_size * q_size[i]
                    low[i] = rough(floor[i], i)
            i, j = np.divmod(np.flatnonzero(product >= low[who][:, None]), len(rows))
            i, j = who[i], rows[j]
            score = np.einsum("ij,ij->i", q[i], v[j])
            some = score >= floor[i]
            parts.append((i[some], j[some], score[some]))
            held += len(parts[-1][0])
            if held > most:
                squeeze()
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    squeeze()
    return parts[0]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, index: Index | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products found among ``vectors``, but for its own id.

    Both inputs are (id, v) as ``clean_vectors`` gives them. Equal vectors are
    searched as one and named by their smallest ids, and equal queries are asked once, so a vector of any
    frequency costs one entry on either side. Ties go to the smaller vec_id. No vectors or no queries give an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    classes, several = _classes(vectors, k)
    asked = materialize(queries.groupBy("v").agg(F.min("id").alias("id")), "query-classes")
    members = materialize(queries.join(asked.withColumnRenamed("id", "asked"), "v").select(F.col("id").alias("query_id"), "asked"), "query-members")
    index = index or fit_index(classes, k)
    if index is None:
        return spark.createDataFrame([], schema)
    total = classes.count() * index.tables
    tasks = max(TASKS, total // TASK_ROWS)
    limit = max(BUCKET_ROWS, total // HOT_BUCKETS + 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(index.buckets(_matrix(b.column(0), b.num_rows)).ravel())], ["bucket"])

    counted = classes.select("v").mapInArrow(hashed, "bucket long").groupBy("bucket").count().where(F.col("count") > limit)
    hot = spark.sparkContext.broadcast({r["bucket"]: -(-r["count"] // limit) for r in counted.collect()})  # fewer than HOT_BUCKETS

    some = classes.where(F.pmod(F.xxhash64("item"), F.lit(FLOOR_SHARE)) == 0).limit(FLOOR_ROWS).select("v").toArrow()
    some = _matrix(some["v"].combine_chunks(), some.num_rows)
    sample = spark.sparkContext.broadcast((some, _by_bucket(index.buckets(some)) if len(some) else None))

    def floors(q: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A score that k + 1 of the vectors in the visited buckets (``keys``, by query) reach, as a sample of them shows."""
        v, v_keys = sample.value
        out = np.full(len(q), -np.inf)
        if len(v):
            who, _, score = rank_task(v, v_keys, q, _by_bucket(keys), k + 1)
            full = np.bincount(who, minlength=len(q)) > k
            out[full] = np.inf
            np.minimum.at(out, who[full[who]], score[full[who]])
        return out - 1e-12 * np.where(np.isinf(out), 0, np.abs(out))  # sums may round differently elsewhere

    def task_of(bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (mix(bucket.view(np.uint64) ^ mix(part.astype(np.uint64) + np.uint64(1))) % np.uint64(tasks)).astype(np.int32)

    def deal(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    x = _matrix(b.column(1), b.num_rows)
                    keys = index.visits(x).reshape(len(x), -1) if is_query else index.buckets(x)
                    floor = floors(x, keys) if is_query else np.zeros(len(x))
                    row = np.repeat(np.arange(len(keys)), keys.shape[1])
                    key, part = keys.ravel(), np.zeros(keys.size, np.int64)
                    if hot.value:
                        parts = np.fromiter((hot.value.get(x, 1) for x in key.tolist()), np.int64, len(key))
                        if is_query:
                            row, key = np.repeat(row, parts), np.repeat(key, parts)
                            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                        else:
                            part = (mix(np.asarray(b.column(0)).astype(np.uint64))[row] % parts.astype(np.uint64)).astype(np.int64)
                    task = task_of(key, part)
                    order = np.lexsort((key, task, row))
                    row, key, task = row[order], key[order], task[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (task[1:] != task[:-1])
                    head = np.flatnonzero(new)
                    take = pa.array(row[head])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(key))
                    yield pa.RecordBatch.from_arrays([pa.array(task[head]), pa.array(np.full(len(head), is_query)), b.column(0).take(take), b.column(1).take(take), lists, pa.array(floor[row[head]])], ["task", "is_query", "id", "v", "keys", "floor"])

        return run

    kind = vectors.schema["v"].dataType.simpleString()
    row_schema = f"task int, is_query boolean, id long, v {kind}, keys array<long>, floor double"
    entries = classes.select("item", "v").mapInArrow(deal(False), row_schema).unionByName(asked.select("id", "v").mapInArrow(deal(True), row_schema))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list] = {False: [], True: []}
        for b in batches:
            mask = np.asarray(b.column(1))
            for side in (False, True):
                part = b.filter(pa.array(mask == side))
                if part.num_rows:
                    keys = part.column(4)
                    sides[side].append((np.asarray(part.column(0)), np.asarray(part.column(2)), _matrix(part.column(3), part.num_rows).astype(np.float32 if kind == "array<float>" else np.float64), np.asarray(keys.flatten()), np.asarray(keys.value_lengths()), np.asarray(part.column(5))))
        if not (sides[False] and sides[True]):
            return
        # several tasks can land in one partition; a task number in front keeps their buckets apart
        (v_id, v, v_keys, _), (q_id, q, q_keys, floor) = (_gather(sides[s]) for s in (False, True))
        who, what, score = rank_task(v, v_keys, q, q_keys, k + 1, floor)
        head = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)  # sorted by query
        ends = pa.array(np.append(head, len(who)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (v_id[what], score)]
        yield pa.RecordBatch.from_arrays([pa.array(q_id[who[head]]), *lists], ["query_id", "items", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.repeat(np.asarray(b.column(0)), np.asarray(b.column(1).value_lengths())), *(np.asarray(b.column(c).flatten()) for c in (1, 2))) for b in batches if b.num_rows]
        if got:
            query, item, score = (np.concatenate([g[c] for g in got]) for c in range(3))
            top = _top(query, item, score, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x[top]) for x in (query, item, score)], ["query_id", "item", "score"])

    found = entries.repartition(tasks, "task").mapInArrow(rank, "query_id long, items array<long>, scores array<double>")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count() * tasks * (k + 1) // MERGED)
    found = found.repartition(parts, "query_id").mapInArrow(merge, "query_id long, item long, score double")
    named = found.join(broadcast_if_small(several), "item", "left")
    each = named.select(F.col("query_id").alias("asked"), "score", F.explode(F.coalesce("ids", F.array("item"))).alias("vec_id"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)  # one of them may be the query itself
    lists = materialize(each.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")), "found-lists")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = members.join(lists, "asked").select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(item, v) of each distinct vector, named by its smallest id, and (item, ids) of those with several ids, the k + 1 smallest.

    Only vectors whose hash repeats are shuffled.
    """
    hashed = vectors.withColumn("__h", F.xxhash64("v"))
    again = materialize(hashed.groupBy("__h").count().where("count > 1").select("__h"), "repeated-vectors")
    if again.isEmpty():
        return vectors.select(F.col("id").alias("item"), "v"), again.select(F.col("__h").alias("item"), F.array("__h").alias("ids"))
    again = broadcast_if_small(again)
    few = Window.partitionBy("v").orderBy("id")
    copies = hashed.join(again, "__h", "left_semi").withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    copies = copies.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("item"), "v", "ids")
    copies = materialize(copies, "copies")
    once = hashed.join(again, "__h", "left_anti").select(F.col("id").alias("item"), "v")
    return materialize(once.unionByName(copies.select("item", "v")), "vector-classes"), copies.where("size(ids) > 1").select("item", "ids")


def _by_bucket(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of rows of buckets, sorted by bucket."""
    order = np.argsort(keys, axis=None, kind="stable")
    return keys.ravel()[order], order // keys.shape[1]


def _gather(parts: list) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(id, vectors, (bucket, row) sorted by bucket, floor) of one side of a partition."""
    v = np.concatenate([p[2] for p in parts]).astype(np.float64)
    ids = np.concatenate([p[1] for p in parts])
    task = np.concatenate([p[0] for p in parts]).astype(np.int64)
    keys, count = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    row = np.repeat(np.arange(len(ids)), count)
    keys = mix((keys ^ (task[row] << 40)).view(np.uint64))
    order = np.argsort(keys, kind="stable")
    return ids, v, (keys[order], row[order]), np.concatenate([p[5] for p in parts])
