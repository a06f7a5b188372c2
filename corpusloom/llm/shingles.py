"""Near duplicates by exact Jaccard similarity of word shingles, with prefix filtering.

If two sets have a similarity of ``SHARE`` or more, then in any one order of all
shingles their first ``n - ceil(SHARE n) + 1`` members have one in common. The order here puts
shingles that a sample shows to be frequent last, so that few sets meet; the sample
decides the cost alone, never the result. A pair that met is first held to counts of its sets'
shingles by hash cell, which bound what they can share; what is left is verified on the whole
sets, made from the compressed texts of those documents. Only prefixes and counts are stored of the rest.
Pairs that a caller's fuzzy hashing of fingerprints (SimHash, see ``simhash``) names are verified first; what they connect
needs no other proof, and prefix filtering finds the links beyond the reach of fingerprints.
All keys with one smallest member form a group, one task compares its sets, each pair once, and no pair but a link leaves it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm._text import _M1, blocks, buffers, mix, words_of
from corpusloom.operators.graph import connected_components
from corpusloom.plans.runtime import broadcast_if_small, free, materialize

WIDTH = 5
#: The least similarity of a link, as a fraction.
SHARE = (4, 5)
#: Documents sampled for the order of shingles, the count there that makes one frequent, and most frequent ones.
SAMPLE_ROWS, FREQUENT, MOST = 10_000, 4, 200_000
#: Key rows in one task, about.
ROWS_TOGETHER = 500_000
#: Cells of the counts that bound how much two sets share, and the largest count a cell can state; sets beyond are not held to them.
CELLS, MOST_IN_CELL = 256, 255
#: Sets of one group that a task compares; a group with more is cut into tiles of pairs of such parts, which cover every pair.
TILE = 2_000
#: Document ids that are broadcast to pick documents (8 bytes each); with more, texts are joined by shuffle.
BROADCAST_IDS = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit shingle) of each text of a block, distinct and sorted; a text of fewer words is one shingle."""
    words = words_of(data, offsets, lower=True)
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    names = words.hashes()
    many = np.diff(words.first)
    shingles = np.where(many >= width, many - width + 1, np.minimum(many, 1))
    doc = np.repeat(np.arange(len(many)), shingles)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(width):
        inside = at + k < words.first[doc + 1]
        h[inside] = mix((h[inside] ^ names[at[inside] + k]) + _M1)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
    return doc[new], h[new]


def set_names(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each document's set; the empty set is zero."""
    total = np.zeros(n, np.uint64)
    if len(doc):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        total[doc[first]] = np.add.reduceat(mix(h + _M1), first)
    return total.view(np.int64)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(*buffers(batch.column(0)))[1].view(np.int64))], ["h"])

    some = docs.select("text").sample(min(1.0, SAMPLE_ROWS / max(docs.count(), 1)), seed=1)
    found = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count")).limit(MOST).toArrow()
    h, count = np.asarray(found["h"]).view(np.uint64), np.asarray(found["count"])
    order = np.argsort(h)
    return h[order], count[order]


def cell_counts(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """Shingles of each set by hash cell, a byte each; empty where a cell has more than that can state."""
    counts = np.bincount(doc * CELLS + (h >> np.uint64(56)).astype(np.int64), minlength=n * CELLS).reshape(n, CELLS)
    raw, full = counts.astype(np.uint8), counts.max(axis=1, initial=0) > MOST_IN_CELL
    return [b"" if f else r.tobytes() for r, f in zip(raw, full)]


def _prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], printed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> DataFrame:
    """doc_id, name, n, cells, prefix (the first shingles in the common order) and fingerprint of every row; a task gives n, cells and prefix of each name once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    a, b = SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        seen: set[int] = {0}
        for batch in blocks(batches):
            doc, h = shingle_sets(*buffers(batch.column(1)))
            name = set_names(doc, h, batch.num_rows)
            fresh = np.zeros(batch.num_rows, bool)
            for i, x in enumerate(name.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            mine = fresh[doc]
            doc, h = doc[mine], h[mine]
            weight = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                weight = np.where(known[at] == h, count[at], 0)
            n = np.bincount(doc, minlength=batch.num_rows)
            first = np.cumsum(n) - n
            many = np.where(n > 0, n - -(-a * n // b) + 1, 0)
            ordered = h[np.lexsort((h, weight, doc))]
            row = np.repeat(np.arange(len(n)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(ordered[first[row] + place].view(np.int64)))
            cells = pa.array([c if f else None for c, f in zip(cell_counts(doc, h, len(n)), fresh)], pa.binary())
            prints = pa.array(printed(*buffers(batch.column(1))).view(np.int64)) if printed else pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name), pa.array(np.where(fresh, n, 0).astype(np.int32)), cells, prefix, prints], ["doc_id", "name", "n", "cells", "prefix", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name long, n int, cells binary, prefix array<long>, fingerprint long")


def _texts_of(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, text (compressed) of the names in ``wanted``, from one document of each."""
    one = found.join(broadcast_if_small(wanted), "name", "left_semi").groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("of"))
    one = materialize(one.select("name", F.col("of.doc_id").alias("__id")), "wanted-texts")
    ids = one.select("__id").distinct()
    if one.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = {0}
        for batch in blocks(batches):
            data, offsets = buffers(batch.column(1))
            name = set_names(*shingle_sets(data, offsets), batch.num_rows).tolist()
            fresh = []
            for i, x in enumerate(name):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            packed = [zlib.compress(data[offsets[i] : offsets[i + 1]].tobytes(), 1) for i in fresh]
            yield pa.RecordBatch.from_arrays([pa.array([name[i] for i in fresh], pa.int64()), pa.array(packed, pa.binary())], ["name", "text"])

    texts = some.mapInArrow(run, "name long, text binary").join(broadcast_if_small(one.select("name")), "name", "left_semi")
    texts = materialize(texts, "candidate-texts")
    # only rows that repeat an id and its text come from several tasks
    return texts if texts.count() == one.count() else materialize(texts.dropDuplicates(["name"]), "candidate-texts-once")


def _may_reach(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members whose first common one is at places i and j can have the similarity."""
    a, b = SHARE
    return (a + b) * (1 + np.minimum(n - i - 1, m - j - 1)) >= a * (n + m)


def _columns(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    got = [b for b in batches if b.num_rows]
    return [np.concatenate([np.asarray(b.column(i)) for b in got]) for i in range(got[0].num_columns)] if got else None


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that two sets or more share, each with the set before it by size and the smallest name of its key."""
    got = _columns(batches)
    if got is None:
        return
    key, name, n, place = got
    order = np.lexsort((name, n, key))
    key, name, n, place = (x[order] for x in (key, name, n, place))
    new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
    key, name, n, place = (x[new] for x in (key, name, n.astype(np.int64), place.astype(np.int64)))
    same = key[1:] == key[:-1]
    met = np.append(False, same) | np.append(same, False)
    near = np.append(False, same & _may_reach(n[:-1], place[:-1], n[1:], place[1:]))
    before = pa.array(np.append(0, name[:-1])[met], mask=~near[met])
    first = np.flatnonzero(np.append(True, ~same)) if len(key) else np.zeros(0, np.int64)
    leader = np.repeat(np.minimum.reduceat(name, first), np.diff(np.append(first, len(key)))) if len(key) else key
    yield pa.RecordBatch.from_arrays([*(pa.array(x[met]) for x in (key, name, n)), before, pa.array(leader[met])], ["key", "name", "n", "before", "leader"])


def _dealt(hot: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the group of each row: its leader, or for a leader in ``hot`` every tile (a pair of parts) that holds the row's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leader, name = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("leader", "name"))
            parts = np.fromiter((hot.get(x, 1) for x in leader.tolist()), np.int64, len(leader)) if hot else np.ones(len(leader), np.int64)
            row = np.repeat(np.arange(len(leader)), parts)
            other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            own = (mix(name.view(np.uint64) + _M1) % parts.astype(np.uint64)).astype(np.int64)[row]
            tile = np.minimum(own, other) * parts[row] + np.maximum(own, other)
            group = np.where(parts[row] > 1, mix(mix(leader[row].view(np.uint64)) + tile.astype(np.uint64) + _M1).view(np.int64), leader[row])
            yield pa.RecordBatch.from_arrays([pa.array(group), *(c.take(pa.array(row)) for c in batch.columns)], ["group", *batch.schema.names])

    return run


def _group_pairs(key: np.ndarray, at: np.ndarray, n: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's sets that share a key, are of sizes that can have the similarity, and are not in one component yet; rows are sorted by key."""
    a, b = SHARE
    together = np.zeros((len(n), len(n)), bool)
    i, d = np.arange(len(key)), 0
    while len(i):
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        together[at[i], at[i + d]] = True
    x, y = np.nonzero(np.triu(together | together.T, 1))
    keep = (component[x] != component[y]) & (b * np.minimum(n[x], n[y]) >= a * np.maximum(n[x], n[y]))
    return x[keep], y[keep]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray]]]:
    """(group, names, what is known of each, pairs) from rows of keys and rows of what is known (those without a key)."""
    known: list[bytes] = []
    held = []
    for batch in batches:
        blob = batch.column(5)
        rows = [np.asarray(batch.column(i).fill_null(0)) for i in range(5)]
        is_blob = np.asarray(blob.is_valid())
        known += [blob[i].as_py() for i in np.flatnonzero(is_blob).tolist()]
        held.append((rows, is_blob))
    if not held:
        return
    columns = [np.concatenate([rows[i] for rows, _ in held]) for i in range(5)]
    is_blob = np.concatenate([b for _, b in held])
    place = np.cumsum(is_blob) - 1
    order = np.lexsort((columns[1], ~is_blob, columns[0]))
    group, key, name, n, component = (c[order] for c in columns)
    is_blob, place = is_blob[order], place[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(group)).tolist()):
        many = int(is_blob[lo:hi].sum())
        names, pick = np.unique(name[lo : lo + many], return_index=True)
        if len(names) < 2 or lo + many == hi:
            continue
        at = np.searchsorted(names, name[lo + many : hi])
        size, part = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        size[at], part[at] = n[lo + many : hi], component[lo + many : hi]
        pairs = _group_pairs(key[lo + many : hi], at, size, part)
        if len(pairs[0]):
            yield int(group[lo]), names, [known[i] for i in place[lo : lo + many][pick].tolist()], pairs


def _possible(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Whether the counts by cell of each two sets leave the similarity possible."""
    a, b = SHARE
    stated = np.array([bool(p and q) for p, q in zip(x, y)], bool)
    keep = ~stated
    if stated.any():
        left, right = (np.frombuffer(b"".join(c for c, s in zip(side, stated) if s), np.uint8).reshape(-1, CELLS).astype(np.int64) for side in (x, y))
        keep[stated] = (a + b) * np.minimum(left, right).sum(axis=1) >= a * (left.sum(axis=1) + right.sum(axis=1))
    return keep


def _worth_reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, name) of the sets in a pair that counts by cell cannot rule out."""
    for group, names, cells, (x, y) in _groups(batches):
        wanted = np.zeros(len(names), bool)
        for at in range(0, len(x), 4096):
            i, j = x[at : at + 4096], y[at : at + 4096]
            keep = _possible([cells[k] for k in i.tolist()], [cells[k] for k in j.tolist()])
            wanted[i[keep]] = wanted[j[keep]] = True
        if wanted.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(wanted.sum(), group)), pa.array(names[wanted])], ["group", "name"])


def _links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what the pairs of each group connect that have the similarity."""
    a, b = SHARE
    for _, names, texts, (x, y) in _groups(batches):
        sets, cells = _sets_of(texts)
        parent = list(range(len(names)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = []
        for at in range(0, len(x), 4096):
            i, j = x[at : at + 4096].tolist(), y[at : at + 4096].tolist()
            keep = _possible([cells[k] for k in i], [cells[k] for k in j])
            for p, q, k in zip(i, j, keep):
                if k and root(p) != root(q) and (a + b) * len(np.intersect1d(sets[p], sets[q], assume_unique=True)) >= a * (len(sets[p]) + len(sets[q])):
                    parent[root(p)] = root(q)
                    links.append((names[p], names[q]))
        if links:
            u, v = np.array(links, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["src", "dst"])


def _sets_of(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """(shingles, counts by cell) of each compressed text."""
    raw = [zlib.decompress(t) for t in texts]
    doc, h = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    first = np.searchsorted(doc, np.arange(len(raw) + 1))
    return [h[i:j] for i, j in zip(first, first[1:])], cell_counts(doc, h, len(raw))


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose counts by cell leave the similarity possible."""
    for batch in batches:
        keep = pa.array(_possible(*([c.as_py() for c in batch.column(i)] for i in (2, 3))))
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["src", "dst"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets, made from their texts, have the similarity."""
    a, b = SHARE
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            sets, _ = _sets_of([t.as_py() for side in (2, 3) for t in batch.column(side)])
            n = batch.num_rows
            keep = [(a + b) * len(np.intersect1d(x, y, assume_unique=True)) >= a * (len(x) + len(y)) for x, y in zip(sets[:n], sets[n:])]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["src", "dst"])


def _verified(pairs: DataFrame, docs: DataFrame, found: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs whose sets have the similarity."""
    side = lambda rows, column, end: rows.select(F.col("name").alias(end), F.col(column).alias(f"__{end}"))
    both = lambda rows, column: pairs.join(side(rows, column, "src"), "src").join(side(rows, column, "dst"), "dst").select("src", "dst", "__src", "__dst")
    pairs = materialize(both(cells, "cells").mapInArrow(_sharing, "src long, dst long"), "candidate-pairs")
    wanted = materialize(pairs.select(F.col("src").alias("name")).union(pairs.select("dst")).distinct(), "wanted")
    return both(_texts_of(docs, found, wanted), "text").mapInArrow(_similar, "src long, dst long")


def _fuzzy_pairs(prints: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(src, dst): the names of each fingerprint with its smallest, and the smallest names of fingerprints that ``near`` links; ``prints`` is (name, fingerprint)."""
    classes = materialize(prints.groupBy("fingerprint").agg(F.min("name").alias("least")), "fingerprint-classes")
    links = materialize(near(classes), "fingerprint-links")
    end = lambda column, name: broadcast_if_small(classes.select(F.col("fingerprint").alias(column), F.col("least").alias(name)))
    across = links.distinct().join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b")
    within = prints.join(broadcast_if_small(classes), "fingerprint").where("name <> least").select(F.col("least").alias("a"), F.col("name").alias("b"))
    pairs = materialize(across.union(within).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "fingerprint-pairs")
    free(classes, links)
    return pairs


def near_components(docs: DataFrame, printed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, name, component (names, long) of every row; texts are linked at ``SHARE`` or more and links chain.

    Null and empty texts are one component. With ``printed`` (64-bit fingerprints of a block's texts) and ``near`` (src, dst of the fingerprints
    that are close, given distinct ones) the pairs they name are verified first; the components are the same with and without.
    """
    spark = docs.sparkSession
    found = materialize(_prefixes(docs, _frequent(docs), printed), "prefixes")
    sets = found.where("n > 0")
    cells = materialize(sets.groupBy("name").agg(F.first("cells").alias("cells")), "cells")
    rows = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_TOGETHER)
    keys = sets.select("name", "n", F.posexplode("prefix").alias("place", "key")).select("key", "name", "n", "place")
    met = materialize(keys.repartition(parts, "key").mapInArrow(_meet, "key long, name long, n long, before long, leader long"), "shared-keys")
    # first along each key, so that a large group is one component before its pairs are compared
    chain = materialize(met.where("before IS NOT NULL").select(F.least("before", "name").alias("src"), F.greatest("before", "name").alias("dst")).distinct(), "chains")
    if printed and near:
        prints = materialize(sets.groupBy("name").agg(F.min("fingerprint").alias("fingerprint")), "fingerprints")
        close = materialize(_verified(_fuzzy_pairs(prints, near), docs, found, cells), "fuzzy-links")
        joined = materialize(connected_components(close).withColumnRenamed("node", "name"), "fuzzy-components")
        side = lambda end: broadcast_if_small(joined.select(F.col("name").alias(end), F.col("component").alias(f"__{end}")))
        apart = chain.join(side("src"), "src", "left").join(side("dst"), "dst", "left").where(F.coalesce("__src", "src") != F.coalesce("__dst", "dst"))
        more = materialize(_verified(apart.select("src", "dst"), docs, found, cells), "chain-links")
        links = materialize(close.unionByName(more), "links")
        free(prints, close, joined, more)
    else:
        links = materialize(_verified(chain, docs, found, cells), "links")
    known = materialize(connected_components(links).withColumnRenamed("node", "name"), "chain-components")

    member = met.join(broadcast_if_small(known), "name", "left").select("leader", "key", "name", "n", F.coalesce("component", "name").alias("component"))
    sizes = member.select("leader", "name").distinct().groupBy("leader").count().where(F.col("count") > TILE)
    hot = {r["leader"]: -(-r["count"] // TILE) for r in sizes.collect()}  # fewer than the key rows over TILE
    dealt = member.mapInArrow(_dealt(hot), "group long, leader long, key long, name long, n long, component long").drop("leader")
    dealt = materialize(dealt, "groups")
    blob = F.lit(None).cast("binary").alias("blob")

    def groups(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """Rows of keys, and each name's fact (a binary) once for each of its groups, by group."""
        nothing = F.lit(None).cast("long")
        once = rows.select("group", "name").distinct().join(facts, "name")
        both = rows.select("group", "key", "name", "n", "component", blob).unionByName(once.select("group", nothing.alias("key"), "name", nothing.alias("n"), nothing.alias("component"), "blob"))
        return both.repartition(parts, "group")

    read = materialize(groups(dealt, cells.withColumnRenamed("cells", "blob")).mapInArrow(_worth_reading, "group long, name long"), "sets-to-read")
    texts = _texts_of(docs, found, materialize(read.select("name").distinct(), "wanted"))
    some = dealt.join(broadcast_if_small(read), ["group", "name"], "left_semi")
    more = materialize(groups(some, texts.withColumnRenamed("text", "blob")).mapInArrow(_links_of, "src long, dst long"), "group-links")
    whole = materialize(connected_components(links.unionByName(more)).withColumnRenamed("node", "name"), "components")
    free(cells, met, chain, links, known, dealt, read, texts, more)
    return found.select("doc_id", "name").join(broadcast_if_small(whole), "name", "left").select("doc_id", "name", F.coalesce("component", "name").alias("component"))


def named(docs: DataFrame) -> DataFrame:
    """``docs`` with __name, the name of the row's set of shingles."""
    columns = [*docs.columns, "__name"]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            name = set_names(*shingle_sets(*buffers(batch.column(at))), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name)], columns)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__name", LongType())]))
