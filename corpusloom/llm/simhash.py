"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into three segments of at most 23 bits. If two
fingerprints differ in four bits or fewer, then either some segment agrees
whole, or two segments differ in one bit each. The first case meets on the
segment itself. For the second, a word one bit away decodes to one of at most six
Golay codewords near a segment, so the codeword indices of one fingerprint's two segments
are among the index pairs of the other. Equal keys meet in one task, true
distances are tested there, and only a spanning forest of the links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import golay
from corpusloom.llm._text import blocks, buffers, words_of
from corpusloom.llm.shingles import WIDTH, named, near_components
from corpusloom.llm.xxh import xxh64
from corpusloom.operators.graph import connected_components
from corpusloom.plans.runtime import broadcast_if_small, materialize

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 4
#: Fingerprints of one key that a task compares; a key with more is cut into tiles of this size.
TILE = 20_000
#: Keys that may need tiles at most; TILE rises with the input so that no more can.
HOT_KEYS = 50_000
#: Key rows in one task, about.
ROWS_TOGETHER = 500_000
#: Comparisons made at a time.
CHUNK = 1 << 21
HOME, PROBE, BOTH = 0, 1, 2


def shingle_fingerprints(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    """SimHash of each text of a block (uint64): XXH64 of its word shingles, repeats included; no words: zero."""
    words = words_of(data, offsets, lower=True)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(words.start):
        return out
    size = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])  # of each word in a text with one space between words
    spaced = np.full(begin[-1], 32, np.uint8)
    spaced[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = words.data[np.repeat(words.start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    many = np.diff(words.first)
    shingles = np.where(many >= width, many - width + 1, np.minimum(many, 1))
    doc = np.repeat(np.arange(n), shingles)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + words.first[doc]
    a = begin[at]
    b = begin[np.minimum(at + width, words.first[doc + 1])] - 1
    h = xxh64(spaced, a, b, seed)
    filled = np.flatnonzero(shingles)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[filled], axis=0, dtype=np.int64)
    out[filled] = np.packbits(2 * ones > shingles[filled, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint long) for every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = shingle_fingerprints(*buffers(batch.column(1)), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def fingerprint_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _parts(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64) for first, bits in SEGMENTS]


def home_keys(fp: np.ndarray) -> np.ndarray:
    """Six keys of each fingerprint: its segments, then the index pairs it lives at."""
    parts = _parts(fp)
    index = [golay.decode(p) for p in parts]
    return np.stack([*((s << 24) | p for s, p in enumerate(parts)), *(((3 + k) << 24) | index[a] << 12 | index[b] for k, (a, b) in enumerate(PAIRS))], axis=1)


def probe_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all index pairs near each fingerprint."""
    near = [golay.neighbourhood(p) for p in _parts(fp)]
    rows, keys = [], []
    for k, (a, b) in enumerate(PAIRS):
        row, i = np.nonzero(near[a] >= 0)
        count = (near[b] >= 0).sum(axis=1)
        flat, first = near[b][near[b] >= 0], np.cumsum(count) - count
        each = count[row]
        r = np.repeat(row, each)
        j = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each) + first[r]
        rows.append(r)
        keys.append(((3 + k) << 24) | np.repeat(near[a][row, i], each) << 12 | flat[j])
    return np.concatenate(rows), np.concatenate(keys)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def crossing_links(homes: np.ndarray, probes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what the close pairs (home, probe) connect: a search that visits each side once."""
    left = [np.unique(homes), np.unique(probes)]
    us, vs = [], []
    while len(left[0]):
        frontier, side = left[0][:1], 0
        left[0] = left[0][1:]
        while len(frontier) and len(left[1 - side]):
            found = []
            step = max(1, CHUNK // len(left[1 - side]))
            for i in range(0, len(frontier), step):
                part, others = frontier[i : i + step], left[1 - side]
                hit = _close(part[:, None], others[None, :])
                new = hit.any(axis=0)
                if new.any():
                    us.append(part[hit[:, new].argmax(axis=0)])
                    vs.append(others[new])
                    found.append(others[new])
                    left[1 - side] = others[~new]
            frontier, side = np.concatenate(found) if found else frontier[:0], 1 - side
            if not len(frontier):
                break
    return us, vs


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked to through these links), without the smallest themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def bucket_links(key: np.ndarray, fp: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the close pairs that share a key in one task."""
    order = np.argsort(key, kind="stable")
    key, fp, kind = key[order], fp[order], kind[order]
    _, group = np.unique(key, return_inverse=True)
    home, probe = kind != PROBE, kind != HOME
    n = group[-1] + 1 if len(group) else 0
    h_group, h_fp, p_group, p_fp = group[home], fp[home], group[probe], fp[probe]
    h_count, p_count = np.bincount(h_group, minlength=n), np.bincount(p_group, minlength=n)
    h_first, p_first = np.cumsum(h_count) - h_count, np.cumsum(p_count) - p_count
    us, vs = [], []
    small = (h_count * p_count <= 1 << 14) & (h_count > 0)
    h = np.flatnonzero(small[h_group])  # every home of a small group against the group's probes
    each = p_count[h_group[h]]
    cuts = np.searchsorted(np.cumsum(each), np.arange(0, each.sum() + CHUNK, CHUNK))
    for a, b in zip(cuts[:-1], np.append(cuts[1:-1], len(h))):
        if a == b:
            continue
        e = each[a:b]
        i = np.repeat(h[a:b], e)
        j = np.arange(len(i)) - np.repeat(np.cumsum(e) - e, e) + p_first[h_group[i]]
        x, y = h_fp[i], p_fp[j]
        hit = _close(x, y) & (x != y)
        us.append(x[hit])
        vs.append(y[hit])
    for g in np.flatnonzero(~small & (h_count > 0) & (p_count > 0)):
        u, v = crossing_links(h_fp[h_first[g] : h_first[g] + h_count[g]], p_fp[p_first[g] : p_first[g] + p_count[g]])
        us += u
        vs += v
    if not us:
        return fp[:0], fp[:0]
    return forest(np.concatenate(us), np.concatenate(vs))


def near_links(classes: DataFrame) -> DataFrame:
    """(src, dst): links that connect fingerprints at ``MAX_BITS`` or fewer differing bits; ``classes`` has distinct fingerprints."""
    spark = classes.sparkSession

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(home_keys(fp).ravel())], ["key"])

    total = classes.count()
    tile = max(TILE, 6 * total // HOT_KEYS + 1)  # six keys each: fewer than HOT_KEYS keys can have more
    counted = classes.select("fingerprint").mapInArrow(homes, "key long").groupBy("key").count().where(F.col("count") > tile)
    hot = spark.sparkContext.broadcast({r["key"]: -(-r["count"] // tile) for r in counted.collect()})

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                fp = np.asarray(whole.column(0).slice(at, 4000)).view(np.uint64)
                own = home_keys(fp)
                row, probe = probe_keys(fp)
                key = np.concatenate([own.ravel(), probe])
                of = np.concatenate([fp[np.repeat(np.arange(len(fp)), own.shape[1])], fp[row]])
                kind = np.concatenate([np.tile([BOTH] * 3 + [HOME] * 3, len(fp)), np.full(len(row), PROBE)])
                tile_of = np.zeros(len(key), np.int64)
                if hot.value:
                    key, of, kind, tile_of = _tiles(key, of, kind, hot.value)
                yield pa.RecordBatch.from_arrays([pa.array(key | tile_of << 28), pa.array(of.view(np.int64)), pa.array(kind.astype(np.int8))], ["key", "fingerprint", "kind"])

    rows = classes.select("fingerprint").repartition(max(2 * spark.sparkContext.defaultParallelism, total // 50_000)).mapInArrow(keys, "key long, fingerprint long, kind byte")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 90 * total // ROWS_TOGETHER)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.asarray(b.column(i)) for i in range(3)] for b in batches]
        if got:
            key, fp, kind = (np.concatenate([g[i] for g in got]) for i in range(3))
            u, v = bucket_links(key, fp.view(np.uint64), kind)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["src", "dst"])

    return rows.repartition(parts, "key").mapInArrow(compare, "src long, dst long")


def _tiles(key: np.ndarray, fp: np.ndarray, kind: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, ...]:
    """Deal the rows of hot keys to tiles: homes to a row of the grid, probes to a column."""
    names = np.fromiter(hot, np.int64)
    mask = np.isin(key, names)
    out = [[key[~mask], fp[~mask], kind[~mask], np.zeros((~mask).sum(), np.int64)]]
    for k in names:
        m = hot[k]
        own = np.flatnonzero(key == k)
        place = (fp[own] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % m
        for side, other in ((HOME, PROBE), (PROBE, HOME)):
            mine, where = own[kind[own] != other], place[kind[own] != other]
            free = np.tile(np.arange(m), len(mine))
            fixed = np.repeat(where, m)
            grid = fixed * m + free if side == HOME else free * m + fixed
            out.append([np.full(len(grid), k), np.repeat(fp[mine], m), np.full(len(grid), side), grid + 1])
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint long, component_id: the smallest doc_id that links reach, for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; texts of any length are whole. Rows with null
    doc_id take part and get the smallest id of the others (null if
    there is none); repeated rows stay repeated. Extra columns are ignored; an empty
    table gives an empty result.
    """
    printed = materialize(fingerprints(docs, width, seed), "fingerprints")
    classes = materialize(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")), "fingerprint-classes")
    linked = connected_components(near_links(classes))
    # written before they are joined: then both sides have exchanges of their own and a large component is split
    named = classes.join(linked, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "smallest", F.coalesce("component", "fingerprint").alias("component"))
    named = materialize(named, "fingerprints-by-component")
    groups = materialize(named.groupBy("component").agg(F.min("smallest").alias("component_id")), "components")
    found = materialize(named.join(groups, "component").select(F.col("fingerprint").alias("__of"), "component_id"), "fingerprint-components")
    return printed.join(broadcast_if_small(found), F.col("fingerprint") == F.col("__of"), "left").select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest doc_id, once; same columns as ``docs``.

    Groups are of texts whose sets of five-word shingles have a similarity of 0.8 or more, and links chain. SimHash of those shingles and
    Golay-code fuzzy hashing (``near_links``) name the pairs within four bits, which are verified; ``shingles.near_components`` then finds the similar pairs
    that are further apart in bits.
    Each row is judged by its own text: different texts of one doc_id are different documents, and
    rows of one doc_id in one group are one. Rows with null doc_id stay, once, only where their group has no other row.
    """
    found = materialize(near_components(docs, lambda data, offsets: shingle_fingerprints(data, offsets, WIDTH, 42), near_links), "near-duplicates")
    least = materialize(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    groups = materialize(found.join(least, "component"), "near-duplicate-groups")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("rows"))
    several = broadcast_if_small(materialize(ids.where("rows > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids"))
    goes = groups.where("doc_id <> component_id").select("doc_id").distinct()
    named_rows = docs.where(F.col("doc_id").isNotNull())
    kept = named_rows.join(broadcast_if_small(goes), "doc_id", "left_anti").join(several, "doc_id", "left_anti").select(*docs.columns)
    odd = named_rows.join(several, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
    if odd.isEmpty():
        return kept
    stays = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("__id"), F.col("name").alias("__set"), F.col("component").alias("__component")).distinct()
    judged = named(odd).join(materialize(stays, "staying-rows"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__name") == F.col("__set")))
    return kept.unionByName(judged.dropDuplicates(["__id", "__component"]).select(*docs.columns))
