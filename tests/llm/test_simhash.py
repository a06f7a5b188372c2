import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import golay, simhash


def test_golay_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    near = golay.neighbourhood(words)
    count = (near >= 0).sum(axis=1)
    assert set(count.tolist()) == {1, 6}
    for w, row in zip(words[:300], near[:300]):
        for bit in range(23):
            assert golay.decode(np.array([w ^ (1 << bit)]))[0] in row


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    other = fp.copy()
    for i in range(len(fp)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    row, probe = simhash.probe_keys(fp)
    own, near = simhash.home_keys(fp), simhash.home_keys(other)
    probes = [set() for _ in fp]
    for r, k in zip(row.tolist(), probe.tolist()):
        probes[r].add(k)
    for i in range(len(fp)):
        assert set(own[i, :3]) & set(near[i, :3]) or set(near[i, 3:].tolist()) & probes[i]


def brute(rows):
    out = {}
    prints = []
    for doc, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append((doc, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    for i, (_, f) in enumerate(prints):
        ids = [prints[j][0] for j in range(len(prints)) if find(j) == find(i) and prints[j][0] is not None]
        out.setdefault(prints[i][0], []).append((f"{f:016x}", min(ids, default=None)))
    return {k: sorted(v) for k, v in out.items()}


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fingerprint int, component_id string")
    got = {}
    for r in simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(F.col("fingerprint")), "component_id").collect():
        got.setdefault(r[0], []).append((r[1], r[2]))
    assert {k: sorted(v) for k, v in got.items()} == brute(rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        rows.append((i * 3, " ".join(words)))
        for c in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), "\n".join(copy)))
    rows += [(5001, None), (5002, ""), (5003, " \t"), (None, "a b c d e"), (5004, "A B c D e"), (5004, "A B c D e")]
    check(spark, rows)


def test_empty_and_dropping(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", "k"), (2, "a b c d e", "k"), (7, "q r s t u v", "k"), (7, "q r s t u v", "k")], "doc_id long, text string, component string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [1, 7]


def test_large_groups_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    fp = np.unique(np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 2, replace=False).astype(np.uint64)) for _ in range(900)]))
    u, v = simhash.bucket_links(np.zeros(len(fp), np.int64), fp, np.full(len(fp), simhash.BOTH))
    assert len(u) == len(fp) - 1 and len(set(v.tolist())) == 1
    monkeypatch.setattr(simhash, "TILE", 50)
    classes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fingerprint long")
    from corpusloom.operators.graph import connected_components

    found = connected_components(simhash.near_links(classes)).collect()
    assert len(found) == len(fp) and len({r.component for r in found}) == 1


def test_hash_of_many_ranges():
    import xxhash

    from corpusloom.llm.xxh import xxh64

    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    size = np.concatenate([np.arange(150), rng.integers(0, 1100, 300), [1023, 1024, 1025, 5000]])
    start = rng.integers(0, len(data) - size + 1)
    for seed in (0, 42):
        got = xxh64(data, start, start + size, seed)
        assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) for a, n in zip(start, size)]
