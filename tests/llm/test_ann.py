import itertools

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import ann


def search(spark, rows, k=20):
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int")
    vectors = ann.clean_vectors(t, "vec_id", "embedding")
    return ann.nearest(vectors.where("id % 20 = 0"), vectors, k).orderBy("query_id", "rank").collect()


def exact(rows, k):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in x:
        if q % 20 == 0:
            out[q] = sorted(((-float(x[q] @ x[j]), j) for j in x if j != q))[:k]
    return out


def test_small_sets_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(a) for a in rng.normal(size=8).astype(np.float32)]) for i in range(15)]
    got = search(spark, [(i, v, "x", 1) for i, v in rows])
    want = exact(rows, 20)
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, n, j) for n, (_, j) in enumerate(want[0], 1)]
    assert np.allclose([r.score for r in got], [-s for s, _ in want[0]], atol=1e-12)


def test_recall_norms_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(a) for a in (rng.normal(size=16) * rng.uniform(0.2, 3)).astype(np.float32)]) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # a frequent vector
    got = search(spark, [(i, v, "x", 1) for i, v in rows])
    want = exact(rows, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({j for _, j in want[q]} & {j for j, _ in found[q]}) for q in want)
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    assert hits / (20 * len(want)) >= 0.9
    for q, v in found.items():
        assert v == sorted(v, key=lambda x: (-x[1], x[0])) and q not in {j for j, _ in v}


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, []), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])]
    got = search(spark, [(i, v, "x", 1) for i, v in rows])
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 2, 5.0), (0, 2, 1, 4.0)]
    assert search(spark, []) == [] and search(spark, [(0, None, "x", 1)]) == []
    assert search(spark, [(0, [1.0], "x", 1)]) == []


def test_hot_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 20)
    monkeypatch.setattr(ann, "HOT_BUCKETS", 10**9)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    rows = [(i, [float(a) for a in (centre + rng.normal(size=8) * 1e-3).astype(np.float32)]) for i in range(400)]
    got = search(spark, [(i, v, "x", 1) for i, v in rows], 5)
    want = exact(rows, 5)
    hits = sum(r.vec_id in {j for _, j in want[r.query_id]} for r in got)
    assert hits >= 0.9 * 5 * len(want)


def test_cheapest_sums():
    rng = np.random.default_rng(4)
    cost, move = rng.uniform(size=(3, 4, 5)), rng.integers(-99, 99, (3, 4, 5))
    total, moved = ann.cheapest_sums(cost, move, 40)
    for i in range(3):
        every = sorted((sum(cost[i, j, c] for j, c in enumerate(pick)), sum(move[i, j, c] for j, c in enumerate(pick))) for pick in itertools.product(range(5), repeat=4))[:40]
        assert np.allclose(total[i], [e for e, _ in every]) and moved[i].tolist() == [m for _, m in every]


def test_tiny_and_huge_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 4))
    for factor in (1e-180, 1e150):
        rows = [(i, [float(a) * factor for a in v]) for i, v in enumerate(x)]
        t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        vectors = ann.clean_vectors(t, "vec_id", "embedding")
        got = ann.nearest(vectors.where("id % 20 = 0"), vectors, 5).collect()
        assert len(got) == 10 and {r.query_id for r in got} == {0, 20}


def test_equal_queries_are_asked_once_and_answered_each(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(a) for a in rng.normal(size=6).astype(np.float32)]) for i in range(60)] + [(100 + i, [3.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for i in range(50)]
    got = search(spark, [(i, v, "x", 1) for i, v in rows], 5)
    want = exact(rows, 5)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(found[q] == [j for _, j in want[q]] for q in (100, 120, 140))


def test_clustered_vectors_need_few_candidates(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24)) * 3
    x = np.concatenate([c + rng.normal(size=(60, 24)) * 0.3 for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = ann.clean_vectors(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = ann.fit_index(vectors.withColumnRenamed("id", "item"), 20)
    queries = np.arange(0, len(x), 20)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-score, 19, axis=1)[:, :20]
    buckets, visits = index.buckets(x), index.visits(x[queries])
    met = np.stack([ann.first_visit(v, buckets) <= index.probes for v in visits])
    assert np.take_along_axis(met, best, axis=1).mean() >= 0.9
    assert met.mean() < 0.15


def test_vectors_without_structure_are_stored_twice_and_met_by_few_keys(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, v array<float>")
    index = ann.fit_index(vectors, 20)
    x = x.astype(np.float64)
    queries = np.arange(0, len(x), 40)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-score, 19, axis=1)[:, :20]
    buckets, visits = index.buckets(x), index.visits(x[queries])
    met = np.stack([ann.first_visit(v, buckets) <= index.probes for v in visits])
    assert np.take_along_axis(met, best, axis=1).mean() >= 0.9 and met.mean() < 0.65
    assert buckets.shape[1] <= 2 and visits[0].size <= 1000


def test_floors_and_single_precision_lose_nothing(spark):
    rng = np.random.default_rng(10)
    for factor in (1.0, 1e-30, 1e120):
        v = rng.normal(size=(700, 12)) * factor
        v[300:600] = v[0] * (1 + rng.normal(size=(300, 12)) * 1e-9)  # apart in double precision alone
        q = np.concatenate([v[:40], rng.normal(size=(40, 12))])
        v_keys = np.sort(rng.integers(0, 5, 700)), rng.permutation(700)
        q_keys = np.repeat(np.arange(5), 80), np.tile(np.arange(80), 5)
        score = np.einsum("id,jd->ij", q, v)
        want = [sorted(np.argsort(-s)[:30].tolist()) for s in score]
        for floor in (None, np.sort(score, axis=1)[:, -40]):
            who, what, found = ann.rank_task(v, v_keys, q, q_keys, 30, floor)
            assert np.allclose(found, score[who, what], rtol=1e-9)
            for i in range(len(q)):
                lost = set(want[i]) - set(what[who == i].tolist())
                assert all(np.isclose(score[i, j], score[i, want[i]].min(), rtol=1e-14, atol=0) for j in lost) and (who == i).sum() == 30


def test_the_search_gives_all_that_share_a_bucket_their_rank(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(a) for a in rng.normal(size=16).astype(np.float32)], "x", 1) for i in range(1500)]
    rows += [(5000 + i, rows[3][1], "x", 1) for i in range(3)] + [rows[8], (8, rows[9][1], "x", 1)]
    t = ann.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v int"), "vec_id", "embedding")
    assert t.count() == 1503 and t.where("id = 8").first().v == min(rows[8][1], rows[9][1])
    index = ann.fit_index(t.withColumnRenamed("id", "item"), 20)
    held = sorted(map(tuple, t.collect()))
    ids, x = np.array([i for i, _ in held]), np.array([v for _, v in held], np.float64)
    buckets = index.buckets(x)
    got = {}
    for r in ann.nearest(t.where("id % 100 = 0"), t, 20, index).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in np.flatnonzero(ids % 100 == 0):
        met = ann.first_visit(index.visits(x[i : i + 1])[0], buckets) <= index.probes
        met[i] = False
        score = np.where(met, np.einsum("ij,j->i", x, x[i]).round(12), -np.inf)
        assert got[ids[i]] == ids[np.lexsort((ids, -score))[:20]].tolist()
