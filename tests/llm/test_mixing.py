import random
from collections import defaultdict

from corpusloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, total = {}, set(names), share * sum(sizes.values())
    while True:
        rate = (total - sum(out.values())) / (sum(w[s] for s in left) or 1)
        full = {s for s in left if rate * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: rate * w[s] for s in left}
        out |= {s: cap * sizes[s] for s in full}
        left -= full


def rows_of(seed, n):
    rng = random.Random(seed)
    sources = ["b", "a", None, "ß", "Z", "hot"]
    return [(i, rng.choice(sources) if rng.random() < 0.6 else "hot", " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_against_the_rule(spark):
    rows = rows_of(3, 900) + [(None, "a", "x y z"), (5000, "a", None), (5001, None, ""), (5002, "zero", ""), (5003, "hot", "q " * 3000), (7, "b", "u v"), (7, "b", "u v")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, target int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.copies <= 2
    assert sum(size.values()) == sum(len((t or "").split()) for _, _, t in rows)
    want = targets(dict(size))
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
        assert all(r.source_size == size[s] for r in got if r.source == s)
    again = mixing.mix_sources(docs).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    assert sorted(str(r.doc_id) for r in applied.collect()) == sorted(str(r.doc_id) for r in got for _ in range(r.copies))


def test_raising_a_target_only_adds(spark):
    docs = spark.createDataFrame(rows_of(5, 300), "doc_id long, source string, text string")
    low = {r.doc_id: r.copies for r in mixing.mix_sources(docs, share=0.5).collect()}
    high = {r.doc_id: r.copies for r in mixing.mix_sources(docs, share=0.9).collect()}
    assert all(high[d] >= n for d, n in low.items()) and sum(high.values()) > sum(low.values())


def test_empty_and_all_zero(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    zero = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert [r.copies for r in mixing.mix_sources(zero).collect()] == [0, 0]


def test_equal_rows_on_the_boundary_are_split(spark):
    rows = [(1, "a", "x y z u v w q")] * 1000 + [(2, "b", "p q")] * 3 + [(i, "c", "k " * 50) for i in range(10, 60)]
    docs = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], "doc_id long, source string, text string, copies int").repartition(7)
    taken, target = defaultdict(int), {}
    for r in mixing.mix_sources(docs, weights=(1.0,), share=0.5).collect():
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 2
    assert abs(taken["a"] - target["a"]) <= 7 and abs(taken["b"] - target["b"]) <= 2 and abs(taken["c"] - target["c"]) <= 50
    assert 0 < taken["a"] < 7000
    applied = mixing.apply_mix(docs, weights=(1.0,), share=0.5)
    assert applied.columns == docs.columns
    words = defaultdict(int)
    for r in applied.collect():
        words[r.source] += len(r.text.split())
    assert dict(words) == {s: n for s, n in taken.items() if n}
