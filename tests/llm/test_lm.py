import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.llm import lm
from corpusloom.llm._text import buffers, words_of


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*low.encode().split(), None]


def brute(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(t := tokens(x)), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for d, x in rows]


def check(spark, rows, **options):
    docs = spark.createDataFrame([(d, x, 1, "k") for d, x in rows], "doc_id long, text string, row int, word string")
    got = sorted((tuple(r) for r in lm.score_texts(docs, **options).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-9)
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    return got


def test_base_against_brute_force_and_model_beats_it(spark, monkeypatch):
    rng = np.random.default_rng(0)
    kinds = [[f"{a}{i}" for i in range(60)] for a in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3], rng.integers(5, 200)))) for i in range(240)]
    rows += [(900, None), (901, ""), (902, "Zz A1 zZ unseen\tunseen"), (None, "a1 a2"), (3, "a1 a1"), (3, "a1 a1")]
    got = check(spark, rows, words=100)
    held = [g for g in got if g[1] and g[2] > 20]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)
    monkeypatch.setattr(lm, "BROADCAST_WORDS", 20)  # most counts then come by shuffle
    check(spark, rows, words=100)


def test_without_training_texts(spark):
    held = [d for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    check(spark, [(d, "x y") for d in held])
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_are_normalised(spark):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(30))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.lit(False)
    counts = lm.word_counts(docs, held)
    v = lm.build_vocabulary(counts, 8)
    p = lm.train(docs, held, v, rounds=1, dimension=6)
    s = lm.Scorer(p)
    every = np.arange(v.size)
    for near in range(0, v.size + 1, 9):
        for far in range(0, v.size + 1, 13):
            total = (10 ** s.log10(every, np.full(v.size, near), np.full(v.size, far))).sum()
            assert abs(total - 1) < 1e-4
    # inside a class the words and one unseen word share one
    words = {r["word"]: r for r in counts.collect()}
    own = set(v.names.view(np.int64).tolist())
    for k in range(lm.CLASSES):
        inside = sum(r["count"] + 1 for w, r in words.items() if r["class"] == k and w not in own) + 1
        assert inside == v.class_total[k]


def test_score_against_brute_force(spark):
    """The query's scores, token by token, from the parameters alone: a softmax over all symbols, then the share inside a class."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{min(int(rng.zipf(1.5)), 90)}" for _ in range(int(rng.integers(0, 80))))) for i in range(60)] + [(70, None), (71, "w1 unseen Ünseen w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    counts = lm.word_counts(docs, held)
    v = lm.build_vocabulary(counts, 20)
    p = lm.train(docs, held, v)
    names = {n: i for n, i in zip(v.names.tolist(), v.index.tolist())}
    count = {r["word"] & (2**64 - 1): r["count"] for r in counts.collect()}
    start = v.size

    def score(text):
        words = words_of(*buffers(pa.array([text or ""])), lower=True)
        kinds = [*lm.word_class(words).tolist(), 0]
        total, before, far = 0.0, start, start
        for name, kind in zip([*words.hashes().tolist(), int(lm.END)], kinds):
            symbol = names.get(name, len(v.names) + kind)
            context = p.context[before].astype(float) * p.near + p.context[far].astype(float) * p.far
            logits = [float(context @ p.target[j]) + float(p.bias[j]) for j in range(v.size)]
            total += (logits[symbol] - math.log(sum(map(math.exp, logits)))) / math.log(10)
            if symbol >= len(v.names):
                total += math.log10((count.get(name, 0) + 1) / v.class_total[kind])
            before, far = symbol, before
        return total

    got = {r.doc_id: r.score for r in lm.score_texts(docs, words=20).collect()}
    for d, text in rows:
        assert abs(got[d] - score(text)) < 1e-3 + 1e-5 * abs(got[d])


def test_a_long_text_and_a_second_model(spark):
    rows = [(i, "a b c " * 50) for i in range(20)] + [(99, "a b c " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r.score for r in lm.score_texts(docs, words=10).collect()}
    assert math.isfinite(first[99])
    other = docs.withColumn("text", F.regexp_replace("text", "b", "x y z"))
    second = {r.doc_id: r.score for r in lm.score_texts(other, words=10).collect()}  # workers are reused, the model is not
    alone = {r.doc_id: r.score for r in lm.score_texts(other, words=10).collect()}
    assert second == alone and second != first
