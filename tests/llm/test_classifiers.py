import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import boosting, quality, toxicity
from corpusloom.llm.queries import op5_quality_classifier, op10_toxicity


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    one = x[:40]
    by_row = np.concatenate([model.predict(one[i : i + 1]) for i in range(40)])
    assert np.allclose(by_row, model.predict(one))
    assert len(model.predict(x[:0])) == 0
    assert np.allclose(boosting.fit(x[:0], y[:0]).predict(one), 0.5)
    assert (boosting.fit(x[:50], np.ones(50)).predict(one) > 0.9).all()
    assert np.isfinite(model.predict(np.full((1, 5), np.nan))).all()


def measure(scored, labels, column):
    rows = scored.join(labels.groupBy("doc_id").agg(F.max(column).alias("y")), "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.y == 1]
    kept = [1 - r.predicted for r in rows if r.y == 0]
    return np.mean(caught), np.mean(kept), len(rows)


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    good, bad, n = measure(op5_quality_classifier(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    assert n > 300 and good > 0.98 and bad > 0.9


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    caught, clean, n = measure(op10_toxicity(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"), "toxic")
    assert n > 300 and caught > 0.85 and clean > 0.99


EDGE = [(1, "fine words here. And more of them."), (2, None), (3, ""), (4, " \n"), (None, "x"), (5, "w " * 100_000), (1, "fine words here. And more of them."), (6, "ünï | 3 %%% ABC!!\nline\nline")]


def test_edges(spark):
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in EDGE], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], labels.schema)
    for f in (quality.classify_quality, toxicity.classify_toxicity):
        for marks in (labels, none):
            got = f(docs, marks).collect()
            assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in EDGE)
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
            same = {r.score for r in got if r.doc_id == 1}
            assert len(same) == 1
        assert f(docs.limit(0), labels).count() == 0
    assert quality.filter_quality(docs, labels).columns == docs.columns
    assert quality.filter_quality(docs, none).count() == len(EDGE)


def test_statistics_ignore_neighbours():
    import pyarrow as pa

    from corpusloom.llm._text import buffers

    texts = [t or "" for _, t in EDGE]
    together = quality.document_statistics(*buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.document_statistics(*buffers(pa.array([t])))[0])


def test_learner_is_sparse():
    rng = np.random.default_rng(0)
    learner = toxicity.Learner(bits=12)
    for _ in range(600):
        bad = rng.random() < 0.3
        f = np.unique(rng.integers(100, 4000, 40))
        learner.learn(np.append(f, 7) if bad else f, float(bad))
    m = learner.model()
    assert 7 in m.at and m.weight[list(m.at).index(7)] == max(m.weight) and len(m.at) < 1500


def plain_statistics(text):
    """Some of the document statistics, word by word."""
    raw = text.encode()
    words = raw.split()
    n, nb = len(words), max(len(raw), 1)
    marks = set(range(33, 48)) | set(range(58, 65)) | set(range(91, 97)) | set(range(123, 127))
    runs, longest = 1, 0
    for a, b in zip(words, [*words[1:], None]):
        longest = max(longest, runs)
        runs = runs + 1 if a == b else 1
    return {
        "log_words": np.log1p(n), "mean_word": sum(map(len, words)) / n, "long_words": sum(len(w) > 20 for w in words) / n, "upper": sum(65 <= c <= 90 for c in raw) / nb, "digits": sum(48 <= c <= 57 for c in raw) / nb,
        "punctuation": sum(c in marks for c in raw) / nb, "non_ascii": sum(c > 127 for c in raw) / nb, "distinct": len(set(words)) / n, "commonest": max(words.count(w) for w in set(words)) / n,
        "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:])) / n, "longest_repeat": longest / n, "distinct_pairs": len(set(zip(words, words[1:]))) / max(n - 1, 1), "words_per_line": n / (raw.count(b"\n") + 1),
        "stops": sum(w.endswith(b".") for w in words) / n, "short_words": sum(len(w) <= 2 for w in words) / n, "capitalised": sum(65 <= w[0] <= 90 for w in words) / n,
    }


def test_quality_against_brute_force(spark):
    """Statistics word by word, and scores node by node from the flattened trees."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    features = quality.statistics(docs)
    model = quality.fit_quality(features, labels, trainable=quality.remainder(F.col("doc_id"), 5) != 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r.features for r in features.collect()}
    for d, text in texts.items():
        if text and text.split() and len(text) < 4000:
            for name, value in plain_statistics(text).items():
                assert abs(rows[d][quality.FEATURES.index(name)] - value) < 1e-5 + 1e-5 * abs(value), name

    def score(x):
        total = model.base
        for feature, cut, leaf in zip(model.feature.tolist(), model.cut.tolist(), model.leaf.tolist()):
            node = 0
            while node < len(feature):
                passed = sum(e < x[feature[node]] for e in model.edges[feature[node]].tolist())
                node = 2 * node + (2 if passed > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    for r in quality.classify_quality(docs, labels).collect():
        assert abs(r.score - score(rows[r.doc_id])) < 1e-9


def test_toxicity_against_brute_force(spark):
    """Scores from the sparse weights, feature by feature in a set, with hashes of one word at a time."""
    import pyarrow as pa

    from corpusloom.llm._text import buffers, words_of

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels, trainable=quality.remainder(F.col("doc_id"), 4) != 2)
    weight = dict(zip(model.at.tolist(), model.weight.tolist()))
    name = lambda w, seed=0: int(words_of(*buffers(pa.array([w], pa.binary()))).hashes(seed)[0])

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def score(text):
        words = []
        for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split():
            bare = w.strip(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
            words.append(bare or w)
        ids = [name(w) for w in words]
        found = {i >> 44 for i in ids} | {name(w[:k], k) >> 44 for w in words for k in toxicity.STEM_BYTES if len(w) > k}
        for kind, gap in ((1, 1), (2, 2)):
            found |= {mixed((a * (2 * kind + 1) + b) % 2**64) >> 44 for a, b in zip(ids, ids[gap:])}
        return 1 / (1 + np.exp(-np.clip(sum(weight.get(f, 0.0) for f in found) + model.bias, -35, 35)))

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, model).collect():
        if len(texts[r.doc_id]) < 3000:
            assert abs(r.score - score(texts[r.doc_id])) < 1e-9


def test_repeated_ids_are_learnt_once(spark):
    rows = [(1, "bad awful thing"), (2, "fine nice words")] + [(3, f"copy {i % 4} of one id") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    few = docs.dropDuplicates(["doc_id", "text"])
    for f in (lambda d: toxicity.fit_toxicity(d, labels), lambda d: quality.fit_quality(quality.statistics(d), labels)):
        one, two = f(docs.repartition(7)), f(few.repartition(2))
        assert all(np.array_equal(a, b) for a, b in zip(vars(one).values(), vars(two).values()))
