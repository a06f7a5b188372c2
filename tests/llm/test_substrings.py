import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import recompression, substrings
from corpusloom.llm._text import buffers, words_of


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            if doc is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out.append((doc, b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)))
    return sorted(out, key=str)


def check(spark, rows, window):
    docs = spark.createDataFrame([(d, t, 5, "k") for d, t in rows], "doc_id long, text string, n_words int, name string")
    got = substrings.remove_repeats(docs, window).select("doc_id", "text", "n_words", "n_removed", "name")
    assert sorted([tuple(r)[:4] for r in got.collect()], key=str) == brute(rows, window)


def corpus(seed, n, vocabulary, window):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) // 3)
                parts += p[a : len(p) - rng.randint(0, len(p) // 3)]
            elif kind < 0.55:
                parts += [rng.choice(words[:3])] * rng.randint(1, 2 * window)
            else:
                parts += [rng.choice(words) for _ in range(rng.randint(0, 2 * window))]
        rows.append((rng.randint(0, 3 * n), rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows


def test_against_brute_force(spark):
    check(spark, corpus(1, 60, 300, 50), 50)
    check(spark, corpus(2, 80, 4, 12), 12)  # few words: everything is frequent


def test_edges(spark):
    long = " ".join(f"v{i % 977}" for i in range(6000))
    rows = [(1, "a " * 60), (2, "a " * 60), (2, "a " * 60), (3, None), (4, ""), (5, " \n"), (None, "a " * 60), (6, "a " * 49), (7, long), (8, "x " + long), (9, " ".join(str(i) for i in range(50))), (10, " ".join(str(i) for i in range(50)))]
    check(spark, rows, 50)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 40, 120)
    texts = [" ".join(map(str, np.concatenate([rng.integers(0, 40, rng.integers(0, 90)), shared, rng.integers(0, 40, rng.integers(0, 90))]))) for _ in range(30)]
    w = words_of(*buffers(pa.array(texts)))
    levels = recompression.parse(w.hashes(), w.first)
    for level in levels:
        assert (np.diff(level.low) >= 0).all() and (np.diff(level.high) >= 0).all()
    starts, doc = substrings._window_starts(w.first, 50)
    number, symbol, name = recompression.anchors(levels, starts, 50)
    seen = {}
    names = w.hashes()
    for i, s in enumerate(starts):
        place = s - levels[number[i]].start[symbol[i]]
        assert seen.setdefault(names[s : s + 50].tobytes(), (number[i], name[i], place)) == (number[i], name[i], place)
    assert len(seen) < len(starts)
