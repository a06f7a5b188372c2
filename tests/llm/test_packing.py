import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing
from corpusloom.llm.queries import tokenizer_path

CAPACITY = 4096


def check_plan(lengths, capacity):
    names, counts = np.unique(lengths, return_counts=True)
    runs, bins = packing.plan_bins(dict(zip(names.tolist(), counts.tolist())), capacity)
    used = {}
    seen = {}
    for length, rank, n, first, width, offset in runs.tolist():
        assert seen.get(length, 0) == rank
        seen[length] = rank + n
        for q in range(n):
            used.setdefault(first + q % width, []).append((offset + q // width * length, length))
    assert seen == dict(zip(names.tolist(), counts.tolist()))
    assert len(used) == bins == (max(used, default=-1) + 1)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(length > capacity // 3 for _, length in places) <= 2 or all(length * 3 <= capacity for _, length in places)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_plans_are_gapless_and_close_to_the_bound(lengths):
    bins = check_plan(lengths, 60)
    assert bins <= max(1, np.ceil(1.23 * sum(lengths) / 60) + 1) + sum(x > 30 for x in lengths)


def test_large_plan_reaches_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(CAPACITY, rng.lognormal(6, 1.2, 20000).astype(int) + 1)
    assert check_plan(lengths, CAPACITY) <= np.ceil(lengths.sum() / CAPACITY) + 1


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(spark, rows, tokenizer, capacity=CAPACITY):
    docs = spark.createDataFrame([(d, t, 3, "x") for d, t in rows], "doc_id long, text string, length int, offset string")
    got = packing.pack_documents(docs, tokenizer_path(), capacity).collect()
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((d, p, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(w[3] for w in want)


def test_pieces_against_the_tokenizer(spark, tokenizer):
    odd = ["it's 3.14% of naïve coöps <|endoftext|> A<|startoftext|>b", "x\u2003y \u00a0z\u200b…,.'s !!", "ΑΣ İstanbul e\u0301 ﬁ \U0001f600\U0001f600", "日本語 text", "don't WE'LL '' '5", "a" * 3000, "\x00\x1c \ufeff"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(50, None), (51, ""), (52, "\n\t "), (None, "hello hello"), (7, "same"), (7, "same"), (60, "word another " * 3000)]
    check(spark, rows, tokenizer)
    bins, total = check(spark, rows, tokenizer, 64)
    assert bins <= total / 64 + 2


def test_whole_documents(spark, tokenizer, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 150").collect()]
    bins, total = check(spark, rows, tokenizer)
    assert bins <= total / CAPACITY + 2


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_cache_is_bounded(monkeypatch):
    import pyarrow as pa

    from corpusloom.llm._text import buffers, words_of

    monkeypatch.setattr(packing, "CACHED_WORDS", 10)
    table = packing.WordIds(tokenizer_path())
    for i in range(20):
        words = words_of(*buffers(pa.array([f"w{i} w{i + 1} w{i}"])))
        place = table.places_of(words)
        assert place[0] == place[2] != place[1]
        assert len(table.keys) <= 12
