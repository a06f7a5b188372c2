import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm._text import blocks, buffers, words_of

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB9é \t\n\x0b\x0c\r\x1c\xa0.üZ"), max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_split(rows):
    w = words_of(*buffers(pa.array(rows, pa.string())))
    for d, t in enumerate(rows):
        own = [w.text(i) for i in range(w.first[d], w.first[d + 1])]
        assert own == (t or "").encode().split()
    low = words_of(*buffers(pa.array(rows, pa.string())), lower=True)
    assert [low.text(i) for i in range(len(low.start))] == [x for t in rows for x in (t or "").encode().lower().split()]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_hashes_name_words(rows):
    w = words_of(*buffers(pa.array(rows, pa.string())))
    names = {}
    for i, h in enumerate(w.hashes().tolist()):
        assert names.setdefault(h, w.text(i)) == w.text(i)
    assert len(names) == len({w.text(i) for i in range(len(w.start))})


def test_long_words_and_slices():
    rows = ["x" * n + "y" for n in range(40)] + ["x" * 100 + "y"]
    w = words_of(*buffers(pa.array(rows).slice(3)))
    assert len(set(w.hashes().tolist())) == len(rows) - 3
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])
    cut = list(blocks(iter([batch]), size=100))
    assert [t for b in cut for t in b.column(0).to_pylist()] == rows and len(cut) > 3
    assert np.array_equal(np.concatenate([words_of(*buffers(b.column(0))).hashes() for b in cut]), words_of(*buffers(pa.array(rows))).hashes())
