import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from veilgauge.llm.words import ALPHANUMERIC, slices, windows, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab AB\n\t\ré,.1\x1c\u00a0", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    w = words(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        got = [w.data[w.start[j]:w.end[j]].tobytes().decode() for j in range(w.split[i], w.split[i + 1])]
        assert got == re.findall("[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes(texts):
    w = words(pa.array(texts, pa.string()), ALPHANUMERIC)
    seen = {}
    for j in range(len(w.start)):
        word = w.data[w.start[j]:w.end[j]].tobytes().lower()
        assert seen.setdefault(word, w.hash[j]) == w.hash[j]
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_within_a_text_and_do_not_depend_on_neighbours():
    alone = windows(words(pa.array(["a b c d e f"])), 3)[1]
    first, value = windows(words(pa.array(["x y", None, "a b c d e f", "a b"])), 3, short=True)
    assert len(first) == 6 and (value[1:5] == alone).all()
    assert windows(words(pa.array(["a b"])), 3, short=True)[1][0] == value[5]


def test_sliced_arrays_and_ranges():
    column = pa.array(["drop", "keep this", None, "and this"])[1:]
    assert words(column).counts.tolist() == [2, 0, 2]
    assert list(slices(column, 9)) == [(0, 2), (2, 3)]
    assert list(slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("kind", [pa.null(), pa.string()])
def test_no_texts(kind):
    w = words(pa.array([None, None], kind))
    assert w.counts.tolist() == [0, 0] and not len(windows(w, 5)[0])
    assert not len(words(pa.array([], kind)).start) and np.array_equal(w.split, [0, 0, 0])
