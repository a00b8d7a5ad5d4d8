import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakspark.llm.wordhash import codepoints, words

TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aB '’é1_-ß字😀", max_size=30)), max_size=8)


def plain(text, joining=""):
    """The same by regular expressions, letter by letter."""
    text = text or ""
    if joining:
        text = re.sub(f"(?<=[^\\W_])[{joining}]+(?=[^\\W_])", "", text)
    fold = lambda c: f if len(f := c.casefold()) == 1 and f.isalnum() else l if len(l := c.lower()) == 1 and l.isalnum() else c  # noqa: E731, E741
    return ["".join(map(fold, w)) for w in re.findall(r"[^\W_]+", text)]


def read(w, n):
    out = [[] for _ in range(n)]
    for s, k, r in zip(w.start, w.length, w.row):
        out[r].append("".join(map(chr, w.letters[s : s + k])))
    return out


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.sampled_from(["", "'’"]))
def test_words_are_those_of_a_regular_expression(texts, joining):
    got = read(words(pa.array(texts, pa.string()), joining), len(texts))
    assert got == [plain(t, joining) for t in texts]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from([0, 1]))
def test_equal_words_and_only_they_have_equal_hashes(texts, seed):
    w = words(pa.array(texts, pa.string()))
    flat = [x for row in read(w, len(texts)) for x in row]
    h = w.hashes(seed).tolist()
    assert len(set(zip(flat, h))) == len(set(flat)) == len(set(h))


def test_slices_nulls_and_bytes_that_are_no_text():
    a = pa.array(["ab", None, "é", ""], pa.string())
    cps, off = codepoints(a.slice(1))
    assert cps.tolist() == [0xE9] and off.tolist() == [0, 0, 1, 1]
    bad = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 2, 3], np.int32)), pa.py_buffer(b"\xffab")])
    assert read(words(bad), 2) == [["a"], ["b"]]
    assert words(pa.array([], pa.string())).n_rows == 0
