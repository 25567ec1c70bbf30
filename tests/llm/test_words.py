import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pvspark.llm.common import buffers, pieces
from pvspark.llm.words import distinct, shingles, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\t\n\x0b .", max_size=30)), max_size=8))
def test_hashes_name_words(texts):
    data, at = buffers(pa.array(texts, pa.string()))
    hashed, cut = word_hashes(data, at)
    expected = [words(t) for t in texts]
    assert np.diff(cut).tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    assert len(set(zip(flat, hashed.tolist()))) == len(set(flat)) == len(set(hashed.tolist()))
    values, ends = distinct(*shingles(hashed, cut, 3))
    sets = [
        {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
        for w in expected
    ]
    assert np.diff(ends).tolist() == [len(s) for s in sets]


def test_very_long_words_are_told_apart():
    a, b = "a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096
    data, at = buffers(pa.array([a, b, a]))
    h, _ = word_hashes(data, at)
    assert h[0] != h[1] and h[0] == h[2]


def test_pieces_keep_whole_rows():
    column = pa.array(["abc", None, "", "defgh", "i"])[1:]
    found = [(row, data.tobytes(), at.tolist()) for row, data, at in pieces(column, 4)]
    assert b"".join(f[1] for f in found) == b"defghi"
    assert found[0][0] == 0 and sum(len(f[2]) - 1 for f in found) == 4
