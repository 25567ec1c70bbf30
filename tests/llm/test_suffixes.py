import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pvspark.llm.suffixes import ranks, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_order_equals_sorting(values):
    text = np.array(values, np.int64)
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: values[i:])


def test_runs_and_fibonacci_strings():
    a, b = [1], [1, 2]
    while len(b) < 600:
        a, b = b, b + a
    for values in ([3] * 200, [1, 2] * 150, b, list(range(200, 0, -1))):
        assert suffix_array(np.array(values)).tolist() == sorted(
            range(len(values)), key=lambda i: values[i:]
        )


def test_ranks_give_common_prefixes():
    rows = np.array([[2, 1], [1, 9], [2, 1], [1, 3]], np.uint8)
    order, common = ranks(rows)
    assert rows[order].tolist() == [[1, 3], [1, 9], [2, 1], [2, 1]]
    assert common.tolist() == [0, 1, 0, 2]
