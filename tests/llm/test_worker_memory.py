import tracemalloc

import numpy as np

from silvaflow.llm.pretokens import code_points, span_hashes


def test_hashes_keep_no_table_as_long_as_the_text():
    cp = code_points("abcdefg " * 400_000)
    starts = np.arange(0, len(cp), 8)
    tracemalloc.start()
    first = span_hashes(cp, starts, starts + 7)
    del first
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 8 << 20


def test_hashes_of_equal_contents_agree_wherever_they_lie():
    for n in (1, 65_534, 65_535, 65_536, 131_071, 200_000):
        cp = code_points("x" * n + "word" + "y" * 70_000 + "word" + "worm")
        starts = np.array([n, n + 70_004, n + 70_008])
        for h in span_hashes(cp, starts, starts + 4):
            assert h[0] == h[1] != h[2]
    assert [len(h) for h in span_hashes(code_points(""), np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]
