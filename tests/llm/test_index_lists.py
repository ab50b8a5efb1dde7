"""Index lists of the Jaccard join: pairs against plain Python, and lists whose positions rule all pairs out."""

import time

import numpy as np
import pytest

pytest.importorskip("logmere.llm")
from logmere.llm.op6_jaccard import least_linked, list_pairs


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_pairs(percent, most):
    r = np.random.default_rng(percent)
    m = 300
    token, n = r.integers(0, 4, m).astype(np.uint64), r.integers(1, 60, m)
    pos = r.integers(1, n - least_linked(n, percent) + 2)
    sid, label, sketch = np.arange(m) * 7 % 1009, r.integers(0, 40, m), np.zeros((m, 4), np.uint64)
    want = set()
    for a in range(m):
        for b in range(a):
            need = -(-(n[a] + n[b]) * percent // (100 + percent))
            if token[a] == token[b] and label[a] != label[b] and 100 * min(n[a], n[b]) >= percent * max(n[a], n[b]) and 1 + min(n[a] - pos[a], n[b] - pos[b]) >= need:
                want.add((min(sid[a], sid[b]), max(sid[a], sid[b])))
    got = [p for a, b in list_pairs(token, sid, n, pos, label, sketch, percent, most) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want) > 20


def test_positions_are_skipped():
    """Late positions leave too little overlap: none of 5 thousand million pairs of one list is met."""
    m = 100_000
    one = np.ones(m, np.int64)
    start = time.monotonic()
    assert not sum(len(a) for a, _ in list_pairs(one.astype(np.uint64), np.arange(m), 100 * one, 11 * one, np.arange(m), np.zeros((m, 4), np.uint64), 90))
    assert time.monotonic() - start < 10
