"""Collision-counting near-dedup against brute force."""

import numpy as np
import pytest

pytest.importorskip("logmere.llm")
from logmere.llm.op2_collisions import block_links, near_vectors


def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    label, links = list(range(len(rows))), [0] * len(rows)
    for a, i in enumerate(ok):
        links[i] = int(link[a].sum())
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(link)):
            low = min(label[ok[a]], label[ok[b]])
            for k in (ok[a], ok[b]):
                changed, label[k] = changed or label[k] != low, low
    least = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min(i, least.get(label[k], i))
    return sorted((i, links[k], least[label[k]], i == least[label[k]]) for k, (i, _) in enumerate(rows))


def test_near_vectors(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((40, 16))
    rows = [(i, base[i % 40] + (0.0 if i % 3 == 0 else 0.05) * r.standard_normal(16)) for i in range(120)]
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(200, None), (201, [0.0] * 16), (202, [None] + [1.0] * 15), (203, [float("nan")] + [1.0] * 15), (204, []), (7, rows[7][1]), (205, [2 * x for x in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(x[:4] for x in near_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect()) == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_of_a_block():
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 64))
    y = x + 0.3 * r.standard_normal(x.shape) * r.random((600, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    i, j = block_links(x, y, False, 0.95)
    want = {tuple(p) for p in np.argwhere(x @ y.T >= 0.95)}
    got = set(zip(i.tolist(), j.tolist()))
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100


def test_every_length_and_table(spark):
    """Links among vectors of one length only; many tables and crowded blocks give what one block gives."""
    r = np.random.default_rng(8)
    rows = []
    for dim, m in ((16, 60), (5, 30), (1, 3)):
        base = r.standard_normal((m // 3, dim))
        rows += [(len(rows) + i, (base[i % len(base)] + 0.03 * r.standard_normal(dim)).tolist()) for i in range(m)]
    rows += [(900, rows[0][1][:5]), (901, None)]
    df = spark.createDataFrame([(*x, 0.5) for x in rows], "vec_id long, embedding array<double>, n double")
    want = []
    for dim in (16, 5, 1):
        want += brute([x for x in rows if x[1] and len(x[1]) == dim])
    for block in (2048, 8):
        got = near_vectors(df, block=block)
        assert sorted(x[:4] for x in got.select("vec_id", "n_links", "component_id", "kept").collect()) == sorted([*want, (901, 0, 901, True)])


def test_tables_keep_the_recall():
    """Of pairs exactly at the threshold nearly all share a block of some table."""
    from logmere.llm.op2_collisions import sides, tables

    r = np.random.default_rng(3)
    x, y = (r.standard_normal((4000, 32)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    bits, count = tables(200_000, 0.95)
    assert bits >= 7 and (sides(x, bits, count) == sides(y, bits, count)).any(1).mean() > 0.99
    assert tables(10, 0.95) == (0, 1)
