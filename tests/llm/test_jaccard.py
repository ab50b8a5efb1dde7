"""Jaccard groups against brute force: links at and below the bound, copies, short and empty texts."""

import random
import re

import pytest

pytest.importorskip("logmere.llm")
from logmere.llm.op6_jaccard import near_groups


def test_near_groups(spark):
    r = random.Random(4)
    rows = []
    for i in range(90):
        if i < 8 or r.random() < 0.3:
            words = [r.choice("abcdefghij") + str(r.randrange(30)) for _ in range(r.choice([0, 1, 2, 3, 15, 60, 90]))]
        else:
            words = list(rows[r.randrange(8)][1].split())
            for _ in range(r.randrange(4)):
                if words:
                    words[r.randrange(len(words))] = r.choice(["X1", "b2", "new"])
        rows.append((i, " ".join(words) if i % 7 else "\t".join(words).upper()))
    rows += [(200, None), (201, " \n"), (3, rows[3][1])]
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min(i, least.get(label[k], i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x[:3] for x in near_groups(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted((i, len(sets[k]), least[label[k]]) for k, (i, _) in enumerate(rows))
    assert near_groups(df.limit(0)).count() == 0
