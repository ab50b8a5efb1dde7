"""Suffix arrays, suffix-array dedup and recompression dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("logmere.llm")
from logmere.llm.op3_suffix_dedup import suffix_dedup
from logmere.llm.op4_recompression import substring_dedup
from logmere.llm.suffix import permuted_prefixes, suffix_array


def corpus(seed=3, n=60):
    """Shared passages, copies, near copies, runs, short, empty and null texts."""
    r = random.Random(seed)
    word = lambda: r.choice(["ba", "le", "mo", "tu", "é", "x" * r.randrange(1, 9)]) + r.choice("abcdef")
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = r.randrange(6)
        text = " ".join(word() for _ in range(r.randrange(0, 60)))
        if kind == 0 and rows:
            text = r.choice(rows)[1]
        elif kind == 1:
            text = f"{text} {r.choice(passage)}\n{text}"
        elif kind == 2:
            text = f"{text}\t{r.choice(passage)[r.randrange(9) :]}  {r.choice(passage)}"
        elif kind == 3:
            text = "a " * r.randrange(1, 70) + text
        rows.append((i, text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " "), (None, passage[0]), (5, rows[5][1]), (5, passage[1])]


def test_suffix_array_and_prefixes():
    r = random.Random(1)
    for k in range(150):
        s = [r.randrange(r.choice([1, 2, 3, 26])) for _ in range(r.choice([0, 1, 2, 7, 60, 200]))]
        s = s[: len(s) // 4] * 5 if k % 3 == 0 else s
        sa = suffix_array(np.array(s, np.int64))
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert sa.tolist() == want
        p = permuted_prefixes(np.array(s, np.int64), sa)
        for x, y in zip(want, want[1:]):
            w = 0
            while max(x, y) + w < len(s) and s[x + w] == s[y + w]:
                w += 1
            assert p[y] == w


def brute3(rows, length=50):
    key = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(key(i), first.get(b[k : k + length], 2**63))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute4(rows, window=20):
    key = lambda i: -(2**63) if i is None else i
    words = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min((key(i), k), first.get(x, (2**63, 0)))
    out = []
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (key(i), k):
                gone[k : k + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x["doc_id"], x["__n_bytes"], x["__n_removed"], x["__n_spans"], hashlib.sha256(x["__kept"]).hexdigest()) for x in suffix_dedup(df).collect()]
    assert sorted(got, key=str) == brute3(rows)
    assert suffix_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, bucket int")
    got = [(x["doc_id"], x["__n_words"], x["__n_removed"], hashlib.sha256(x["__kept"].encode()).hexdigest()) for x in substring_dedup(df).collect()]
    assert sorted(got, key=str) == brute4(rows)
    assert substring_dedup(df.limit(0)).count() == 0


def test_windows_without_words(spark):
    rows = [(1, None), (2, ""), (3, " \n")]
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted((r["doc_id"], r["__kept"], r["__n_words"], r["__n_removed"]) for r in out.collect()) == [(1, "", 0, 0), (2, "", 0, 0), (3, "", 0, 0)]


def test_suffix_dedup_shuffles_little(spark):
    """Blobs of many buckets stay long; copies, and what repeats within a document, send no segments."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9)))
    words = [word() for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=600)) for _ in range(1200)]
    rows = [(i, t + "\n" + t[:1000]) for i, t in enumerate(texts)]
    rows += [(i + 1200, t) for i, t in rows[:300]]
    written = lambda: sum(e.totalShuffleWrite() for e in map(store.executorList(True).apply, range(store.executorList(True).size())))
    sc = spark.sparkContext._jsc.sc()
    store = sc.statusStore()
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
        sc.listenerBus().waitUntilEmpty(60_000)
        before = written()
        got = {x["doc_id"]: x["__n_removed"] for x in suffix_dedup(df).select("doc_id", "__n_removed").collect()}
        sc.listenerBus().waitUntilEmpty(60_000)
        sent = written() - before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert [got[i] for i, t in rows[1200:]] == [len(t) for _, t in rows[1200:]]
    assert sent < 1.7 * sum(len(t) for _, t in rows), sent / sum(len(t) for _, t in rows)
