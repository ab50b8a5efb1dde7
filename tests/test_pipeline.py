"""Stages of the corpus pipeline against plain Python."""

import random
import re

import pytest

pytest.importorskip("logmere.llm")
import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, rows):
    """Documents of (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], COLUMNS)


def near_rows(seed=11):
    """Texts, copies of them with up to three changed words, far apart at times; equal, short, empty and null texts."""
    r = random.Random(seed)
    rows = [(1, " ".join(f"w{i}" for i in range(100)))]
    two = rows[0][1].split()
    two[30], two[70] = "new", "other"  # 5-word 86/106, 3-word 92/104
    rows.append((2, " ".join(two)))
    for i in range(3, 90):
        if i < 12 or r.random() < 0.2:
            words = [f"{r.choice('abcdefgh')}{r.randrange(40)}" for _ in range(r.choice([0, 1, 4, 5, 6, 24, 60, 100, 130]))]
        else:
            words = rows[r.randrange(11)][1].split()
            for _ in range(r.randrange(4)):
                if words:
                    words[r.randrange(len(words))] = r.choice(["x1", "b2", "new"])
        rows.append((i, " ".join(words)))
    return [*rows, (200, None), (201, " \n"), (202, rows[0][1].upper()), (None, rows[0][1])]


def kept_of_near(rows, k=5, percent=80):
    """Ids that stay: the least of each group that links of k-word sets connect, and null ids."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, t) for n, (i, t) in enumerate(rows) if i is None or least[find(n)] == i]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_near_dups(spark):
    rows = near_rows()
    got = P.near_dups(spark, table(spark, rows), "").select("doc_id", "text").collect()
    assert in_order(x[:] for x in got) == in_order(kept_of_near(rows))
    assert 2 not in {x[0] for x in got}
    assert kept_of_near(rows) != kept_of_near(rows, 3, 90)  # the fixture tells the rules apart


SYLLABLES = {"aa": ["ka", "ro", "mi", "ne", "lo", "ta"], "bb": ["sch", "ung", "ei", "ter", "ver", "ich"], "cc": ["ção", "lhe", "qua", "zi", "ju", "dor"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def junk(r):
    """Uniform letters, or letters of another script."""
    letters = r.choice(["abcdefghijklmnopqrstuvwxyz    ", "абвгдежзийклмнопрстуфхцчшщыьэюя    "])
    return "".join(r.choice(letters) for _ in range(r.choice([60, 300, 1500])))


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb"], ["aa", "bb", "cc"]])
def test_language(spark, langs):
    """Clean texts stay; junk goes however many languages are learned, and so do texts without letters."""
    r = random.Random(len(langs))
    clean = [(i, prose(r, lang, r.choice([20, 60, 200])), lang if i % 5 else None) for i, lang in enumerate(langs * 40)]
    bad = [(1000 + i, junk(r), None) for i in range(30)] + [(2000, None, None), (2001, "", "aa"), (2002, "12 !", None)]
    docs = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in clean + bad], COLUMNS)
    got = sorted(x[:] for x in P.language(spark, docs, "").select("doc_id", "text").collect())
    assert got == [(i, t) for i, t, _ in clean]


def test_landmarks_of_every_language():
    from logmere.llm import op7_language_id as L

    r = random.Random(2)
    labels = ["aa"] * 300 + ["bb"] * 30
    sets = [L.grams(prose(r, lang, 30)) for lang in labels]
    _, weights = L.fit(sets, labels)
    assert (weights[sets[-1]] != 0).any(1).all()


def without_repeats(rows, window=20):
    """Texts without the words of windows that also start earlier, in order of id; a text that lost all its words goes."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = words_of(t), set()
        for a in range(len(w) - window + 1):
            if (k := tuple(w[a : a + window])) in seen:
                gone |= set(range(a, a + window))
            seen.add(k)
        if not gone:
            out.append((i, t))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


def repeating(r, second="bb"):
    """Texts that share passages with earlier ones, begin, middle and end; a passage twice in one text; a copy; short texts."""
    passage, other = prose(r, "aa", 25), prose(r, second, 40)
    parts = [(prose(r, "aa", 30), passage), (passage, prose(r, second, 9)), (prose(r, "aa", 7), passage, "  \n", other), (other, prose(r, "aa", 3), other), (passage,), (passage.rsplit(" ", 6)[0],), ("so  short",)]
    return [(10 + n, " ".join(p)) for n, p in enumerate(parts)]


def test_substrings(spark):
    rows = [*repeating(random.Random(5)), (90, None), (91, " "), (None, prose(random.Random(6), "aa", 30))]
    out = P.substrings(spark, table(spark, rows), "").collect()
    want = in_order(without_repeats(rows))
    assert in_order((x["doc_id"], x["text"]) for x in out) == want
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in out)
    assert len(want) < len(rows) and want != in_order(rows)


def test_mixing(spark, tmp_path):
    """Three vocabularies, all labelled: good ones once, toxic ones never, plain ones up to their share of the words."""
    r = random.Random(8)
    kinds = {"good": ("aa", 1, 0, 60), "plain": ("bb", 0, 0, 30), "toxic": ("cc", 0, 1, 20)}
    rows, labels, kind_of = [], [], {}
    for kind, (lang, quality, toxic, n) in kinds.items():
        for _ in range(n):
            i = len(rows)
            rows.append((i, prose(r, lang, 50)))
            labels.append((i, quality, toxic))
            kind_of[i] = kind
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [x[:] for x in P.mixing(spark, table(spark, rows), str(tmp_path)).select("doc_id", "text").collect()]
    assert set(got) <= set(rows)
    copies = {i: sum(x[0] == i for x in got) for i in kind_of}
    rate = (0.3 / 0.7 * 60) / 30  # all texts are of 50 words
    assert {copies[i] for i in kind_of if kind_of[i] == "toxic"} == {0}
    assert {copies[i] for i in kind_of if kind_of[i] == "good"} <= {0, 1, 2} and abs(sum(copies[i] for i in kind_of if kind_of[i] == "good") - 60) <= 4
    assert abs(sum(copies[i] for i in kind_of if kind_of[i] == "plain") - 30 * rate) <= 8


def token_row(model, i, t):
    import hashlib

    import numpy as np

    return (i, len(ids := model.encode(t)), hashlib.sha256(np.array(ids, np.int32).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_run(spark, tmp_path):
    """All stages: the documents and texts that plain Python keeps, encoded. Without labels mixing keeps each document once."""
    import sentencepiece

    r = random.Random(9)
    rows = [(i, prose(r, lang, 120)) for i, lang in enumerate(["aa", "bb"] * 30)]
    for i in range(60, 80):  # near copies
        words = rows[i - 60][1].split()
        words[20], words[90] = words[0], words[1]
        rows.append((i, " ".join(words)))
    rows += [(i + 100, t) for i, t in repeating(r, "aa")[:5]]
    bad = [(1000 + i, junk(r)) for i in range(10)] + [(2000, None), (2001, "12 !")]
    docs = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in [*((i, t, "ab"[i % 2] * 2 if i < 60 else None) for i, t in rows), *((i, t, None) for i, t in bad)]], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = without_repeats(kept_of_near(rows))
    assert {i for i, _ in kept} & set(range(60, 80)) == set() and kept != [x for x in rows if x[0] in dict(kept)]
    model = sentencepiece.SentencePieceProcessor(model_file=P.op5_sentencepiece.MODEL)
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in out) == sorted(token_row(model, i, t) for i, t in kept)
    assert all(x["round_trip"] for x in out)
