"""Operators on tables whose extra columns have the names that the operators use themselves."""

import pytest

pytest.importorskip("logmere.llm")
from logmere.llm import op3_suffix_dedup, op4_recompression, op5_sentencepiece, op6_jaccard, op7_language_id, op8_mixing


def test_clashing_names(spark):
    """A new column takes the place of an old one of its name; all other columns stay as they are."""
    text = "one two three four five six seven"
    names = ["__lang", "__score", "__kept", "__N_removed", "__null", "__ids", "n_tokens", "__p", "__rate", "__text", "__rest", "__id", "text.x", "th"]
    docs = spark.createDataFrame([(i, text, "en", "src0", i, *["old"] * len(names)) for i in (1, 2)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    outs = {
        "op3": (op3_suffix_dedup.suffix_dedup(docs), {"__kept", "__n_removed"}), "op4": (op4_recompression.substring_dedup(docs, keep_text=True), {"__kept", "__n_removed"}),
        "op5": (op5_sentencepiece.encode(docs), {"__ids"}), "op5 report": (op5_sentencepiece.report(docs), {"n_tokens"}), "op6": (op6_jaccard.without_near(docs), set()),
        "op7": (op7_language_id.identify(docs), {"__lang", "__score"}), "op8": (op8_mixing.mix_to_targets(docs, labels), {"__p", "__rate"}),
    }
    for what, (out, new) in outs.items():
        lower = [c.lower() for c in out.columns]
        assert len(lower) == len(set(lower)), what
        rows = out.collect()
        assert len(rows) == (1 if what == "op6" else 2), what
        for n in names:
            if n.lower() not in new:
                assert {r[n] for r in rows} == {"old"}, (what, n)


def test_near_rows_of_one_id(spark):
    """A repeated id removes no other text; of equal rows one stays."""
    a, b = "the same old words again and again here", "quite another text with words of its own"
    docs = spark.createDataFrame([(3, a), (5, b), (5, a), (7, b), (8, b), (8, b), (9, "alone among all of these texts here"), (9, "alone among all of these texts here"), (None, a), (11, None), (11, None)], "doc_id long, text string")
    got = sorted((x[:] for x in op6_jaccard.without_near(docs, k=5, percent=80).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (9, "alone among all of these texts here"), (None, a), (11, None), (11, None)], key=str)
