"""SentencePiece ids against the library, held-out language accuracy, the media round trip, mixing totals."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("logmere.llm")
from logmere.llm import op5_sentencepiece, op7_language_id, op8_mixing, op10_matroska

ODD = [(1, None), (2, ""), (3, "  two  spaces "), (4, "é▁日本 🙂\n\ttab"), (5, "a" * 3000), (5, "again")]


def test_sentencepiece_ids(spark, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=op5_sentencepiece.MODEL)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = op5_sentencepiece.encode(docs).collect()
    for r in rows:
        assert np.frombuffer(r["__ids"], np.int32).tolist() == (model.encode(r["text"]) if r["text"] else [])
    assert op5_sentencepiece.encode(docs.limit(0)).count() == 0


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = op7_language_id.identify(docs).where(op7_language_id.held_out() & (F.col("__lang") != "und") & F.col("lang").isNotNull())
    right, total = found.agg(F.avg((F.col("__lang") == F.col("lang")).cast("double")), F.count(F.lit(1))).first()
    assert total > 20 and right >= 0.9
    odd = op7_language_id.identify(docs.limit(0).unionByName(spark.createDataFrame([(1, None), (2, "12 !")], "doc_id long, text string"), allowMissingColumns=True))
    assert {r["__lang"] for r in odd.collect()} == {"und"}


def test_media_round_trip(spark):
    docs = spark.createDataFrame([*ODD, (9, "x" * 400_000)], "doc_id long, text string")
    want = sorted((i, len((t or "").encode()), hashlib.sha256(op10_matroska.padded(t)).hexdigest()) for i, t in [*ODD, (9, "x" * 400_000)])
    media = op10_matroska.store_media(docs)
    assert sorted(r[:] for r in op10_matroska.features(media).select("doc_id", "n_bytes", "payload_sha256").collect()) == want
    assert op10_matroska.packet_table(media).where("doc_id = 9").agg(F.sum("size")).first()[0] == len(op10_matroska.padded("x" * 400_000))
    for kind in (op10_matroska.XIPH, op10_matroska.EBML_LACING):
        frames = [b"a" * 300, b"b" * 255, b"c", b"d" * 1000]
        data = op10_matroska.lace(frames, kind)
        assert [bytes(data[a : a + n]) for a, n in op10_matroska.unlace(memoryview(data), 0, len(data), kind)] == frames


def test_mixing_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("rate", F.lit(1))
    out = op8_mixing.mix_to_targets(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = out.agg(*[F.sum(F.col("__rate") * F.col("__n_words") * F.col("__p")[k]) for k in range(3)], F.min("__rate")).first()
    assert got[3] >= 0 and abs(got[1] / got[0] - 3 / 7) < 0.02 and got[2] / got[0] < 0.02


def test_mixing_looks_a_word_up_once_a_text():
    class Counted(op8_mixing.Places):
        asked = 0

        def __getitem__(self, w):
            self.asked += 1
            return super().__getitem__(w)

    texts = ["The the cat, cat", "", "cat " * 50 + "the"]
    size, distinct, flat = op8_mixing.features(texts, places := Counted())
    the, cat = op8_mixing.Places()[b"the"], op8_mixing.Places()[b"cat"]
    assert size.tolist() == [4, 0, 51] and distinct.tolist() == [2, 0, 2] and flat.tolist() == sorted((the, cat)) * 2
    assert places.asked == 5  # the, cat, and cat with a comma; cat, the
