"""A corpus pipeline in five stages; each is written as Parquet and read again as the next one's documents.

language     documents without letters, of no learned language or whose language is uncertain go
near_dups    of each group of near-duplicates (5-word shingles, Jaccard 0.8) the smallest doc_id stays
substrings   words of 20-word windows that also start earlier go; documents left without words go
mixing       words of the domains are brought to target weights; documents with no copy go
tokens       SentencePiece ids, with an exact round trip
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmere.llm import op4_recompression, op5_sentencepiece, op6_jaccard, op7_language_id, op8_mixing
from logmere.llm._common import written

#: Texts whose raw response is less than this ahead of the next language's go, however many languages are learned; README has the figures.
LEAST_MARGIN = 0.25
#: Near copies share this percentage of their shingles of so many words; op6_jaccard_join itself keeps 3 words and 90.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language."""
    found = op7_language_id.identify(docs)
    return found.where((F.col("__lang") != op7_language_id.UNKNOWN) & (F.col("__margin") >= LEAST_MARGIN)).select(*docs.columns)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates, told apart by id and text. A document with a null id stays."""
    return op6_jaccard.without_near(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated 20-word windows; texts without a removed word keep their bytes, a document that lost all its words goes."""
    out = op4_recompression.substring_dedup(docs, keep_text=True)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    kept = out.where("__n_removed = 0 OR __n_removed < __n_words").withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the domains' words meet their targets."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = op8_mixing.mix_to_targets(docs, labels)
    return out.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document."""
    return op5_sentencepiece.report(docs.select("doc_id", "text", "lang", "source"))


STAGES = [("language", language), ("near_dups", near_dups), ("substrings", substrings), ("mixing", mixing), ("tokens", tokens)]

#: Models are fitted inside; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
