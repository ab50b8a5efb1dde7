"""Language ID with string kernels.

The blended-spectrum presence kernel counts the character 2-, 3- and 4-grams that two texts share, normalised by
both texts' own counts. Landmark texts span a Nyström approximation; one-versus-rest kernel ridge regression is
fitted on it. Because the kernel is a sum over grams, landmarks and coefficients fold into one weight per gram
and language, and a batch of texts is scored by one product of its presence rows with those weights.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import beside, bounded, chunks, tidy, with_rest

ORDERS = (2, 3, 4)
BITS = 18
#: Training takes at most PER_LANGUAGE whole documents of each language; LANDMARKS of them are landmarks.
PER_LANGUAGE, LANDMARKS, RIDGE, SHARPNESS = 300, 256, 1e-2, 4.0
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Lower case of every letter's code point, a space for all else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """Hashed places of the distinct n-grams of the lower-cased letters, words parted by one space; none without letters."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = unicodedata.normalize("NFC", text).encode("utf-32-le", "surrogatepass")
    c = np.empty(len(raw) // 4 + 2, np.uint64)
    c[0] = c[-1] = 32
    c[1:-1] = _TABLE[0][np.frombuffer(raw, np.uint32)]
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    seen = np.zeros(1 << BITS, bool)
    h = c
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F)
        if n in ORDERS:
            seen[((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen)


def kernel(sets: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Normalised presence kernel of every set with every landmark; sets are not empty."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(landmarks)))
    for j, x in enumerate(landmarks):
        has = np.zeros(1 << BITS, np.float64)
        has[x] = 1
        out[:, j] = np.add.reduceat(has[flat], at) / np.sqrt(len(x))
    return out / np.sqrt([[len(s)] for s in sets])


def fit(sets: list[np.ndarray], labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a weight for each hashed gram and language."""
    names = sorted(set(labels))
    turn: dict[str, int] = {}
    rank = [turn.__setitem__(y, turn.get(y, 0) + 1) or turn[y] for y in labels]
    chosen = sorted(range(len(sets)), key=lambda i: (rank[i], labels[i]))[:LANDMARKS]  # languages by turns
    marks = [sets[i] for i in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-8 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel(sets, marks) @ root
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in labels])
    weight = np.array([len(labels) / (len(names) * labels.count(a)) for a in labels])[:, None]  # languages count alike
    coefficients = root @ np.linalg.solve(z.T @ (z * weight) + RIDGE * len(labels) * np.eye(z.shape[1]), z.T @ (y * weight))
    out = np.zeros((1 << BITS, len(names)), np.float32)
    for x, c in zip(marks, coefficients, strict=True):
        out[x] += (c / np.sqrt(len(x))).astype(np.float32)
    return names, out


def training(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[np.ndarray], list[str]]:
    """A bounded sample of (id, text, lang) rows: per_language whole documents of each language, by a hash of the id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 2.0 * per_language / n)).otherwise(share)
    uniform = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array([grams(t).astype(np.int32).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["id", "lang", "grams"])

    some = labelled.where(uniform < share).mapInArrow(tidy(presence), "id string, lang string, grams binary")
    kept: dict[str, list] = {}
    for r in sorted(some.collect(), key=lambda r: (hash_of(r["id"]), r["grams"])):
        if r["grams"] and len(kept.setdefault(r["lang"], [])) < per_language:
            kept[r["lang"]].append(np.frombuffer(r["grams"], np.int32).astype(np.int64))
    return [s for lang in sorted(kept) for s in kept[lang]], [lang for lang in sorted(kept) for _ in kept[lang]]


def margin(f: np.ndarray) -> np.ndarray:
    """The best response of each row less the next one; the response itself where there is one."""
    if f.shape[1] == 1:
        return f[:, 0]
    top = np.partition(f, -2, axis=1)
    return top[:, -1] - top[:, -2]


def hash_of(ident: str | None) -> int:
    import zlib

    return zlib.crc32((ident or "").encode())


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that training never sees: crc32 of the id as text is 0 modulo 5. A null id is held out."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of docs, with __lang, __score (0 to 1) and __margin: the raw response of the best language less
    that of the next one, or the response itself where one language is learned.

    Learns only from rows that are not held out and have a language and a text. `und` with score and margin 0 for a null text,
    a text without letters, or when there is nothing to learn from. Repeated rows get equal results; an empty table gives one.
    """
    spark = bounded(docs.sparkSession)
    labelled = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    sets, labels = training(labelled)
    names, weights = fit(sets, labels) if sets else ([], np.zeros((1 << BITS, 0), np.float32))
    shared = spark.sparkContext.broadcast((names, weights))  # 2^18 weights for each language, whatever the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for b in chunks(batches, "__text"):
            sets = [grams(t) if t else np.zeros(0, np.int64) for t in b.column("__text").to_pylist()]
            langs, scores, margins = [UNKNOWN] * len(sets), [0.0] * len(sets), [0.0] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full and names:
                at = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
                size = np.sqrt([[len(sets[i])] for i in full])
                f = np.add.reduceat(weights[np.concatenate([sets[i] for i in full])], at, axis=0, dtype=np.float64) / size
                e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
                p = e / e.sum(1, keepdims=True)
                for i, k, row, m in zip(full, p.argmax(1).tolist(), p, margin(f).tolist(), strict=True):
                    langs[i], scores[i], margins[i] = names[k], float(row[k]), m
            yield pa.RecordBatch.from_arrays([b.column("__rest"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())], names=["__rest", "__lang", "__score", "__margin"])

    table = docs.select(F.col(f"`{text_col}`").cast("string").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__rest"))
    return table.mapInArrow(tidy(score), with_rest(table, "__lang string, __score double, __margin double")).select(*beside(docs.columns, ["__lang", "__score", "__margin"]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
