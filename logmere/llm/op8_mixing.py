"""Mixing to target weights with soft membership.

A classifier fitted on the labelled table gives each document posteriors over domains. Document rates r >= 0 then
solve  min |sum_i r_i n_i p_i - target|^2  by projected gradient: p_i are the posteriors, n_i the words of a
document. Rates start at one and move only along p_i, so a document's rate is a function of the steps so far; a
pass over the table adds up the domains' expected words, and only that vector reaches the driver.
"""

from __future__ import annotations

import warnings
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import KEPT, beside, bounded, chunks, tidy, with_rest, written

DOMAINS = ("good", "plain", "toxic")
#: Shares of the words; the total makes the first domain's own words its share.
TARGETS = {"good": 0.7, "plain": 0.3, "toxic": 0.0}
BITS = 18
#: The classifier is fitted on at most SAMPLE labelled documents, chosen by a hash of the id.
SAMPLE, STEPS, L2 = 4000, 300, 1e-3
ROUNDS, TOLERANCE = 30, 1e-4
#: Words that a worker keeps.
MOST = 1 << 18


def domain(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "plain")


class Places(dict):
    """The hashed place of each word that was met, without punctuation at its ends."""

    def __missing__(self, w: bytes) -> int:
        self[w] = place = (xxhash.xxh3_128_intdigest(w.strip(b".,;:!?()[]\"'|")) & 0xFFFFFFFFFFFFFFFF) >> 64 - BITS
        return place


@cache
def vocabulary() -> Places:
    """This worker process's own, so later tasks find the words of earlier ones."""
    return Places()


KEPT[__name__] = vocabulary.cache_clear


def features(texts: list[str], places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of lower-cased words of each text, its number of distinct hashed places, and these places one text after the other."""
    if len(places) > MOST:
        places.clear()
    size, distinct, flat = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), array("q")
    for i, t in enumerate(texts):  # a text's words are looked up at once, while they are in the processor's cache
        size[i] = len(w := t.encode().lower().split())
        distinct[i] = len(w := set(w))
        flat.extend(map(places.__getitem__, w))
    place = np.repeat(np.arange(len(texts)), distinct) << BITS | np.frombuffer(flat, np.int64)
    place.sort()
    place = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
    return size, np.bincount(place >> BITS, minlength=len(texts)), place & (1 << BITS) - 1


def fit(sets: list[np.ndarray], labels: list[int], classes: int) -> np.ndarray:
    """Softmax regression on presence features, each scaled by how far its log odds differ between domains; (2^BITS + 1, classes), bias last."""
    y = np.eye(classes)[labels]
    seen = np.zeros((1 << BITS, classes))
    for s, k in zip(sets, labels, strict=True):
        seen[s, k] += 1
    prior = y.sum(0)
    odds = np.log((seen + 0.5) / (prior + 1)) - np.log((seen.sum(1, keepdims=True) - seen + 0.5) / (prior.sum() - prior + 1))
    odds[seen.sum(1) < 2] = 0  # a word of one document tells nothing
    scale = np.abs(odds).max(1)
    flat, row = np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, row = flat[told := scale[flat] > 0], row[told]
    value = scale[flat] / np.sqrt(np.maximum(1e-9, np.bincount(row, scale[flat] ** 2, len(sets))))[row]
    full, begin = np.unique(row, return_index=True)
    used, place = np.unique(flat, return_inverse=True)
    order = np.argsort(place, kind="stable")  # the same entries by place, for the gradient
    row_of, value_of, first = row[order], value[order], np.searchsorted(place[order], np.arange(len(used)))
    z = np.zeros((len(sets), classes))
    w, bias = np.zeros((classes, len(used))), np.log(prior + 1)
    memory = np.zeros_like(w)
    for _ in range(STEPS if len(used) else 0):  # AdaGrad on the whole sample
        for k in range(classes):
            z[full, k] = np.add.reduceat(value * w[k][place], begin)
        p = np.exp((x := z + bias) - x.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = ((p - y) / len(sets)).T.copy()
        g = np.stack([np.add.reduceat(value_of * e[k][row_of], first) for k in range(classes)]) + L2 * w / len(sets)
        memory += g * g
        w -= 0.5 * g / np.sqrt(memory + 1e-12)
        bias -= 0.5 * e.sum(1)
    out = np.zeros((1 << BITS) + 1, dtype=(np.float64, classes))
    out[used], out[-1] = w.T, bias
    return np.concatenate([out, np.append(scale, 0)[:, None]], 1)


def posterior(size: np.ndarray, flat: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A row for each text; table: scaled weights and the squared scale of each place."""
    z = np.zeros((len(size), table.shape[1]))
    full = np.flatnonzero(size)
    if len(full):
        z[full] = np.add.reduceat(table[flat], (np.cumsum(size) - size)[full])
    z = z[:, :-1] / np.sqrt(np.maximum(1e-9, z[:, -1:])) + bias
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns of docs, with __n_words and __p (posteriors over DOMAINS). Without usable labels, all weight is on the first domain."""
    spark = bounded(docs.sparkSession)
    known = labels.withColumn("__domain", domain()).where("__domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("__domain").alias("domain"))
    count = known.count()
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    some = known.where(uniform < min(1.0, SAMPLE / max(1, count)))
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary()
        for b in chunks(batches, "text"):
            _, size, flat = features(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("domain"), pa.array([x.tobytes() for x in np.split(flat.astype(np.int32), np.cumsum(size)[:-1])], pa.binary())], names=["doc_id", "domain", "s"])

    rows = sorted(text.where(uniform < min(1.0, SAMPLE / max(1, count))).join(some, "doc_id").mapInArrow(tidy(sample), "doc_id long, domain string, s binary").collect())
    rows = [r for r in rows if r["s"]]
    if rows:
        model = fit([np.frombuffer(r["s"], np.int32).astype(np.int64) for r in rows], [DOMAINS.index(r["domain"]) for r in rows], len(DOMAINS))
    else:
        model = np.zeros(((1 << BITS) + 1, len(DOMAINS) + 1))
        model[-1, 0] = 50
    shared = spark.sparkContext.broadcast(model.astype(np.float32))  # 4 MB whatever the corpus
    table = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__rest"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = vocabulary(), shared.value.astype(np.float64)
        bias, scale = model[-1, :-1], model[:-1, -1:]
        table = np.concatenate([model[:-1, :-1] * scale, scale**2], 1)
        for b in chunks(batches, "__text", 4 << 20):
            n, size, flat = features(b.column("__text").to_pylist(), words)
            p = posterior(size, flat, table, bias)
            yield pa.RecordBatch.from_arrays([b.column("__rest"), pa.array(n), pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * len(DOMAINS), p.reshape(-1))], names=["__rest", "__n_words", "__p"])

    return table.mapInArrow(tidy(score), with_rest(table, "__n_words long, __p array<double>")).select(*beside(docs.columns, ["__n_words", "__p"]))


def rates_after(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates of documents with posteriors p after the given steps: r <- max(0, r - p . step)."""
    r = np.ones(len(p))
    for u in steps:
        r = np.maximum(0, r - p @ u)
    return r


def fit_rates(scored: DataFrame, targets: dict[str, float]) -> list[np.ndarray]:
    """The steps whose rates bring the domains' expected words to the targets; warns where ROUNDS steps leave more than TOLERANCE."""
    k = len(DOMAINS)

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        """Row 0: expected words at the rates; below: the matrix sum of n p p' over documents that can still move."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k + 1, k))
            for b in batches:
                p = np.array(b.column("__p").flatten().to_numpy()).reshape(-1, k)
                n, r = b.column("__n_words").to_numpy().astype(float), rates_after(p, steps)
                out[0] += (n * r) @ p
                live = (n * (r > 0))[:, None] * p
                out[1:] += live.T @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(out.reshape(-1))], names=["at", "v"])

        rows = scored.select("__n_words", "__p").mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(k * (k + 1))
        for r in rows:
            out[r["at"]] = r["v"]
        return out.reshape(k + 1, k)

    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in DOMAINS])
    if weight.sum() <= 0:
        raise ValueError("no positive target")
    steps: list[np.ndarray] = []
    start = totals(steps)
    lead = int(np.argmax(weight))
    target = weight / weight[lead] * start[0][lead]
    if start[0].sum() <= 0:
        return steps
    now, best = start, np.inf
    damping = 1.0
    for _ in range(ROUNDS):
        gap = now[0] - target
        error = float(np.abs(gap).sum() / target.sum())
        if error < TOLERANCE:
            break
        if error > best and damping > 1 / 64:  # the last step went too far: take it back and go half as far
            steps.pop()
            damping /= 2
            now = kept
            gap = now[0] - target
        else:
            best, kept = error, now
        metric = now[1:] + 1e-3 * np.trace(now[1:]) / k * np.eye(k)  # the gradient in the words' own metric
        steps.append(damping * np.linalg.solve(metric, gap))
        now = totals(steps)
    error = float(np.abs(now[0] - target).sum() / target.sum())
    if error > best:
        steps.pop()
    if min(error, best) >= TOLERANCE:  # not reachable with nonnegative rates, or not in so many rounds
        warnings.warn(f"the expected words are off their targets by {min(error, best):.2g} of them after {len(steps)} steps", stacklevel=2)
    return steps


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with __n_words, __p, __rate and __copies (whole copies: the rate rounded by a hash of id and text).

    A null text has no words and keeps the rate its posteriors give. Repeated rows get equal rates. An empty table gives one.
    """
    scored = written(posteriors(docs, labels, id_col, text_col), "posteriors")
    steps = fit_rates(scored, targets or TARGETS)
    r = F.lit(1.0)
    for u in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col("__p")[j] * float(u[j]) for j in range(len(DOMAINS))), F.lit(0.0)))
    uniform = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return scored.withColumn("__rate", r).withColumn("__copies", (F.floor("__rate") + (uniform < F.col("__rate") - F.floor("__rate")).cast("long")).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = mix_to_targets(docs, labels)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), *[F.col("__p")[j].alias(f"p_{d}") for j, d in enumerate(DOMAINS)], F.col("__rate").alias("rate"), F.col("__copies").alias("copies"))
