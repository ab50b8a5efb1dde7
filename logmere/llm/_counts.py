"""How often keys occur in the whole corpus, answered to the chunks of rows that ask.

A chunk is a row with a number and its keys. Keys travel once a chunk, packed by bucket, whatever their number in it,
so a key that a third of all documents hold stays small; answers travel back as one byte a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_keys, cut_by, mix, opened, partitions, press, tidy

#: Keys of a chunk and of a bucket, about.
CHUNK_KEYS, BUCKET_KEYS = 1 << 20, 1 << 23
#: Counts end here.
MANY = 255


def place_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def counted(table: DataFrame, then: Callable[[dict, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """table: rows (chunk long, tokens binary: packed uint64, more columns). `then` gets each row and how often each of its
    tokens occurs in the corpus (1 to MANY), and returns rows of `schema`.

    The numbers of chunks must be unique and their rows fixed (written). Keys are told apart by their upper 48 bits and
    their bucket; two keys that look alike count together, which makes a count too large, never too small.
    """
    spark = table.sparkSession
    total = table.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    n = max(partitions(spark), -(-total // (8 * BUCKET_KEYS)))
    deal = bucket_keys(spark, n)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("tokens"), strict=True):
                keys, count = np.unique(np.frombuffer(raw.as_py(), np.uint64), return_counts=True)
                rows = list(cut_by(place_of(keys, n), n, keys, np.minimum(count, MANY).astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(deal[[r[0] for r in rows]], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([(r[1] >> np.uint64(32)).astype(np.uint32).tobytes() for r in rows], pa.binary()), pa.array([(r[1] >> np.uint64(16)).astype(np.uint16).tobytes() for r in rows], pa.binary()), pa.array([press(r[2]) for r in rows], pa.binary()),
                ], names=["bucket", "chunk", "place", "high", "low", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, keys, counts = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for b in batches:
            for chunk, place, high, low, c in zip(*[b.column(x).to_pylist() for x in ("chunk", "place", "high", "low", "counts")], strict=True):
                keys.append(np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(low, np.uint16))
                counts.append(opened([c], np.uint8))
                home.append((chunk, place, len(keys[-1])))
        if not home:
            return
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        k = keys[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sums = np.minimum(np.add.reduceat(counts[order].astype(np.int64), first), MANY).astype(np.uint8)
        counts[order] = np.repeat(sums, np.diff(np.append(first, len(k))))
        ends = np.cumsum([h[2] for h in home])
        yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in home], pa.int64()), pa.array([h[1] for h in home], pa.int32()), pa.array([press(counts[e - h[2] : e]) for e, h in zip(ends, home, strict=True)], pa.binary())], names=["chunk", "place", "counts"])

    names = table.columns

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, got = None, []

        def close() -> pa.RecordBatch | None:
            keys, at = np.unique(np.frombuffer(row["tokens"], np.uint64), return_inverse=True)
            count = np.empty(len(keys), np.uint8)
            count[np.argsort(place_of(keys, n).astype(np.uint16 if n < 65536 else np.int64), kind="stable")] = opened(got, np.uint8)
            return then(row, count[at])

        for b in batches:  # in order: a chunk's own row, then its answers by place
            place, counts = b.column("place").to_pylist(), b.column("counts").to_pylist()
            for i, p in enumerate(place):
                if p < 0:
                    if row and (out := close()) is not None:
                        yield out
                    row, got = {c: b.column(c)[i].as_py() for c in names}, []
                else:
                    got.append(counts[i])
        if row and (out := close()) is not None:
            yield out

    filled = table.where(F.octet_length("tokens") > 0)
    answers = filled.select("chunk", "tokens").mapInArrow(tidy(ask), "bucket int, chunk long, place int, high binary, low binary, counts binary").repartition(n, "bucket").mapInArrow(tidy(meet), "chunk long, place int, counts binary")
    both = filled.withColumn("place", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    return both.repartition(n, "chunk").sortWithinPartitions("chunk", "place").mapInArrow(tidy(gather), schema)
