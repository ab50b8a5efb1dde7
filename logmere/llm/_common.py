"""Helpers shared by the text operators: the shared folder, word splitting, hashing, packed rows."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: An absent id is treated as the smallest id.
NULL_ID = -(2**63)


#: Bytes of an Arrow batch, where the session sets none: long texts come in small batches.
BATCH_BYTES = 4 << 20
#: Bytes of text that an operator works on at once, or one row.
CHUNK_BYTES = 1 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded in bytes as well as in rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: What worker processes keep for later tasks, by module: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def _released() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """`run` for mapInArrow, in a worker that first drops what other operators have kept, and gives free memory back at the end:
    workers outlive their tasks, and several share an executor's memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, drop in KEPT.items():
            if owner != run.__module__:
                drop()
        _released()
        try:
            yield from run(batches)
        finally:
            _released()

    return task


def partitions(spark: SparkSession) -> int:
    bounded(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and not (sc.master or "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="logmere-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that more than one in so many rows hold is joined by broadcast: fewer than so many such keys can exist.
HOT = 1000


def joined_by_key(rows: DataFrame, facts: DataFrame, key: str, spread: Column) -> DataFrame:
    """rows left-joined with facts, which has one row for each key and in `n` how many rows hold it (no key: no facts).

    Rows of keys that hold more than 1 / HOT of all rows meet their facts by broadcast, of fewer than HOT rows whatever
    the input, and are dealt on by `spread` (of the key's type); so no task gets more than that share of the rows.
    """
    most = rows.count() // HOT
    names = [c for c in facts.columns if c not in (key, "n")]
    hot = facts.where(F.col("n") > most).select(key, F.struct(*names).alias("__hot"))
    cold = facts.where(F.col("n") <= most).select(F.col(key).alias("__at"), F.struct(*names).alias("__cold"))
    met = rows.join(F.broadcast(hot), key, "left").withColumn("__at", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(spread))
    met = met.join(cold, "__at", "left").withColumn("__facts", F.coalesce("__hot", "__cold"))
    return met.select(*rows.columns, *[F.col(f"__facts.{c}").alias(c) for c in names])


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __text, __rest): a non-null long id, non-null text, and as one struct all other columns and whether the text is null."""
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("__id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias(_null_name(docs.columns))).alias("__rest"),
    )


def _null_name(columns: list[str]) -> str:
    name = "__null"
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def unpacked(columns: list[str], text_col: str, all_columns: list[str]) -> list:
    """Columns of docs again, from __text and __rest."""
    null = f"__rest.`{_null_name(all_columns)}`"
    return [F.when(~F.col(null), F.col("__text")).alias(c) if c == text_col else F.col(f"__rest.`{c}`").alias(c) for c in columns]


def with_rest(table: DataFrame, ddl: str) -> StructType:
    """The schema of __rest as in `table`, whatever its columns' names, and further columns."""
    return StructType([table.schema["__rest"], *StructType.fromDDL(ddl).fields])


def beside(columns: list[str], new: list[str]) -> list:
    """The columns out of __rest, and new ones; a new one takes the place of an old one of its name."""
    taken = {c.lower() for c in new}
    return [F.col(f"__rest.`{c}`").alias(c) for c in columns if c.lower() not in taken] + [F.col(c) for c in new]


def bucket_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions, an int that repartition(n, key) deals to it; so n buckets fill n partitions evenly."""
    rows = spark.range(40 * n + 100).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect()
    if len(rows) < n:
        raise RuntimeError("some partition has no key")
    return np.array([r["k"] for r in sorted(rows)], np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1


def windows_hash(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Polynomial hash of every k consecutive elements, built by doubling; length max(0, n - k + 1)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    power, size = h.astype(np.uint64), 1
    while True:
        if k & size:
            if out is None:
                out, have = power, size
            else:  # the part so far, then the next `size` elements
                m = n - have - size + 1
                out = out[:m] * np.uint64(pow(base, size, 2**64)) + power[have : have + m]
                have += size
        if size * 2 > k:
            return out
        m = n - 2 * size + 1
        power = power[:m] * np.uint64(pow(base, size, 2**64)) + power[size : size + m]
        size *= 2


class _Ids(dict):
    """A number for each word; a new word's two hashes are put into `values`."""

    def __init__(self, strip: bytes):
        self.strip, self.values = strip, []

    def __missing__(self, w: bytes) -> int:
        v = xxhash.xxh3_128_intdigest(w.strip(self.strip) if self.strip else w)
        self.values += (v & 0xFFFFFFFFFFFFFFFF, v >> 64)
        self[w] = n = len(self)
        return n


class Words:
    """Words of a text are maximal runs of bytes other than 20 and 09-0D; each gets two 64-bit hashes, without the bytes of `strip` at its ends. The cache is bounded."""

    def __init__(self, lower: bool = False, most: int = 1 << 18, strip: bytes = b""):
        self.lower, self.most, self.strip = lower, most, strip
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids(self.strip)
        self.table = np.zeros((0, 2), np.uint64)

    def split(self, text: str) -> list[bytes]:
        raw = text.encode()
        return (raw.lower() if self.lower else raw).split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """An (n, 2) array."""
        if len(self.ids) > self.most:
            self.clear()
        ids = self.ids
        at = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if ids.values:
            fresh = np.array(ids.values, np.uint64).reshape(-1, 2)
            self.table, ids.values = np.concatenate([self.table, fresh]), []
        return self.table[at]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text is at most `most` bytes, or one row; the column has texts or their sizes."""
    for b in batches:
        c = b.column(column)
        size = np.cumsum(pc.fill_null(c if pa.types.is_integer(c.type) else pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield b.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def cut_by(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    """For each bucket that has rows: its number and its part of each column, in the given order."""
    order = np.argsort(bucket.astype(np.uint16 if n < 65536 else np.int64), kind="stable")
    sizes = np.bincount(bucket, minlength=n)
    ends = np.cumsum(sizes)
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(sizes):
        yield (int(b), *[c[ends[b] - sizes[b] : ends[b]] for c in columns])


def press(x: np.ndarray | bytes) -> bytes:
    """A compressed blob; shuffles store it as it is."""
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes() if isinstance(x, np.ndarray) else x)


def opened(blobs: list[bytes], dtype: type) -> np.ndarray:
    """The elements of pressed blobs, one after the other."""
    reader = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join([reader.decompress(b) for b in blobs]), dtype)
