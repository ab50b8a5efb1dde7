"""Which keys occur more than once in the corpus: the filter in front of the exact span operators.

Every document has an ordered list of 64-bit keys. A key that occurs twice anywhere is reported to the
documents that hold it. Keys travel packed by hash bucket, those of many texts together, so that blobs stay long when
there are many buckets. A key that repeats among them is reported at once and travels once, so a key that a third of all
documents share stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BATCH_BYTES, CHUNK_BYTES, bucket_keys, chunks, cut_by, joined_by_key, mix, opened, partitions, press, tidy

#: Keys travel as their upper 32 bits; the bucket tells some more. A false match only costs a later exact test.
PACKED = "bucket int, ids binary, ords binary, high binary"
NAMES = ["bucket", "ids", "ords", "high"]
#: Marks an occurrence that needs no reply.
NOBODY = 2**63 - 1
#: Keys that are packed together, or those of one piece of text.
KEYS_AT_ONCE = 1 << 20


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order of keys, a flag for the first of each equal run, and the size of each element's run (both in that order)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    return order, first, np.repeat(np.diff(np.append(at, len(k))), np.diff(np.append(at, len(k))))


def blobs(deal: np.ndarray, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of a bucket's number and blobs; the bucket becomes the key that repartition() deals there."""
    return pa.RecordBatch.from_arrays([pa.array(deal[[r[0] for r in rows]], pa.int32()), *[pa.array([r[c] for r in rows], pa.binary()) for c in range(1, len(names))]], names=names)


def in_parts(deal: np.ndarray, rows: list[tuple], names: list[str], most: int = BATCH_BYTES // 4) -> Iterator[pa.RecordBatch]:
    """The same in batches of some `most` bytes, or one row."""
    part, have = [], 0
    for r in rows:
        part.append(r)
        have += sum(len(x) for x in r[1:] if x is not None)
        if have >= most:
            yield blobs(deal, part, names)
            part, have = [], 0
    if part:
        yield blobs(deal, part, names)


def _replies(ids: np.ndarray, ords: np.ndarray, n: int) -> list[tuple]:
    """One row for each bucket of ids."""
    order = np.lexsort((ords, ids))
    return [(k, press(i), press(np.diff(o, prepend=np.int32(0))), None) for k, i, o in cut_by(ids[order] % n, n, ids[order], ords[order])]


def shared_keys(docs: DataFrame, keys_of: Callable[[pa.Array], list[np.ndarray]], most: int = CHUNK_BYTES, by: str = "__text") -> DataFrame:
    """docs has __id and __text; keys_of gives one key array for each text of a column (`by`: where the texts' sizes are told).

    Returns (__id, ords): one row per id that has any repeated key, `ords` a packed int32 array with the places of
    those keys; keys_of gets `most` bytes of text at once. Repeats inside one document count as repeats. Replies are dealt by id in blobs, so their number
    does not grow with documents times buckets.
    """
    n = partitions(docs.sparkSession)
    deal = bucket_keys(docs.sparkSession, n)

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, ords, keys = map(np.concatenate, zip(*held, strict=True))
        order, first, size = repeated(keys)
        here = order[size > 1]
        rows = _replies(ids[here], ords[here], n)
        once = order[first]
        owner = np.where(size[first] > 1, NOBODY, ids[once])
        once, owner = once[s := np.argsort(once)], owner[s]
        rows += [(k, press(i), press(np.diff(o, prepend=np.int32(0))), (x >> np.uint64(32)).astype(np.uint32).tobytes()) for k, i, o, x in cut_by((mix(keys[once]) >> np.uint64(20)).astype(np.int64) % n, n, owner, ords[once], keys[once])]
        yield from in_parts(deal, rows, NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for b in chunks(batches, by, most):
            each = keys_of(b.column("__text"))
            size = [len(k) for k in each]
            if not sum(size):
                continue
            held.append((np.repeat(b.column("__id").to_numpy(zero_copy_only=False), size), np.concatenate([np.arange(k, dtype=np.int32) for k in size]), np.concatenate(each)))
            have += sum(size)
            if have >= KEYS_AT_ONCE:
                yield from packed(held)
                held, have = [], 0
        if held:
            yield from packed(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ords, keys = [], [], []
        for b in batches:
            for k, i, o, h in zip(*[b.column(c).to_pylist() for c in NAMES], strict=True):
                if h is None:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.binary()), pa.array([o], pa.binary())], names=NAMES[:3])
                else:
                    ids.append(opened([i], np.int64))
                    ords.append(np.cumsum(opened([o], np.int32), dtype=np.int32))
                    keys.append(np.frombuffer(h, np.uint32))
        if keys:
            ids, ords = np.concatenate(ids), np.concatenate(ords)
            order, _, size = repeated(np.concatenate(keys))
            here = order[size > 1]
            here = here[ids[here] != NOBODY]
            yield blobs(deal, _replies(ids[here], ords[here], n), NAMES[:3])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ords = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for b in batches:
            for i, o in zip(b.column("ids").to_pylist(), b.column("ords").to_pylist(), strict=True):
                ids.append(opened([i], np.int64))
                ords.append(np.cumsum(opened([o], np.int32), dtype=np.int32))
        ids, ords = np.concatenate(ids), np.concatenate(ords)
        order = np.lexsort((ords, ids))
        ids, ords = ids[order], ords[order]
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(ids))
        for k in range(0, len(at), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[k : k + 5000]]), pa.array([ords[a:z].tobytes() for a, z in zip(at[k : k + 5000], ends[k : k + 5000], strict=True)], pa.binary())], names=["__id", "ords"])

    found = docs.mapInArrow(tidy(pack), PACKED).repartition(n, "bucket").mapInArrow(tidy(meet), "bucket int, ids binary, ords binary")
    return found.repartition(n, "bucket").mapInArrow(tidy(gather), "__id long, ords binary")


MARKS = "bucket int, __id binary, __tag binary, start binary, count binary"
MARK_NAMES = ["bucket", "__id", "__tag", "start", "count"]


def packed_marks(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, n: int) -> list[tuple]:
    """Marked starts as runs, one row for each bucket of ids: bucket, ids, tags, starts, counts."""
    order = np.lexsort((starts, tags, ids))
    i, t, s = ids[order], tags[order], starts[order].astype(np.int64)
    if not len(i):
        return []
    same = (i[1:] == i[:-1]) & (t[1:] == t[:-1])
    new = np.append(True, ~same | (s[1:] != s[:-1]))
    i, t, s = i[new], t[new], s[new]
    same = (i[1:] == i[:-1]) & (t[1:] == t[:-1])
    first = np.flatnonzero(np.append(True, ~same | (s[1:] != s[:-1] + 1)))
    count = np.diff(np.append(first, len(s)))
    i, t, s = i[first], t[first], s[first]
    return [(k, *map(press, x)) for k, *x in cut_by(i % n, n, i, t, s.astype(np.int32), count.astype(np.int32))]


def gathered_marks(marks: DataFrame) -> DataFrame:
    """(__id, __marks): for each id its (tag, runs), where runs holds packed (start, count) pairs."""
    n = partitions(marks.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            parts += zip(*[b.column(c).to_pylist() for c in MARK_NAMES[1:]], strict=True)
        if not parts:
            return
        i, t, s, c = (opened(x, k) for x, k in zip(zip(*parts, strict=True), (np.int64, np.int64, np.int32, np.int32), strict=True))
        order = np.lexsort((s, t, i))
        i, t, pairs = i[order], t[order], np.stack([s[order], c[order]], 1).astype(np.int64)
        at = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])))
        ends = np.append(at[1:], len(i))
        for k in range(0, len(at), 5000):
            a = at[k : k + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(i[a]), pa.array(t[a]), pa.array([pairs[x:z].tobytes() for x, z in zip(a, ends[k : k + 5000], strict=True)], pa.binary())], names=["__id", "__tag", "runs"])

    each = marks.repartition(n, "bucket").mapInArrow(tidy(gather), "__id long, __tag long, runs binary")
    return each.groupBy("__id").agg(F.collect_list(F.struct("__tag", "runs")).alias("__marks"))


def later_copies(docs: DataFrame) -> DataFrame:
    """(__id, copy_of): documents with exactly the text of a document with a smaller id. Only ids and digests move."""
    digests = docs.select("__id", F.sha2(F.encode("__text", "utf-8"), 256).alias("__digest"))
    firsts = digests.groupBy("__digest").agg(F.min("__id").alias("copy_of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = joined_by_key(digests, firsts, "__digest", F.col("__id").cast("string"))
    return met.where("__id > copy_of").groupBy("__id", "__digest").agg(F.min("copy_of").alias("copy_of"))
