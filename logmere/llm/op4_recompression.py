"""Substring dedup by recompression: remove words covered by a 20-word window that also starts earlier.

Rounds of recompression name runs of equal symbols and then pairs (a symbol of class 0 before one of class 1).
Names and classes are fixed functions of the symbols, so every executor gives equal substrings the same names
without a dictionary. Each symbol carries the stretch of words that decided it; a window that holds the stretch
holds the symbol, wherever it occurs. A window's witness is its first symbol of the highest level it decides.

1. Witnesses (symbol, place, words of its stretch) that occur twice in the corpus mark possible repeats.
2. Windows with such a witness are compared by the symbols that spell them (`spelled`), under two independent
   64-bit names; in each equal group all but the first (by document, then start) are removed.
Exact copies of earlier documents are found by digest. Repeats inside a batch are settled there, so a passage
that a third of all documents share travels once for a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, bucket_keys, chunks, cut_by, ids_and_text, mix, opened, partitions, press, tidy, unpacked, with_rest
from ._shared import MARK_NAMES, MARKS, blobs, gathered_marks, later_copies, packed_marks, shared_keys

WINDOW = 20
ROUNDS = 3
RUN, PAIR, OTHER = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


class Level:
    """Symbols of all documents of a batch, in order; lo and hi bound the words that decide a symbol.

    names has one or two 64-bit names of each symbol, of which the first decides; begins is a symbol's first word, child
    its first symbol on the level below.
    """

    def __init__(self, names: list[np.ndarray], doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, begins: np.ndarray, child: np.ndarray):
        self.names, self.doc, self.lo, self.hi, self.begins, self.child = names, doc, lo, hi, begins, child


def neighbours(level: Level, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo of what stands before symbol `first`, hi of what follows `last`; beyond a document's end nothing decides."""
    doc, n = level.doc[first], len(level.doc)
    prev, nxt = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    lo = np.where((first > 0) & (level.doc[prev] == doc), level.lo[prev], begin[doc] - 1)
    hi = np.where((last + 1 < n) & (level.doc[nxt] == doc), level.hi[nxt], end[doc] + 1)
    return lo, hi


def runs(level: Level, begin: np.ndarray, end: np.ndarray) -> Level:
    """Name every run of equal symbols."""
    name = level.names[0]
    first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (level.doc[1:] != level.doc[:-1])))
    count = np.diff(np.append(first, len(name)))
    lo, hi = neighbours(level, first, first + count - 1, begin, end)
    long = np.flatnonzero(count > 1)
    names = [x[first] for x in level.names]
    for x in names:
        x[long] = mix(x[long] * RUN + count[long].astype(np.uint64))
    return Level(names, level.doc[first], lo, hi, level.begins[first], first)


def pairs(level: Level, turn: int, begin: np.ndarray, end: np.ndarray) -> Level:
    """Name every pair of a symbol of class 0 and a following one of class 1."""
    name, n = level.names[0], len(level.doc)
    kind = (mix(name ^ np.uint64(int(OTHER) * (turn + 1) % 2**64)) & np.uint64(1)).astype(bool)
    left = np.zeros(n, bool)
    left[:-1] = ~kind[:-1] & kind[1:] & (level.doc[1:] == level.doc[:-1])
    right = np.append(False, left[:-1])
    before, after = neighbours(level, np.arange(n), np.arange(n), begin, end)
    lo, hi = np.where(kind & ~right, before, level.lo), np.where(~kind & ~left, after, level.hi)
    at = np.flatnonzero(left)
    hi[at] = np.maximum(level.hi[at], level.hi[at + 1])
    lo[at] = np.minimum(level.lo[at], level.lo[at + 1])
    names = [x.copy() for x in level.names]
    for x in names:
        x[at] = mix(x[at] * PAIR + (x[at + 1] ^ OTHER))
    keep = np.flatnonzero(~right)
    return Level([x[keep] for x in names], level.doc[keep], lo[keep], hi[keep], level.begins[keep], level.child[keep])


def parsed(names: list[np.ndarray], size: np.ndarray, rounds: int) -> list[Level]:
    """The levels of a batch's words, from the words upwards. Places are numbers within the batch."""
    end = np.cumsum(size).astype(np.int32)
    begin = (end - size).astype(np.int32)
    place = np.arange(len(names[0]), dtype=np.int32)
    levels = [Level(names, np.repeat(np.arange(len(size), dtype=np.int32), size), place, place + np.int32(1), place, place)]
    for turn in range(rounds if len(place) else 0):
        levels.append(pairs(runs(levels[-1], begin, end), turn, begin, end))
    return levels


def windows_of(size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every window of a batch."""
    begin = (np.cumsum(size) - size).astype(np.int32)
    many = np.maximum(size - window + 1, 0)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), many)
    return doc, np.arange(len(doc), dtype=np.int32) - np.repeat(np.cumsum(many) - many, many).astype(np.int32) + begin[doc]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base for n places, and their inverses."""
    return np.cumprod(np.full(n + 1, int(PAIR), np.uint64)), np.cumprod(np.full(n + 1, pow(int(PAIR), -1, 2**64), np.uint64))


def witnesses(levels: list[Level], start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The witness (an index) of the window at each start, and the witnesses' keys."""
    if not len(start):
        return start, np.zeros(0, np.uint64)
    h = levels[0].names[0]
    power, back = _powers(len(h))
    sums = np.append(np.uint64(0), np.cumsum(h * power[: len(h)], dtype=np.uint64))
    which, keys, open_, have = np.full(len(start), -1), [], np.arange(len(start)), 0
    for x in reversed(levels):
        at = np.minimum(np.searchsorted(x.lo, start[open_]), len(x.lo) - 1)
        fits = (x.lo[at] >= start[open_]) & (x.hi[at] <= start[open_] + window)
        used, place = np.unique(at[fits], return_inverse=True)
        which[open_[fits]] = place + have
        lo, hi = x.lo[used], x.hi[used]
        keys.append(mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64) * OTHER + x.names[0][used] * RUN))
        open_, have = open_[~fits], have + len(used)
    return which, np.concatenate(keys)


def spelled(levels: list[Level], start: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each column of names, a hash of the symbols that spell the window at each start.

    On every level the symbols that a window decides are a range [i, j), within the stretch of the level below. A
    window is spelled by its highest symbols and, left and right of them, by those of lower levels that they leave
    over. The spelling of equal windows is equal wherever they stand; unequal windows differ in it, as a name stands
    for one string of words. A symbol counts at its first word's place, so the sum over a spelling is taken from
    running sums: going up a level replaces the sum over the symbols that it joins.
    """
    stop = start + window
    power, back = _powers(len(levels[0].doc))
    ranges = []
    for x in levels:
        i, j = np.searchsorted(x.lo, start), np.searchsorted(x.hi, stop, "right")
        ranges.append((np.minimum(i, j), j))
    out = []
    for column in range(len(levels[0].names)):
        below, total = None, np.zeros(len(start), np.uint64)
        for x, (i, j) in zip(levels, ranges, strict=True):
            sums = np.append(np.uint64(0), np.cumsum(x.names[column] * power[x.begins], dtype=np.uint64))
            gain = sums if below is None else sums - below[np.append(x.child, len(below) - 1)]
            total += gain[j] - gain[i]
            below = sums
        out.append(mix(total * back[start]))
    return out


#: Windows of one bucket (without count), and marks that are settled already (without hashes).
SENT = MARKS + ", h1 binary, h2 binary"
NAMES = [*MARK_NAMES, "h1", "h2"]


def later(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, starts: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices sorted by window and place, and which of them have an equal window before them.

    Rows that share an id and a start (repeated rows of a table) are one place.
    """
    order = np.lexsort((tags, starts, ids, h2, h1))
    a, b, i, s = h1[order], h2[order], ids[order], starts[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (i != i[group]) | (s != s[group])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, keep_text: bool = False) -> DataFrame:
    """All columns of docs (the text only with keep_text), with __kept (string: kept words joined by a space), __n_words, __n_removed.

    A null text has no words; a null id counts as the smallest. Documents with fewer words than a window stay
    whole. Rows that repeat an id are one document where their windows start at the same word. An empty table gives one.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    deal = bucket_keys(spark, n)
    table = ids_and_text(docs, id_col, text_col).withColumn("__tag", F.xxhash64("__text"))
    dealt = table.repartition(n, "__id")

    def hashed(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
        lists = [words.split(t) for t in column.to_pylist()]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return words.hashes([w for x in lists for w in x]), size

    def keys_of(column: pa.Array) -> list[np.ndarray]:
        words = keys_of.__dict__.setdefault("words", Words())
        h, size = hashed(column, words)
        doc, start = windows_of(size, window)
        which, keys = witnesses(parsed([h[:, 0].copy()], size, rounds), start, window)
        owner = np.zeros(len(keys), np.int64)
        owner[which] = doc
        order = np.argsort(owner, kind="stable")
        return np.split(keys[order], np.searchsorted(owner[order], np.arange(1, len(size))))

    replies = shared_keys(table.select("__id", "__text"), keys_of, 2 << 20)
    copies = later_copies(table).groupBy("__id").agg(F.collect_set("__digest").alias("__copies"))
    asked = dealt.join(replies, "__id").join(copies, "__id", "left")
    is_copy = F.coalesce(F.array_contains("__copies", F.sha2(F.encode("__text", "utf-8"), 256)), F.lit(False))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in chunks(batches, "__text"):
            h, size = hashed(b.column("__text"), words)
            doc, start = windows_of(size, window)
            levels = parsed([h[:, 0].copy(), h[:, 1].copy()], size, rounds)
            which, keys = witnesses(levels, start, window)
            owner = np.zeros(len(keys), np.int64)
            owner[which] = doc
            order = np.argsort(owner, kind="stable")
            first = np.searchsorted(owner[order], np.arange(len(size) + 1))
            ask = np.zeros(len(keys), bool)
            for i, ords in enumerate(b.column("ords").to_pylist()):
                o = np.frombuffer(ords, np.int32)
                ask[order[first[i] + o[o < first[i + 1] - first[i]]]] = True
            go = np.flatnonzero(ask[which]) if len(which) else which
            if not len(go):
                continue
            begin = np.cumsum(size) - size
            h1, h2 = spelled(levels, start[go], window)
            ids, tags = b.column("__id").to_numpy(zero_copy_only=False)[doc[go]], b.column("__tag").to_numpy(zero_copy_only=False)[doc[go]]
            starts = start[go] - begin[doc[go]]
            order, gone = later(h1, h2, ids, starts, tags)
            if gone.any():  # settled: an equal window of this batch comes before
                o = order[gone]
                yield blobs(deal, [(*r, None, None) for r in packed_marks(ids[o], tags[o], starts[o], n)], NAMES)
            o = np.sort(order[~gone])
            rows = [(k, press(i), press(t), press(np.diff(s, prepend=np.int32(0))), None, a.tobytes(), c.tobytes()) for k, i, t, s, a, c in cut_by((h1[o] >> np.uint64(20)).astype(np.int64) % n, n, ids[o], tags[o], starts[o].astype(np.int32), h1[o], h2[o])]
            yield blobs(deal, rows, NAMES)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in NAMES], strict=True):
                if r[5] is None:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r[:5], (pa.int32(), *[pa.binary()] * 4), strict=True)], names=MARK_NAMES)
                else:
                    parts.append((opened([r[1]], np.int64), opened([r[2]], np.int64), np.cumsum(opened([r[3]], np.int32), dtype=np.int32), np.frombuffer(r[5], np.uint64), np.frombuffer(r[6], np.uint64)))
        if parts:
            ids, tags, starts, h1, h2 = map(np.concatenate, zip(*parts, strict=True))
            order, gone = later(h1, h2, ids, starts, tags)
            o = order[gone]
            if len(o):
                yield blobs(deal, packed_marks(ids[o], tags[o], starts[o], n), MARK_NAMES)

    sent = asked.where(~is_copy).select("__id", "__text", "__rest", "__tag", "ords").mapInArrow(tidy(candidates), SENT)
    marks = gathered_marks(sent.repartition(n, "bucket").mapInArrow(tidy(settle), MARKS))
    judged = dealt.join(marks, "__id", "left").join(copies, "__id", "left").select("__text", "__tag", "__rest", "__marks", is_copy.alias("__copy"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "__text"):
            out: list[tuple] = []
            for text, tag, marks, copy in zip(*[b.column(c).to_pylist() for c in ("__text", "__tag", "__marks", "__copy")], strict=True):
                words = text.encode().split()
                total = len(words)
                if total >= window and copy:
                    words = []
                elif total >= window and marks:
                    r = np.frombuffer(b"".join([m["runs"] for m in marks if m["__tag"] == tag]), np.int64).reshape(-1, 2)
                    step = np.zeros(total + 1, np.int32)
                    np.add.at(step, r[:, 0], 1)
                    np.add.at(step, r[:, 0] + r[:, 1] + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
                out.append((b" ".join(words).decode(), total, total - len(words)))
            yield pa.RecordBatch.from_arrays([b.column("__rest"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), *[b.column("__text")] * keep_text], names=["__rest", "__kept", "__n_words", "__n_removed", *["__text"] * keep_text])

    # Both uses of the dealt texts take the same columns, so their shuffle is done once.
    done = judged.mapInArrow(tidy(finish), with_rest(table, "__kept string, __n_words long, __n_removed long" + ", __text string" * keep_text))
    return done.select(*unpacked([c for c in docs.columns if (keep_text or c != text_col) and c.lower() not in ("__kept", "__n_words", "__n_removed")], text_col, docs.columns), "__kept", "__n_words", "__n_removed")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.encode("__kept", "utf-8"), 256).alias("kept_sha256"))
