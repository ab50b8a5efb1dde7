"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

A piece holds the space mark only at its start, so a text falls into units (space marks, then other characters)
that encode independently; where no piece joins a letter to another character, units part there as well. Units that a worker has not met are concatenated and indexed by a suffix array; a
binary search of every piece gives the range of suffixes it begins; the occurrences, sorted by position, are the
edges. As the model is a BPE model, edges relax in the order of its merges (best score first, leftmost on a tie)
instead of by the best sum of scores; only this gives SentencePiece's own ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import KEPT, beside, bounded, chunks, tidy, with_rest
from .suffix import suffix_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of the units kept by a worker, each unit counted as OVERHEAD more; longer units than LONG are not kept.
CACHE, OVERHEAD, LONG = 32 << 20, 150, 1000
#: Bytes of text encoded at once: all pieces are searched anew for each such part.
AT_ONCE = 4 << 20


def unit_pattern(pieces: list[str]) -> str:
    """Parts a text where no piece can lie across: before space marks, and between the pieces' letters and all else if no piece has both."""
    letters = sorted({c for p in pieces for c in p if c.isalpha()})
    apart = letters and not any(a != SPACE and a.isalpha() != c.isalpha() for p in pieces for a, c in zip(p, p[1:], strict=False))
    if not apart:
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    own = re.escape("".join(letters))
    return f"{SPACE}*[{own}]+|{SPACE}*[^{own}{SPACE}]+|{SPACE}+"


class Pieces:
    """The vocabulary of a BPE model: (piece, score, kind) by id; kinds 1 normal, 2 unknown, 3 control, 6 byte."""

    def __init__(self, rows: list[tuple[str, float, int]]):
        normal = [(p, s, i) for i, (p, s, k) in enumerate(rows) if k == 1]
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(rows) if k == 6}
        self.single = {p: i for p, _, i in normal if len(p) == 1}
        self.unit = re.compile(unit_pattern([p for p, _, _ in normal]))
        said = [b"" if k == 3 else b" \xe2\x81\x87 " if k == 2 else bytes([int(p[3:5], 16)]) if k == 6 else p.encode() for p, _, k in rows]
        self.said, self.said_size = np.frombuffer(b"".join(said), np.uint8), np.fromiter(map(len, said), np.int64, len(said))
        self.said_at = np.cumsum(self.said_size) - self.said_size
        scores = sorted({s for _, s, _ in normal}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        several = np.bincount([place[s] for _, s, _ in normal]) > 1
        joined = sorted((p, i) for p, _, i in normal if len(p) > 1)
        self.ids = np.array([i for _, i in joined], np.int64)
        self.rank = np.array([place[rows[i][1]] for _, i in joined], np.int64)
        self.tied = several[self.rank]
        self.size = np.array([len(p) for p, _ in joined], np.int64)
        self.longest = int(self.size.max())
        self.text = np.zeros((len(joined), self.longest), np.int64)
        for r, (p, _) in enumerate(joined):
            self.text[r, : len(p)] = [ord(c) for c in p]


def occurrences(s: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Edges sorted by position: position * (longest + 1) + length, and the row of the piece."""
    sa = suffix_array(s)
    n = len(s)
    padded = np.append(s, np.full(pieces.longest + 1, -1))
    lo, hi, live = np.zeros(len(pieces.size), np.int64), np.full(len(pieces.size), n), np.arange(len(pieces.size))
    for depth in range(pieces.longest):
        here = live[pieces.size[live] > depth]
        if not len(here):
            break
        want = pieces.text[here, depth]
        bounds = []
        for above in (False, True):
            a, b = lo[here].copy(), hi[here].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                c = padded[np.where(open_, sa[np.minimum(mid, n - 1)], 0) + depth]
                right = open_ & ((c <= want) if above else (c < want))
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            bounds.append(a)
        lo[here], hi[here] = bounds
        live = live[lo[live] < hi[live]]
    count = np.zeros(len(lo), np.int64)
    count[live] = hi[live] - lo[live]
    row = np.repeat(np.arange(len(lo)), count)
    pos = sa[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]]
    key = pos * (pieces.longest + 1) + pieces.size[row]
    order = np.argsort(key)
    return key[order], row[order]


def encode_units(units: list[str], pieces: Pieces) -> list[bytes]:
    """Ids of each unit as packed int32."""
    joined = "\0".join(units) + "\0"
    s = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    _, dense = np.unique(s, return_inverse=True)  # buckets of the suffix array by rank of the character
    edges, rows = _edges(s, dense, pieces)
    wide = pieces.longest + 1
    length = np.array([len(u) for u in units])
    begin = np.cumsum(length + 1) - length - 1
    unit = np.repeat(np.arange(len(units)), length)
    start = np.arange(len(unit)) - np.repeat(np.cumsum(length) - length, length) + begin[unit]
    size = np.ones(len(unit), np.int64)
    live = np.ones(len(unit), bool)  # symbols of units that may still merge
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    never = np.iinfo(np.int64).max
    while len(unit):
        total = size[:-1] + size[1:]
        key = start[:-1] * wide + total
        at = np.minimum(np.searchsorted(edges, key), max(len(edges) - 1, 0))
        ok = (unit[1:] == unit[:-1]) & (total < wide) & ((edges[at] == key) if len(edges) else False)
        rank = np.where(ok, pieces.rank[rows[at]] if len(edges) else never, never)
        best = np.full(len(units), never)
        np.minimum.at(best, unit[:-1], rank)
        live = best[unit] < never
        hit = np.flatnonzero(ok & (rank == best[unit[:-1]]))
        if len(hit):
            tied = pieces.tied[rows[at[hit]]]
            first = np.append(True, unit[hit[1:]] != unit[hit[:-1]])
            chain = np.append(True, (hit[1:] != hit[:-1] + 1) | first[1:])
            head = np.flatnonzero(chain)
            nth = np.arange(len(hit)) - head[np.cumsum(chain) - 1]
            hit = hit[np.where(tied, first, nth % 2 == 0)]
            size[hit] += size[hit + 1]
            stay = np.ones(len(unit), bool)
            stay[hit + 1] = False
        else:
            stay = np.ones(len(unit), bool)
        done.append((unit[~live], start[~live], size[~live]))
        stay &= live
        unit, start, size = unit[stay], start[stay], size[stay]
    unit, start, size = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start)
    unit, start, size = unit[order], start[order], size[order]
    key = start * wide + size
    at = np.minimum(np.searchsorted(edges, key), max(len(edges) - 1, 0))
    ids = np.where(size > 1, pieces.ids[rows[at]] if len(edges) else 0, -1).astype(np.int32)
    alone = np.flatnonzero(size == 1)
    values, which = np.unique(s[start[alone]], return_inverse=True)
    ones = [[i] if (i := pieces.single.get(chr(c))) is not None else [pieces.byte[x] for x in chr(c).encode()] for c in values.tolist()]
    many = np.array([len(x) for x in ones], np.int64)
    ids[alone] = np.array([x[0] for x in ones], np.int32)[which] if len(ones) else 0
    if (many > 1).any():  # bytes after the first one
        count = np.ones(len(ids), np.int64)
        count[alone] = many[which]
        ids, unit = np.repeat(ids, count), np.repeat(unit, count)
        to = (np.cumsum(count) - count)[alone]
        for v in np.flatnonzero(many > 1):
            for k, i in enumerate(ones[v][1:], 1):
                ids[to[which == v] + k] = i
    packed, ends = ids.tobytes(), (4 * np.cumsum(np.bincount(unit, minlength=len(units)))).tolist()
    return [packed[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def _edges(s: np.ndarray, dense: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in the dense alphabet; pieces with a character that the text lacks have none."""
    values = np.unique(s)
    at = np.minimum(np.searchsorted(values, pieces.text), len(values) - 1)
    inside = np.arange(pieces.longest) < pieces.size[:, None]
    there = ((values[at] == pieces.text) | ~inside).all(1)
    own = object.__new__(Pieces)
    own.size, own.longest, own.text = pieces.size[there], pieces.longest, at[there]
    key, row = occurrences(dense.astype(np.int64), own)
    return key, np.flatnonzero(there)[row]


class Encoder:
    """Encodes texts; remembers the units it has met, up to CACHE."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known, self.held = pieces, {}, 0

    def units(self, text: str) -> list[str]:
        return self.pieces.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = [self.units(t) for t in texts]
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        fresh = list(dict.fromkeys(u for x in lists for u in x if u not in self.known))
        if fresh:
            self.known.update(zip(fresh, encode_units(fresh, self.pieces), strict=True))
        out = [b"".join(map(self.known.__getitem__, x)) for x in lists]
        for u in fresh:
            if len(u) > LONG:
                del self.known[u]
            else:
                self.held += len(u) + OVERHEAD
        return out

    def decode(self, lists: list[bytes]) -> list[str]:
        p, ids = self.pieces, np.frombuffer(b"".join(lists), np.int32)
        size = p.said_size[ids]
        ends = np.append(0, np.cumsum(size))
        raw = p.said[np.arange(ends[-1]) + np.repeat(p.said_at[ids] - ends[:-1], size)].tobytes()
        cut = ends[np.cumsum([0, *[len(x) // 4 for x in lists]])].tolist()
        return [raw[a:z].decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ") for a, z in zip(cut, cut[1:], strict=False)]


#: The encoder of this worker process, by model: later tasks find the units that earlier ones have met.
_OWN: dict[str, Encoder] = {}
KEPT[__name__] = _OWN.clear


def encoder(model: str, shared) -> Encoder:
    if model not in _OWN:
        _OWN.clear()
        _OWN[model] = Encoder(shared.value)
    return _OWN[model]


def load(model: str) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: 6 if m.is_byte(i) else 3 if m.is_control(i) else 2 if m.is_unknown(i) else 1
    return Pieces([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.vocab_size())])


def _broadcast(spark: SparkSession, model: str):
    return bounded(spark).sparkContext.broadcast(load(model))  # a vocabulary, a few MB


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of docs, with __ids (packed int32, little endian). A null or empty text has no ids; repeated rows get equal ids."""
    table = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__rest"))
    shared = _broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model, shared)
        for b in chunks(batches, "__text", AT_ONCE):
            yield pa.RecordBatch.from_arrays([b.column("__rest"), pa.array(e.encode(b.column("__text").to_pylist()), pa.binary())], names=["__rest", "__ids"])

    return table.mapInArrow(tidy(run), with_rest(table, "__ids binary")).select(*beside(docs.columns, ["__ids"]))


def decode(encoded: DataFrame, ids_col: str = "__ids", model: str = MODEL) -> DataFrame:
    """All columns, with __decoded. A null list of ids decodes to an empty text."""
    table = encoded.select(F.coalesce(F.col(f"`{ids_col}`"), F.lit(b"")).alias("__packed"), F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("__rest"))
    shared = _broadcast(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model, shared)
        for b in chunks(batches, "__packed"):
            yield pa.RecordBatch.from_arrays([b.column("__rest"), pa.array(e.decode(b.column("__packed").to_pylist()), pa.string())], names=["__rest", "__decoded"])

    return table.mapInArrow(tidy(run), with_rest(table, "__decoded string")).select(*beside(encoded.columns, ["__decoded"]))


def report(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Encode and decode in one pass: n_tokens, ids_sha256 (of int32 ids), decoded_sha256, round_trip, beside the other columns.

    A text that itself holds the space mark (U+2581) decodes with spaces there, as in SentencePiece; round_trip tells.
    """
    table = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__rest"))
    shared = _broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model, shared)
        for b in chunks(batches, "__text", AT_ONCE):
            texts = b.column("__text").to_pylist()
            ids = e.encode(texts)
            back = e.decode(ids)
            yield pa.RecordBatch.from_arrays([
                b.column("__rest"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == t for a, t in zip(back, texts, strict=True)], pa.bool_()),
            ], names=["__rest", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return table.mapInArrow(tidy(run), with_rest(table, "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")).select(*beside([c for c in docs.columns if c != text_col], ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]))


def query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
