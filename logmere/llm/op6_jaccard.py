"""N-gram Jaccard join with set relations.

A document's set is its distinct k-word shingles, sorted by hash. Sets that are equal are one node.

1. Sift. Linked sets share much of the first 10 + (100 - percent) % of their shingles in hash order. Each set asks how often
   these occur in the corpus; a set with too few shared ones links with no other set and is done.
2. The sets that are left ask for the counts of all their shingles, among themselves. A set with more shingles of its own
   than a link may miss is done. Shingles in order of (count, hash) give each set a prefix that meets every link.
3. Set relations. In the index list of each prefix shingle the set with the least share of shingles of its own leads; every
   member is compared with it once, which gives their exact distance (shingles that one has and the other lacks).
   Distances obey the triangle inequality, so the answers of the leader give those of its members: two members
   link if their distances to it add up to little enough, and don't if these differ by too much.
4. What the leaders' links connect takes one label, and lists of one label are answered. In the others, sorted by size and
   position, each set skips in blocks to the sizes it can link with, and within each size to the prefix positions that leave
   enough overlap. Pairs that neither the leader's distances, the shingles of their own, nor parity bits decide are compared.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, Words, bounded, chunks, joined_by_key, mix, partitions, tidy, written
from ._counts import CHUNK_KEYS, counted
from ._graph import components, forest

SHINGLE = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
#: A leader's set is copied once for so many of its pairs; lists longer than SPLIT meet block by block.
SALT, SPLIT = 500, 50_000


def shingle_sets(texts: list[str], words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; a shorter text is one shingle, an empty one none."""
    lists = [words.split(t) for t in texts]
    h = words.hashes([w for x in lists for w in x])[:, 0]
    out, at = [], 0
    for x in lists:
        own = h[at : at + len(x)]
        at += len(x)
        if not len(own):
            out.append(own)
            continue
        n = max(1, len(own) - k + 1)
        acc = np.full(n, min(len(own), k), np.uint64)
        for j in range(min(k, len(own))):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n])
        out.append(np.unique(acc))
    return out


def least_linked(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest size that a set of size n can link with, and its smallest intersection."""
    return -(-n * percent // 100)


def least_size(percent: int) -> int:
    """Sets below this size link with equal sets only."""
    smallest = 1
    while smallest < 1000 and least_linked(np.array(smallest + 1), percent) > smallest:
        smallest += 1
    return smallest


def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """n: the sum of two sizes; the largest distance of linked sets."""
    return n * (100 - percent) // (100 + percent)


def spare(n: np.ndarray) -> np.ndarray:
    """How many shingles two linked sets share at least in their sifted prefixes, for the smaller of their sizes."""
    return np.maximum(1, n // 10)


def sifted(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of a sifted prefix: without the first `spare` - 1 shared shingles a set would miss more than a link may."""
    return np.minimum(n, n - least_linked(n, percent) + spare(n))


DESCRIBED = "doc_id long, th long, sid binary, n long, chunk long, sids binary, sizes binary, tokens binary"
FIELDS = [x.split()[0] for x in DESCRIBED.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


class Chunk:
    """Sets that are gathered for one row: their digests, sizes and shingles."""

    def __init__(self):
        from pyspark import TaskContext

        self.number = TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self) -> None:
        self.sids, self.sizes, self.tokens, self.many = [], [], [], 0

    def add(self, sid: bytes, size: int, tokens: np.ndarray) -> None:
        self.sids.append(sid)
        self.sizes.append(size)
        self.tokens.append(tokens)
        self.many += len(tokens)

    def row(self) -> list:
        """(chunk, sids, sizes, tokens); the chunk is empty afterwards."""
        out = [self.number, b"".join(self.sids), np.array(self.sizes, np.int32).tobytes(), np.concatenate(self.tokens).tobytes()]
        self.number += 1
        self.clear()
        return out


def describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One pass over (doc_id, th, text). A row for each document (doc_id, th, sid, n), and a row for each chunk of distinct sets
    that can link with unequal ones (chunk, sids, sizes, tokens: their sifted prefixes)."""
    smallest = least_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk, met = Words(lower=True), Chunk(), set()

        def flush() -> pa.RecordBatch:
            met.clear()
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in KINDS[:4]], *[pa.array([v], t) for v, t in zip(chunk.row(), KINDS[4:], strict=True)]], names=FIELDS)

        for b in chunks(batches, "text"):
            sets = shingle_sets(b.column("text").to_pylist(), words, k)
            sids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            n = np.array([len(s) for s in sets], np.int64)
            for s, sid, m in zip(sets, sids, sifted(n, percent), strict=True):
                if len(s) >= smallest and sid not in met:
                    met.add(sid)
                    chunk.add(sid, len(s), s[:m])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(sids, pa.binary()), pa.array(n), *[pa.nulls(len(sets), t) for t in KINDS[4:]]], names=FIELDS)
            if chunk.many >= CHUNK_KEYS:
                yield flush()
        if chunk.sids:
            yield flush()

    return docs.mapInArrow(tidy(run), DESCRIBED)


def parts_of(row: dict, length: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sizes of a chunk's sets, where each one's tokens begin, and the digests."""
    n = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
    return n, np.append(0, np.cumsum(length(n))), [row["sids"][16 * i : 16 * i + 16] for i in range(len(n))]


def sift(described: DataFrame, percent: int) -> DataFrame:
    """(sid): sets that may link with an unequal one; a set may come twice."""

    def judge(row: dict, count: np.ndarray) -> pa.RecordBatch:
        n, at, sids = parts_of(row, lambda n: sifted(n, percent))
        shared = np.add.reduceat((count > 1).astype(np.int64), at[:-1])
        keep = np.flatnonzero(shared >= spare(least_linked(n, percent)))
        return pa.RecordBatch.from_arrays([pa.array([sids[i] for i in keep], pa.binary())], names=["sid"])

    return counted(described.where("chunk IS NOT NULL").select("chunk", "sids", "sizes", "tokens"), judge, "sid binary")


def whole_sets(docs: DataFrame, described: DataFrame, k: int, percent: int) -> DataFrame:
    """Chunks of the sifted sets with all their shingles. One document's text of each set is read again: docs must give the
    same rows twice, as a table does."""
    firsts = described.where(f"chunk IS NULL AND n >= {least_size(percent)}").groupBy("sid").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "th")).alias("f"))
    chosen = written(firsts.join(sift(described, percent).distinct(), "sid").select("sid", "f.*"), "sifted")
    texts = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID))).join(chosen, ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.first("sid").alias("sid"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk = Words(lower=True), Chunk()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(chunk.row(), KINDS[4:], strict=True)], names=FIELDS[4:])
        for b in chunks(batches, "text"):
            for s, sid in zip(shingle_sets(b.column("text").to_pylist(), words, k), b.column("sid").to_pylist(), strict=True):
                chunk.add(sid, len(s), s)
                if chunk.many >= CHUNK_KEYS:
                    yield flush()
        if chunk.sids:
            yield flush()

    return written(texts.select("text", "sid").mapInArrow(tidy(gather), "chunk long, sids binary, sizes binary, tokens binary"), "whole")


NEAR = "sid binary, n long, uniq long, sketch binary, tokens array<long>, shingles binary"


def near_sets(whole: DataFrame, percent: int) -> DataFrame:
    """Sets that share enough with others, with a number each: size, how many shingles are their own, parity bits, the shared shingles
    of the prefix from position uniq + 1 on, and all shingles."""

    def judge(row: dict, count: np.ndarray) -> pa.RecordBatch | None:
        n, at, sids = parts_of(row, lambda n: n)
        tokens, out = np.frombuffer(row["tokens"], np.uint64), []
        for i, sid in enumerate(sids):
            s, c = tokens[at[i] : at[i + 1]], count[at[i] : at[i + 1]]
            own, most = int((c == 1).sum()), int(n[i] - least_linked(n[i], percent)) + 1
            if own < most:
                out.append((sid, int(n[i]), own, parity(s).tobytes(), s[np.lexsort((s, c))[own:most]].view(np.int64), s.tobytes()))
        if not out:
            return None
        cols = list(zip(*out, strict=True))
        ends = np.append(0, np.cumsum([len(t) for t in cols[4]])).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.ListArray.from_arrays(ends, np.concatenate(cols[4])), pa.array(cols[5], pa.binary())], names=[x.split()[0] for x in NEAR.split(", ")])

    return written(counted(whole, judge, NEAR).withColumn("uid", F.monotonically_increasing_id()), "near")


def distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart, linked) of pairs (a, b) of uids. Frequent a's are salted, so one popular leader does not meet all its pairs in one task."""
    many = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts")), "salts")
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    left = many.select(F.col("a").alias("uid"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets, "uid").select(F.col("uid").alias("a"), "salt", F.col("shingles").alias("s"))
    right = salted.join(sets.withColumnRenamed("uid", "b"), "b").select("a", "salt", "b", F.col("shingles").alias("t"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for b in batches:
            apart, linked = [], []
            for i, s, t in zip(b.column("a").to_pylist(), b.column("s"), b.column("t"), strict=True):
                if i not in kept:
                    kept[i] = np.frombuffer(s.as_py(), np.uint64)
                    if len(kept) > 16:
                        kept.popitem(last=False)
                x, y = kept[i], np.frombuffer(t.as_py(), np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                apart.append(len(x) + len(y) - 2 * both)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(apart, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "apart", "linked"])

    return right.join(left, ["a", "salt"]).select("a", "b", "s", "t").mapInArrow(tidy(test), "a long, b long, apart long, linked boolean")


def parity(s: np.ndarray) -> np.ndarray:
    """256 bits; sets that differ in d shingles differ in d bits at most."""
    bits = np.bincount((s * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def list_pairs(token: np.ndarray, sid: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, sketch: np.ndarray, percent: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of index lists: equal tokens, different labels; sizes, positions and parities that can link."""
    for i, j in met(token, sid, n, pos, label, sketch, percent, most):
        yield np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])


def met(token: np.ndarray, sid: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, sketch: np.ndarray, percent: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of such pairs."""
    order = np.lexsort((sid, pos, n, token))
    token, sid, n, pos, label, sketch = (x[order] for x in (token, sid, n, pos, label, sketch))
    new = np.append(True, token[1:] != token[:-1]) if len(token) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first) if len(first) else np.zeros(0, bool)
    live = np.flatnonzero(mixed[group])  # lists of one label are answered
    if not len(live):
        return
    order, n, pos, label, group, sketch = (x[live] for x in (order, n, pos, label, group, sketch))
    # sizes are sorted within a list: skip to the end of those that can link
    wide, tall = int(n.max()) + 1, int(pos.max()) + 1
    key = group * wide + n
    last = np.searchsorted(key, group * wide + np.minimum(n * 100 // percent, wide - 1), "right")
    # positions are sorted within a stretch of one size: skip to the end of those that leave enough overlap
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    stretch = np.searchsorted(first, np.arange(len(n)), "right") - 1
    place = stretch * tall + pos
    spans = stretch[last - 1] - stretch + 1
    done = np.cumsum(spans)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, "right")))
        c = spans[start:stop]
        i = np.repeat(np.arange(start, stop), c)
        s = stretch[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        size = n[first[s]]
        need = -(-(n[i] + size) * percent // (100 + percent))
        lo = np.maximum(first[s], i + 1)
        count = np.searchsorted(place, s * tall + np.minimum(1 + size - need, tall - 1), "right") - lo
        ok = (count > 0) & (1 + n[i] - pos[i] >= need)
        yield from _met(i[ok], lo[ok], count[ok], order, n, label, sketch, percent, most)
        start = stop


def _met(left: np.ndarray, lo: np.ndarray, count: np.ndarray, row: np.ndarray, n: np.ndarray, label: np.ndarray, sketch: np.ndarray, percent: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of left[x] with the count[x] rows from lo[x] on; at most `most` at a time."""
    done = np.cumsum(count)
    start = 0
    while start < len(left):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + most, "right")))
        for skip in range(0, int(count[start]) if stop == start + 1 else 1, most):  # one long stretch at a time
            c = count[start:stop] if stop > start + 1 else np.minimum(count[start:stop] - skip, most)
            i = np.repeat(left[start:stop], c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[start:stop], c) + skip
            ok = label[i] != label[j]
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1)  # no more than the sets' difference
            ok = apart <= most_apart(n[i] + n[j], percent)
            i, j = i[ok], j[ok]
            yield row[i], row[j]
        start = stop


def jaccard_links(near: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v) long: links between distinct sets (or their labels' first sets), enough to connect all sets that any chain of links connects."""
    parts = partitions(near.sparkSession)
    sets = near.select("uid", "shingles")
    lists = near.select("uid", "n", "uniq", "sketch", F.posexplode("tokens").alias("at", "token")).withColumn("pos", F.col("at") + F.col("uniq") + 1).drop("at")
    best = lists.groupBy("token").agg(F.min(F.struct((F.col("uniq") / F.col("n")).alias("share"), "uid")).alias("best"), F.count(F.lit(1)).alias("members"))
    leaders = written(best.where("members > 1").select("token", F.col("best.uid").alias("lead")), "leaders")
    stars = lists.select("uid", "token").join(leaders, "token").where("uid <> lead").select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct()
    far = written(distances(stars, sets, percent), "stars")
    own = far.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = components(own)
    labels = written(near.select("uid").join(named.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("root", "uid").alias("label")), "labels")

    labelled = lists.select("token", "uid").join(labels, "uid")
    mixed = written(labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("splits")).where("lo < hi").select("token", "splits"), "mixed")
    told = far.select(F.col("a").alias("lead"), F.col("b").alias("uid"), "apart")
    rows = lists.join(mixed, "token").join(leaders, "token").join(labels, "uid").join(told, ["lead", "uid"], "left")
    side = F.pmod(F.xxhash64("uid"), F.col("splits")).cast("int")
    rows = rows.select("token", "uid", "n", "pos", "uniq", "label", F.coalesce("apart", F.lit(0)).alias("apart"), "sketch", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("other"))
    rows = rows.withColumn("one", F.least("side", "other")).withColumn("two", F.greatest("side", "other")).drop("other")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = list(batches)
        if not sum(b.num_rows for b in have):
            return
        t = pa.Table.from_batches(have)
        token, uid, n, pos, uniq, label, apart, side, one, two = (t.column(c).to_numpy() for c in ("token", "uid", "n", "pos", "uniq", "label", "apart", "side", "one", "two"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, 4)
        lists = np.unique(np.stack([token, one, two], 1), axis=0, return_inverse=True)[1].reshape(-1)
        sure, open_ = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for i, j in met(lists, uid, n.astype(np.int64), pos.astype(np.int64), label, sketch, percent):
            bound = most_apart(n[i] + n[j], percent)
            ok = ((one[i] == two[i]) | (side[i] != side[j])) & (uniq[i] + uniq[j] <= bound) & (np.abs(apart[i] - apart[j]) <= bound)
            i, j, bound = i[ok], j[ok], bound[ok]
            close = apart[i] + apart[j] <= bound  # the leader's answers tell
            sure.append(np.unique(np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])], 1)[close], axis=0))
            pair = np.stack([np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])], 1)[~close]
            names = np.stack([label[i], label[j]], 1)[~close]
            open_.append(np.unique(np.concatenate([pair, names], 1), axis=0) if len(pair) else pair)
        node, root = forest(*np.concatenate(sure).T)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64()), pa.array([True] * len(node), pa.bool_())], names=["a", "b", "sure"])
        root_of = lambda x: np.where(np.isin(x, node), root[np.minimum(np.searchsorted(node, x), len(node) - 1)], x) if len(node) else x
        for p in (p for p in open_ if len(p)):
            p = p[root_of(p[:, 2]) != root_of(p[:, 3])]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array([False] * len(p), pa.bool_())], names=["a", "b", "sure"])

    pairs = written(rows.repartition(parts, "token", "one", "two").mapInArrow(tidy(meet), "a long, b long, sure boolean").distinct(), "pairs")
    compared = distances(pairs.where("NOT sure").select("a", "b"), sets, percent).where("linked")
    return own.union(pairs.where("sure").select("a", "b")).union(compared.select("a", "b"))


def grouped(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(doc_id, th, n, root, component_id) of each row: the text's hash, the set's size, a name of the group and its smallest id."""
    bounded(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    described = written(describe(d, k, percent), "sets")
    near = near_sets(whole_sets(d, described, k, percent), percent)
    rooted = components(jaccard_links(near, percent))
    rows = described.where("chunk IS NULL").select("doc_id", "th", "sid", "n")
    firsts = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"))
    sid_of = near.select("uid", "sid")
    roots = rooted.join(sid_of.withColumnRenamed("uid", "node"), "node").select("sid", "root").join(sid_of.select(F.col("uid").alias("root"), F.col("sid").alias("name")), "root").select("sid", "name")
    named = written(firsts.join(roots, "sid", "left").select("sid", "least", "times", F.coalesce("name", "sid").alias("name")), "named")
    least = named.groupBy("name").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    answer = joined_by_key(named.select("sid", "times", "name"), written(least, "least"), "name", F.col("sid"))
    answer = written(answer.select("sid", "name", "component_id", F.col("times").alias("n")), "answers")
    out = joined_by_key(rows.where("n > 0"), answer, "sid", F.encode(F.col("doc_id").cast("string"), "utf-8")).select("doc_id", "th", "n", F.col("name").alias("root"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", "th", "n", F.lit(None).cast("binary"), "doc_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links reach.

    A null or wordless text has an empty set and links with nothing; rows that repeat a text link with each other;
    a null id takes part and is never the smallest unless all ids of its group are null. Other columns are ignored. An empty
    table gives one.
    """
    return grouped(docs, id_col, text_col, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def without_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest id, of several such that with the smallest text hash.

    Rows are told apart by id and text, so two rows of one id with unlike texts are judged each for itself; of rows that repeat
    both, one stays. Rows with a null id stay. Wordless and null texts stay. All columns are kept, whatever their names.
    """
    rows = written(grouped(docs, id_col, text_col, k, percent).where("root IS NOT NULL AND doc_id IS NOT NULL"), "rows")
    first = written(rows.groupBy("root").agg(F.min(F.expr("CASE WHEN doc_id = component_id THEN th END")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    keys = joined_by_key(rows, first, "root", F.encode(F.col("doc_id").cast("string"), "utf-8")).groupBy("doc_id", "th").agg(F.max((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("first"))).alias("stays"), F.count(F.lit(1)).alias("times"))
    odd = written(keys.where("NOT stays OR times > 1"), "odd")
    key = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("th")]
    packed = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = packed.join(odd, ["doc_id", "th"], "left_anti").select("row.*")
    twice = odd.where("stays")
    if not twice.isEmpty():
        out = out.union(packed.join(twice, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.first("row").alias("row")).select("row.*"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
