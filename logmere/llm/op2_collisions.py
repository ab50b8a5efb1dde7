"""Embedding near-dedup with collision-counting projections.

Unit vectors are projected on many directions. In each projection of a block, the other vectors are sorted and a
window around every query's value gives its collisions; a pair that collides in at least `needed` projections is
verified by its cosine in double precision. `needed` is calibrated: the largest count that keeps the wanted recall
on simulated pairs exactly at the threshold.

Blocks come from coarse projections as well: in each of several tables, a vector's block is the side it lies on in a few
further directions. The number of directions follows the number of vectors, so that blocks stay near BLOCK, and the number of
tables follows from it at the wanted recall; so each vector is in as many blocks as there are tables, and rows grow
nearly with the input (a power of 1.15 at 0.95), not with its square. Crowded blocks meet part by part. A pair counts in the first table where it
shares a block. Tasks report link counts and spanning stars, never all pairs. Vectors meet those of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, joined_by_key, partitions, tidy, written
from ._graph import components, forest

THRESHOLD = 0.95
PROJECTIONS, WINDOW, RECALL = 32, 0.25, 0.9995
BLOCK = 1024
#: Queries counted together, so that their counts stay in a core's cache.
STRIPE = 32


@cache
def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """Random orthogonal directions (in rounds of dim), scaled so that a unit vector projects with variance 1."""
    rng = np.random.default_rng(seed)
    rounds = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(rounds, 1)[:, :count] * np.sqrt(dim)


@cache
def needed(dim: int, threshold: float, count: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest collision count that a share `recall` of pairs at the threshold reach."""
    rng = np.random.default_rng(11)
    a = directions(dim, count, 7)
    x, y = (rng.standard_normal((20_000, dim)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * y
    hits = np.sort((np.abs((x - y) @ a) <= window).sum(1))
    return int(hits[int(len(hits) * (1 - recall))])


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y that link; i < j if both are the same block."""
    dim = x.shape[1]
    a = directions(dim, PROJECTIONS, 7)
    px, py = x @ a, y @ a
    rank = np.empty((PROJECTIONS, len(y)), np.uint16)  # a block has fewer than 2^16 rows
    low, width = np.empty((PROJECTIONS, len(x), 1), np.uint16), np.empty((PROJECTIONS, len(x), 1), np.uint16)
    for t in range(PROJECTIONS):
        order = np.argsort(py[:, t], kind="stable")
        rank[t, order] = np.arange(len(y))
        value = py[order, t]
        lo, hi = np.searchsorted(value, px[:, t] - WINDOW), np.searchsorted(value, px[:, t] + WINDOW, "right")
        low[t, :, 0], width[t, :, 0] = lo, hi - lo
    most, found = needed(dim, threshold), []
    for s in range(0, len(x), STRIPE):  # a window is a stretch of ranks: one subtraction and one comparison tell
        n = min(STRIPE, len(x) - s)
        count, gap, hit = np.zeros((n, len(y)), np.uint8), np.empty((n, len(y)), np.uint16), np.empty((n, len(y)), bool)
        for t in range(PROJECTIONS):
            np.subtract(rank[t], low[t, s : s + n], out=gap)
            np.less(gap, width[t, s : s + n], out=hit)
            np.add(count, hit.view(np.uint8), out=count)
        i, j = np.nonzero(count >= most)
        found.append((i + s, j))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    if same:
        i, j = i[i < j], j[i < j]
    keep = [np.zeros(0, np.int64)]
    for s in range(0, len(i), 1 << 16):
        c = np.einsum("ij,ij->i", x[i[s : s + (1 << 16)]], y[j[s : s + (1 << 16)]])
        keep.append(s + np.flatnonzero(c >= threshold))
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def tables(total: int, threshold: float, block: int = BLOCK, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many vectors: sides that name a block, and tables so that a pair at the threshold shares a block of one."""
    bits = max(0, int(np.ceil(np.log2(max(1, total) / block))))
    same = (1 - np.arccos(min(1.0, max(-1.0, threshold))) / np.pi) ** bits
    return bits, 1 if same > 1 - 1e-12 else int(np.ceil(np.log(1 - recall) / np.log(1 - same)))


def sides(x: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The block of each unit vector in each table, as (rows, count) numbers."""
    if not bits:
        return np.zeros((len(x), count), np.int64)
    up = x @ np.random.default_rng(13).standard_normal((x.shape[1], bits * count)) > 0
    return (up.reshape(len(x), count, bits).astype(np.int64) << np.arange(bits)).sum(2)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. Vectors of every length take
    part; those of unlike lengths don't link. Repeated rows link with each other. Other columns are ignored. An empty table gives one.
    """
    spark = bounded(vectors.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                x = np.array([np.nan if e is None else e for e in v or []], np.float64)
                big = np.abs(x).max(initial=0)
                out.append((x / big).tobytes() if len(x) and np.isfinite(x).all() and big > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "x"])

    packed = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).mapInArrow(tidy(pack), "vec_id long, x binary")
    table = written(packed.withColumn("name", F.unhex(F.md5("x"))), "vectors")
    # Equal vectors are one node with a weight, so a vector that a third of all rows hold is compared once.
    nodes = table.where("x IS NOT NULL").groupBy("name").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    nodes = written(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    # Of d lengths, the vectors hold d^2 / 2 components at least: few, whatever the corpus.
    shape = {r["dim"]: tables(r["count"], threshold, block) for r in nodes.groupBy((F.octet_length("x") / 8).cast("int").alias("dim")).count().collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, raw = b.column("uid").to_numpy(), b.column("x").to_pylist()
            dims = np.array([len(r) // 8 for r in raw], np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes = sides(unit([raw[i] for i in at]), *shape[int(dim)])
                turn = np.tile(np.arange(codes.shape[1], dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uid[at], codes.shape[1])), pa.array(np.full(codes.size, dim, np.int32)), pa.array(turn), pa.array(codes.reshape(-1))], names=["uid", "dim", "turn", "code"])

    cell = ["dim", "turn", "code"]
    light = written(nodes.select("uid", "x").mapInArrow(tidy(place), "uid long, dim int, turn int, code long"), "places")
    shared = written(light.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*cell, F.ceil(F.col("m") / (2 * block)).cast("int").alias("splits")), "blocks")
    part = F.pmod(F.xxhash64("uid"), F.col("splits")).cast("int")
    tiles = light.join(shared, cell).select("uid", *cell, part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("other"))
    tiles = tiles.select("uid", *cell, "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    rows = tiles.join(nodes.select("uid", "n", "x"), "uid")

    def tile(key, t):  # two parts of a block at most
        turn, one, two = key[1].as_py(), key[3].as_py(), key[4].as_py()
        part, uid, n = t.column("part").to_numpy(), t.column("uid").to_numpy(), t.column("n").to_numpy()
        x = unit(t.column("x").to_pylist())
        first = np.flatnonzero(part == one)
        second = np.flatnonzero(part == two) if one != two else first
        i, j = block_links(x[first], x[second], second is first, threshold) if len(first) and len(second) else (first[:0], first[:0])
        i, j = first[i], second[j]
        if turn and len(i):
            codes = sides(x, *shape[x.shape[1]])[:, :turn]
            new = np.concatenate([~(codes[i[s : s + 4096]] == codes[j[s : s + 4096]]).any(1) for s in range(0, len(i), 4096)])
            i, j = i[new], j[new]
        node, root = forest(uid[i], uid[j])
        links = np.bincount(np.searchsorted(node, np.concatenate([uid[i], uid[j]])), np.concatenate([n[j], n[i]]), len(node)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64()), pa.array(links, pa.int64())], names=["uid", "root", "links"])

    group = [*cell, "one", "two"]
    found = rows.select(*group, "part", "uid", "n", "x").repartition(partitions(spark), *group).groupBy(*group).applyInArrow(tile, "uid long, root long, links long")
    found = written(found, "links")
    counts = found.groupBy("uid").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    facts = nodes.select("name", "uid", "n", "least").join(roots.withColumnRenamed("node", "uid"), "uid", "left").join(counts, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    facts = written(facts, "facts")
    least = written(facts.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    facts = written(joined_by_key(facts, least, "root", F.col("uid")).select("name", "n", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")), "answers")
    out = joined_by_key(table.where("x IS NOT NULL"), facts, "name", F.encode(F.col("vec_id").cast("string"), "utf-8")).select("vec_id", "n_links", "component_id")
    out = out.union(table.where("x IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT c.node AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.node = c.component_id AS kept FROM c LEFT JOIN n ON n.u = c.node
"""
