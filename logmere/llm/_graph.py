"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node that each reaches through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _locally(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Replace each stretch of a partition's edges by stars around its smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0

        def stars() -> pa.RecordBatch:
            nodes, root = forest(*[np.concatenate(x) for x in zip(*have, strict=True)])
            keep = nodes != root
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                have.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
                size += b.num_rows
            if size > most:
                yield stars()
                have, size = [], 0
        if have:
            yield stars()

    return edges.mapInArrow(tidy(run), "u long, v long")


def _settled(e: DataFrame) -> bool:
    """Every u has one v, and no v is a u: each edge leads to the smallest node of its component."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges (u long, v long), no nulls, any order and repeats, self loops ignored.

    Returns (node, root): each node that has an edge, and the smallest node of its component. Each round is
    written to the shared folder; only whether it has settled reaches the driver. The smallest neighbours are written
    before they are joined, so that Spark can split a node with very many edges.
    """
    e = written(_locally(edges.where("u <> v").select("u", "v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = written(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "down")
        lowest = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
