"""Order-dependent operators that never put one key, or a whole table, into one task.

A window over a long order is cut into buckets of `width` consecutive positions. What a bucket needs of those
before it is one row per bucket, carried over by a window on the bucket table (rows / width rows).
Positions (`on`) are non-negative longs, unique within `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20


def _carried(df: DataFrame, by: list[str], on: str, width: int, part: Column, total: Column) -> DataFrame:
    """df with __bucket and __carry: `total` over the buckets before, where `part` sums a bucket up as __part."""
    b = df.withColumn("__bucket", F.floor(F.col(on) / width).cast("long"))
    sums = b.groupBy(*by, "__bucket").agg(part.alias("__part"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*by, "__bucket", total.over(before).alias("__carry"))
    keys = [b[c].eqNullSafe(carry[c]) for c in by] + [b["__bucket"] == carry["__bucket"]]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    return b.join(carry, cond).select(b["*"], carry["__carry"])


def _within(by: list[str], on: str):
    return Window.partitionBy(*by, "__bucket").orderBy(on)


def previous(df: DataFrame, by: list[str], on: str, column: str, name: str, width: int = WIDTH) -> DataFrame:
    """`name`: the value of `column` in the row before, in order of `on`; null in the first row."""
    c = _carried(df, by, on, width, F.max_by(F.struct(column), on), F.last("__part"))
    w = _within(by, on)
    value = F.when(F.row_number().over(w) == 1, F.col("__carry")[column]).otherwise(F.lag(column).over(w))
    return c.withColumn(name, value).drop("__bucket", "__carry")


def running_max(df: DataFrame, by: list[str], on: str, column: str, name: str, width: int = WIDTH, before: bool = False) -> DataFrame:
    """`name`: the largest `column` so far; with `before`, of the rows before this one only."""
    c = _carried(df, by, on, width, F.max(column), F.max("__part"))
    w = _within(by, on).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    return c.withColumn(name, F.greatest("__carry", F.max(column).over(w))).drop("__bucket", "__carry")


def running_sum(df: DataFrame, by: list[str], on: str, column: Column, name: str, width: int = WIDTH) -> DataFrame:
    """`name`: the sum of `column` up to and with this row."""
    c = _carried(df.withColumn("__x", column), by, on, width, F.sum("__x"), F.sum("__part"))
    w = _within(by, on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.withColumn(name, F.coalesce("__carry", F.lit(0)) + F.sum("__x").over(w)).drop("__bucket", "__carry", "__x")


def numbered(df: DataFrame, by: list[str], on: str, name: str, width: int = WIDTH) -> DataFrame:
    """`name`: 1, 2, ... in order of `on`."""
    return running_sum(df, by, on, F.lit(1).cast("long"), name, width)


def running_last(df: DataFrame, by: list[str], on: str, column: str, name: str, width: int = WIDTH) -> DataFrame:
    """`name`: the last non-null `column` up to this row."""
    present = F.when(F.col(column).isNotNull(), F.col(on))
    c = _carried(df, by, on, width, F.max_by(column, present), F.last("__part", ignorenulls=True))
    w = _within(by, on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(w), F.col("__carry"))).drop("__bucket", "__carry")


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, width: int = WIDTH) -> DataFrame:
    """left with the columns of the latest right row of its key at or before it; left rows without one go.

    Both sides meet by one union and a bucketed scan, not by a range join. `on` is unique among right rows of a key.
    """
    cols = [c for c in right.columns if c not in by and c != on]
    l = left.select(*by, (F.col(on) * 2 + 1).alias("__at"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("__r"))
    r = right.select(*by, (F.col(on) * 2).alias("__at"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(*cols).alias("__r"))
    met = running_last(l.unionByName(r), by, "__at", "__r", "__latest", 2 * width).where("__l IS NOT NULL AND __latest IS NOT NULL")
    return met.select("__l.*", *[F.col("__latest")[c].alias(c) for c in cols])


def rolling(df: DataFrame, on: str, rows: int, aggregates: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Aggregates over this row and the rows - 1 before it; `on` is dense. The end of a bucket is copied to the next one."""
    if rows > width:
        raise ValueError("a bucket must hold the window")
    b = F.floor(F.col(on) / width).cast("long")
    own = df.withColumn("__bucket", b).withColumn("__halo", F.lit(False))
    halo = df.where(F.col(on) % width > width - rows).withColumn("__bucket", b + 1).withColumn("__halo", F.lit(True))
    w = Window.partitionBy("__bucket").orderBy(on).rowsBetween(1 - rows, Window.currentRow)
    both = own.unionByName(halo)
    return both.select("*", *[a.over(w).alias(n) for n, a in aggregates.items()]).where("NOT __halo").drop("__bucket", "__halo")


def islands(df: DataFrame, by: list[str], on: str, starts: Column, name: str, width: int = WIDTH) -> DataFrame:
    """`name`: a number for each stretch of rows; `starts` is true where a new one begins."""
    return running_sum(df, by, on, F.when(starts, 1).otherwise(0).cast("long"), name, width)
