"""Scans, watermarks, quorum and replay over a change log (lsn, ts, origin_node, tbl, pk, op, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def scan_from(log: DataFrame, lsn: int) -> DataFrame:
    return log.where(F.col("lsn") >= lsn)


def scan_range(log: DataFrame, first: int, last: int) -> DataFrame:
    return log.where(F.col("lsn").between(first, last))


def scan_batch(log: DataFrame, lsn: int, most: int) -> DataFrame:
    return scan_from(log, lsn).orderBy("lsn").limit(most)


def get(log: DataFrame, lsn: int) -> DataFrame:
    return log.where(F.col("lsn") == lsn)


def key_equals(key: dict) -> Column:
    """All columns of a key equal their values; a null value is met by null."""
    out = F.lit(True)
    for c, v in key.items():
        out = out & F.col(c).eqNullSafe(F.lit(v))
    return out


def segment_of(lsn: str, size: int) -> Column:
    return F.floor((F.col(lsn) - 1) / size).cast("long")


def segments(log: DataFrame, size: int) -> DataFrame:
    """One row for each segment of `size` positions."""
    return log.groupBy(segment_of("lsn", size).alias("segment")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("entries"))


def floor_segment(points: DataFrame, segs: DataFrame, lsn: str, size: int) -> DataFrame:
    """Points with the segment whose first_lsn is the greatest at or below them; points before any segment go."""
    s = segs.select(F.col("first_lsn").alias(lsn), "segment", "first_lsn")
    return ordered.as_of(points, s, [], lsn)


def ends(log: DataFrame) -> DataFrame:
    return log.agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("entries"))


def watermark(log: DataFrame) -> DataFrame:
    """Highest position of each table."""
    return log.groupBy("tbl").agg(F.max("lsn").alias("last_lsn"))


def node_progress(log: DataFrame) -> DataFrame:
    return log.groupBy("origin_node").agg(F.max("lsn").alias("last_applied_lsn"), F.max("ts").alias("last_heartbeat"))


def latest_op(changes: DataFrame, version: int) -> DataFrame:
    """Of each path changed after `version`: its last version and whether that deleted it."""
    c = changes.where(F.col("version") > version)
    return c.groupBy("path").agg(F.max("version").alias("version"), F.max_by("is_deleted", "version").alias("is_deleted"))


def delta_or_full(changes: DataFrame, asked: DataFrame, keep: int) -> DataFrame:
    """For each asked version: empty, full or delta, when only the last `keep` versions are kept."""
    have = changes.agg(F.max("version").alias("newest"), F.min("version").alias("first"))
    have = have.withColumn("oldest", F.greatest("first", F.col("newest") - keep + 1))
    how = F.when(F.col("from_version") == 0, "full").when(F.col("from_version") == F.col("newest"), "empty").when(F.col("from_version") < F.col("oldest"), "full").otherwise("delta")
    return asked.join(F.broadcast(have)).select("from_version", how.alias("answer"))  # one row


def last_n(log: DataFrame, n: int) -> DataFrame:
    """The last n entries of each table: the last n of each stretch of positions, then of those."""
    w = Window.partitionBy("tbl").orderBy(F.desc("lsn"))
    stretch = Window.partitionBy("tbl", F.floor(F.col("lsn") / ordered.WIDTH)).orderBy(F.desc("lsn"))
    first = log.withColumn("rank", F.row_number().over(stretch)).where(F.col("rank") <= n)
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def gaps(log: DataFrame, by: list[str], width: int = ordered.WIDTH) -> DataFrame:
    """Entries whose predecessor is not the position before."""
    return ordered.previous(log, by, "lsn", "lsn", "prev_lsn", width).where("lsn - prev_lsn <> 1")


def regressions(log: DataFrame, by: list[str], value: str, width: int = ordered.WIDTH) -> DataFrame:
    """Entries whose value is below the one before."""
    return ordered.previous(log, by, "lsn", value, "prev_value", width).where(F.col(value) < F.col("prev_value"))


def rates(log: DataFrame, by: list[str], width: int = ordered.WIDTH) -> DataFrame:
    """Positions per second since the entry before; null where no time has passed."""
    one = ordered.previous(log.withColumn("__x", F.struct("lsn", "ts")), by, "lsn", "__x", "prev", width)
    s = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev.ts").cast("timestamp"))) / 1e6
    return one.withColumn("seconds", s).withColumn("rate", F.when(F.col("seconds") > 0, (F.col("lsn") - F.col("prev.lsn")) / F.col("seconds"))).drop("__x", "prev")


def assign_lsn(entries: DataFrame, on: str, start: int = 0, width: int = ordered.WIDTH) -> DataFrame:
    """Dense positions after `start` in order of `on`; a noop gets none and goes."""
    return ordered.numbered(entries.where("op <> 'noop'"), [], on, "new_lsn", width).withColumn("new_lsn", F.col("new_lsn") + start)


def quorum(n: Column) -> Column:
    return (F.floor(n / 2) + 1).cast("long")


def commit_lsn(progress: DataFrame, column: str = "last_applied_lsn") -> DataFrame:
    """The quorum-th largest position. progress: a row for each node of one cluster."""
    top = progress.agg(F.sort_array(F.collect_list(column), asc=False).alias("m"))
    return top.select(F.element_at("m", quorum(F.size("m")).cast("int")).alias("commit_lsn"), F.size("m").cast("long").alias("nodes"), quorum(F.size("m")).alias("quorum"))


def acknowledged(log: DataFrame, progress: DataFrame) -> DataFrame:
    """(lsn, acks, committed) of each entry; the nodes' positions travel as one array."""
    m = progress.agg(F.collect_list("last_applied_lsn").alias("m"))
    acks = F.size(F.filter("m", lambda x: x >= F.col("lsn"))).cast("long")
    return log.select("lsn").join(F.broadcast(m)).select("lsn", acks.alias("acks"), (acks >= quorum(F.size("m"))).alias("committed"))


def replay(log: DataFrame, key: list[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The rows that a log leaves: insert (fails on a present key), update (of a present key), delete, upsert.

    columns: value column -> (flag that an update sets it, flag that an upsert overwrites it). A key's history
    before its last delete is void; born is its first insert or upsert after that. A column has the value of the last
    entry that assigned it, nulls included. All steps are grouped maxima and minima, which combine before the
    shuffle, so a key with a third of all entries is no hot task.
    """
    dead = log.where("op = 'delete'").groupBy(*key).agg(F.max("lsn").alias("__dead"))
    live = log.where("op <> 'delete' AND op <> 'noop'").join(dead, key, "left").where("__dead IS NULL OR lsn > __dead").drop("__dead")
    born = live.where("op IN ('insert', 'upsert')").groupBy(*key).agg(F.min("lsn").alias("born_lsn"))
    on = live.join(born, key).where("lsn >= born_lsn")
    out = []
    for c, (by_update, by_upsert) in columns.items():
        assigns = (F.col("lsn") == F.col("born_lsn")) | ((F.col("op") == "update") & F.col(by_update)) | ((F.col("op") == "upsert") & F.col(by_upsert))
        out.append(F.max_by(F.struct(c), F.when(assigns, F.col("lsn")))[c].alias(c))
    return on.groupBy(*key).agg(F.min("born_lsn").alias("born_lsn"), *out)


def last_row(log: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Whole-row last-wins: each key's last entry unless it deletes."""
    last = log.groupBy(*key).agg(F.max_by(F.struct("lsn", "op", *columns), "lsn").alias("r"))
    return last.where("r.op <> 'delete'").select(*key, "r.lsn", *[f"r.{c}" for c in columns])


def statuses(log: DataFrame, key: list[str], width: int = ordered.WIDTH) -> DataFrame:
    """log with `status`, of entries in order: applied, failed (an insert of a present key), empty (an update or delete of an
    absent one) or skipped (noop). A failure stops nothing, the next entries go on."""
    state = F.when(F.col("op").isin("insert", "upsert", "delete"), F.col("op") != "delete")
    so_far = ordered.running_last(log.withColumn("__state", state), key, "lsn", "__state", "__now", width)
    p = ordered.previous(so_far, key, "lsn", "__now", "__before", width)
    there = F.coalesce("__before", F.lit(False))
    status = F.when(F.col("op") == "noop", "skipped").when((F.col("op") == "insert") & there, "failed").when(F.col("op").isin("update", "delete") & ~there, "empty").otherwise("applied")
    return p.withColumn("status", status).drop("__state", "__now", "__before")


def transactions(log: DataFrame, by: str) -> DataFrame:
    """Entries of one transaction as a unit, named after its first entry's table."""
    return log.groupBy(by).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.min_by("tbl", "lsn").alias("tbl"), F.count(F.lit(1)).alias("entries"))


def single_rows(log: DataFrame, rows: str) -> DataFrame:
    """Bulk inserts as one entry a row: `rows` is an array; part numbers the rows of an entry from 0."""
    return log.select("lsn", "tbl", F.posexplode(rows).alias("part", "pk"))


def retained(log: DataFrame, oldest: int) -> DataFrame:
    return log.where(F.col("lsn") >= oldest)


def average_rate(log: DataFrame, by: str) -> DataFrame:
    """Positions per second from the first to the last entry; null where no time has passed."""
    t = log.groupBy(by).agg((F.max("lsn") - F.min("lsn")).alias("n"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return t.select(by, F.round(F.when(F.col("us") > 0, F.col("n") / (F.col("us") / 1e6)), 4).alias("average"))


def unapplied(log: DataFrame, applied: int) -> DataFrame:
    """Entries after the applied position, each once."""
    return log.where(F.col("lsn") > applied).dropDuplicates(["lsn"])
