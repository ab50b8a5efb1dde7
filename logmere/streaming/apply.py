"""Following a change log as a stream: ordered apply, progress, heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New files of a log folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow(log: DataFrame, target: str, checkpoint: str) -> None:
    """Append entries to `target`, each once, until the source has no more.

    A batch that is run again after a failure overwrites its own folder, so entries are neither lost nor doubled;
    a position that an earlier batch already has is left out of batches by readers (`applied`).
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["lsn"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def applied(spark: SparkSession, target: str) -> DataFrame:
    """What has been applied: of a repeated position the first batch's entry. A late repeat is acknowledged, not applied."""
    rows = spark.read.parquet(target)
    first = rows.groupBy("lsn").agg(F.min("batch").alias("batch"))
    return rows.join(first, ["lsn", "batch"]).drop("batch")


def progress(log: DataFrame) -> DataFrame:
    """Highest position of each table, as it grows."""
    return log.groupBy("tbl").agg(F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("entries"))


def after_beat(status: str, lag: int) -> str:
    return "ACTIVE" if status in ("JOINING", "OFFLINE") or status == "SYNCING" and lag == 0 else "SYNCING" if status == "LAGGING" else status


def after_silence(status: str) -> str:
    """What silence makes of a node; a status that is neither ACTIVE, LAGGING nor DROPPED stays."""
    return {"ACTIVE": "LAGGING", "LAGGING": "DROPPED", "DROPPED": "REMOVED"}.get(status, status)


HEARTBEAT = "node string, status string, last_lsn long, beats long"


def heartbeats(beats: DataFrame, silence_ms: int = 30_000) -> DataFrame:
    """Status of each node after each batch of beats (node, lsn, and lag if there is such a column).

    A beat makes a new node ACTIVE, a LAGGING one SYNCING, and a SYNCING one without lag ACTIVE; it does not bring a DROPPED
    one back. Silence makes it LAGGING, then DROPPED; the next silence ends its state. The state is three values per node;
    beats of lsn 0 only touch it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, lsn, n = state.get
            nxt = after_silence(status)
            if nxt == "REMOVED":
                state.remove()
            else:
                state.update((nxt, lsn, n))
                state.setTimeoutDuration(silence_ms)
            yield pd.DataFrame({"node": [key[0]], "status": [nxt], "last_lsn": [lsn], "beats": [n]})
            return
        status, lsn, n = state.get if state.exists else ("JOINING", 0, 0)
        lag = 0
        for b in batches:
            n += len(b)
            lag = int(b["lag"].iloc[-1]) if "lag" in b and len(b) else lag
            known = b["lsn"][b["lsn"] > 0]
            lsn = int(known.max()) if len(known) and known.max() > lsn else lsn
        status = after_beat(status, lag)
        state.update((status, lsn, n))
        state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame({"node": [key[0]], "status": [status], "last_lsn": [lsn], "beats": [n]})

    return beats.groupBy("node").applyInPandasWithState(run, HEARTBEAT, "status string, last_lsn long, beats long", "update", GroupStateTimeout.ProcessingTimeTimeout)
