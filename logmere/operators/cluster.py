"""Membership: filters, summaries, lag, leader choice, heartbeats and timeouts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmere.session import written

from . import ordered
from .changelog import quorum

#: A node may read when its lag is at most this; a dead node is removed after so many seconds.
MOST_LAG, REMOVE_S = 100, 30
#: Parquet's option for the statistics of written columns, or with # and a name of one.
STATISTICS = "parquet.column.statistics.enabled"


def active(m: DataFrame) -> DataFrame:
    return m.where("status = 'ACTIVE'")


def others(m: DataFrame, own: str) -> DataFrame:
    """Real members besides `own`; ids with the prefix peer- are placeholders."""
    return m.where((F.col("id") != own) & ~F.col("id").startswith("peer-"))


def needing_sync(m: DataFrame, own: str) -> DataFrame:
    return m.where((F.col("id") != own) & (F.col("status").isin("JOINING", "SYNCING", "LAGGING") | (F.col("lag") > 0)))


def with_lag(m: DataFrame) -> DataFrame:
    """Each member's distance from the foremost position, at least 0."""
    lead = m.agg(F.max("last_applied_lsn").alias("leader_lsn"))
    return m.join(F.broadcast(lead)).withColumn("behind", F.greatest(F.col("leader_lsn") - F.col("last_applied_lsn"), F.lit(0)))  # one row


def healthy_readers(m: DataFrame, most: int = MOST_LAG) -> DataFrame:
    return with_lag(m).where((F.col("status") == "ACTIVE") & ~F.col("is_lb") & (F.col("behind") <= most))


def live_servers(m: DataFrame, seconds: int = 4) -> DataFrame:
    """Peers heard of lately that are no clients; the flag is_lb marks clients."""
    return m.where((F.col("age_s") < seconds) & ~F.col("is_lb"))


def is_fresh(age: Column, timeout: int) -> Column:
    """False for a node that was never heard of."""
    return F.coalesce(age < timeout, F.lit(False))


def summary(m: DataFrame) -> DataFrame:
    """Counts by state, the size, the two majority rules, the foremost and the lowest active id."""
    count = lambda c: F.count_if(c).cast("long")
    return m.agg(
        F.count(F.lit(1)).alias("total"), count(F.col("status") == "ACTIVE").alias("active"), count(F.col("status") == "LAGGING").alias("lagging"), count(F.col("status") == "DROPPED").alias("dropped"), count(F.col("is_lb")).alias("balancers"),
        F.max_by("id", F.struct("last_applied_lsn", "id")).alias("leader_id"), F.min(F.when(F.col("status") == "ACTIVE", F.col("id"))).alias("lowest_active"), quorum(F.count(F.lit(1))).alias("quorum"), (count(F.col("status") == "ACTIVE") >= 2).alias("has_quorum"),
    )


def by_status(m: DataFrame) -> DataFrame:
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("nodes"), F.sum("lag").alias("lag"))


def yields_to(m: DataFrame, own: str) -> DataFrame:
    """Active members with a lower id than `own` that are at least as far."""
    me = m.where(F.col("id") == own).agg(F.max("last_applied_lsn").alias("own_lsn"))
    return active(m).where(F.col("id") < own).join(F.broadcast(me)).where("last_applied_lsn >= own_lsn").drop("own_lsn")


def timeouts(m: DataFrame, timeout: int, election: int) -> DataFrame:
    """One pass of the timeout rules: the next status, REMOVED for a dropped node that stays silent."""
    late = ~is_fresh(F.col("age_s"), timeout) & F.col("age_s").isNotNull()
    nxt = F.when(~late, F.col("status")).when(F.col("status") == "ACTIVE", "LAGGING").when((F.col("status") == "LAGGING") & (F.col("age_s") > 3 * election), "DROPPED").when((F.col("status") == "DROPPED") & (F.col("age_s") > REMOVE_S), "REMOVED").otherwise(F.col("status"))
    return m.withColumn("next_status", nxt)


def after_heartbeat(status: Column, lag: Column) -> Column:
    """A member's status after it has answered."""
    return F.when(status.isin("JOINING", "OFFLINE"), "ACTIVE").when((status == "SYNCING") & (lag == 0), "ACTIVE").when(status == "LAGGING", "SYNCING").otherwise(status)


def merged(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known members, and found ones whose id is new; of several found with one id the smallest address."""
    fresh = found.groupBy("id").agg(F.min("address").alias("address")).join(known, "id", "left_anti")
    return known.select("id", "address", F.lit("known").alias("origin")).unionByName(fresh.withColumn("origin", F.lit("found")))


def clusters_match(a: Column, b: Column) -> Column:
    """An unnamed cluster matches any."""
    return a.isNull() | b.isNull() | (a == b)


def round_robin(requests: DataFrame, m: DataFrame, seq: str, most: int = MOST_LAG) -> DataFrame:
    """Requests with the reader whose turn it is. Readers are numbered in order of id, in buckets, and join by number."""
    pool = healthy_readers(m, most).where("id IS NOT NULL").select("id").repartitionByRange("id").sortWithinPartitions("id")
    fixed = written(pool.withColumn("__at", F.monotonically_increasing_id()))  # range borders are sampled anew in each run
    turns = ordered.numbered(fixed, [], "__at", "__turn").select("id", (F.col("__turn") - 1).alias("__turn"))
    size = fixed.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("__readers"))
    asked = requests.join(F.broadcast(size)).withColumn("__turn", F.pmod(F.col(seq), F.col("__readers")))  # one row
    return asked.join(turns, "__turn", "left").select(*requests.columns, "id")


def fan_out(messages: DataFrame, m: DataFrame, own: str, is_data: Column, is_client: Column, shown: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """Messages with their `targets`, the array of ids as `shown` once: data goes to members that store it, all else to clients too.

    One row holds a cluster's members. Data and all else come in partitions of their own, each with one value of `targets`,
    which a columnar file writes once while its dictionary takes it. Messages are dealt out evenly, as the work is of messages
    times members whatever the size of their files. Where the session says nothing of statistics of `targets`, Parquet keeps
    none: it would compare each list with the smallest and the largest, byte by byte.
    """
    rest, data = m.where(F.col("id") != own), F.coalesce(is_data, F.lit(False))
    conf = messages.sparkSession.conf
    n = int(conf.get("spark.sql.shuffle.partitions"))
    if conf.get(STATISTICS, None) is None and conf.get(f"{STATISTICS}#targets", None) is None:
        conf.set(f"{STATISTICS}#targets", "false")

    def sent(part: DataFrame, to: DataFrame) -> DataFrame:
        return part.repartition(n).join(F.broadcast(to.agg(shown(F.array_sort(F.collect_list("id"))).alias("targets"))))  # one row

    return sent(messages.where(data), rest.where(~is_client)).unionByName(sent(messages.where(~data), rest))


def running(processes: DataFrame, on: str, most: int = 10) -> DataFrame:
    """The first processes that are not asleep; a null command is none."""
    return processes.where("command <> 'Sleep'").orderBy(on).limit(most)
