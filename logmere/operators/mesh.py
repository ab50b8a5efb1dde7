"""Mesh peers: next hops, peer exchange, replay protection.

peers: peer_id, ip, public_key, nation, is_gateway, connected, rx, tx.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

#: Packets this far behind are stale; a counter below RESTART after one above it is a restart.
REORDER, RESTART = 32, 100


def connected(peers: DataFrame, seconds: int = 120) -> DataFrame:
    """Peers with a session (session not null) that were seen lately."""
    return peers.where(F.col("session").isNotNull() & (F.col("seen_s") < seconds))


def next_hops(destinations: DataFrame, peers: DataFrame, routes: DataFrame, relays: DataFrame) -> DataFrame:
    """(dest, hop, how) of each distinct destination: a connected peer, the connected host of a subnet route, the relay through which
    it was learned (dest, relay: an address, connected or not), the gateway, or all."""
    up = peers.where("connected").groupBy("ip").agg(F.min("peer_id").alias("direct"))
    via = routes.join(up.withColumnsRenamed({"ip": "host", "direct": "routed"}), "host").groupBy("dest").agg(F.min("routed").alias("routed"))
    gate = peers.where("connected AND is_gateway").agg(F.min("peer_id").alias("gateway"))
    known = peers.groupBy(F.col("ip").alias("relay")).agg(F.min("peer_id").alias("relayed"))
    learned = relays.join(known, "relay").groupBy("dest").agg(F.min("relayed").alias("relayed"))
    d = destinations.select("dest").distinct().join(up.withColumnRenamed("ip", "dest"), "dest", "left").join(via, "dest", "left").join(learned, "dest", "left").join(F.broadcast(gate))  # one row
    how = F.when(F.col("direct").isNotNull(), "direct").when(F.col("routed").isNotNull(), "route").when(F.col("relayed").isNotNull(), "relay").when(F.col("gateway").isNotNull(), "gateway").otherwise("broadcast")
    return d.select("dest", F.coalesce("direct", "routed", "relayed", "gateway").alias("hop"), how.alias("how"))


def relays(peers: DataFrame) -> DataFrame:
    """Each peer with its hop: itself where connected, else the smallest gateway of its nation."""
    gates = peers.where("is_gateway").groupBy("nation").agg(F.min("peer_id").alias("gateway"))
    return peers.join(gates, "nation", "left").select("peer_id", F.when(F.col("connected"), F.col("peer_id")).otherwise(F.col("gateway")).alias("hop"))


def broadcast_hops(peers: DataFrame) -> DataFrame:
    """Hops of a broadcast, each once, and how many peers it serves."""
    return relays(peers).where("hop IS NOT NULL").groupBy("hop").agg(F.count(F.lit(1)).alias("peers"))


def identified(packets: DataFrame, peers: DataFrame) -> DataFrame:
    """Packets with their sender: by address, else by key."""
    ip = peers.groupBy("ip").agg(F.min("peer_id").alias("by_ip"))
    key = peers.groupBy("public_key").agg(F.min("peer_id").alias("by_key"))
    return packets.join(ip, "ip", "left").join(key, "public_key", "left").withColumn("sender", F.coalesce("by_ip", "by_key")).drop("by_ip", "by_key")


def exchanged(known: DataFrame, offered: DataFrame, sender: str, own: str) -> DataFrame:
    """Peers after an exchange: known ones stay (relayed through the sender if not connected), new ones come in
    unless their key is known under another address. ip and public_key are unique among known peers."""
    o = offered.where(F.col("ip") != own).groupBy("ip").agg(F.min("public_key").alias("public_key"))
    heard = o.select("ip", F.lit(True).alias("heard"))
    old = known.join(heard, "ip", "left").select("ip", "public_key", F.when(F.col("heard") & ~F.col("connected"), F.lit(sender)).alias("relay"))
    new = o.join(known, "ip", "left_anti").join(known, "public_key", "left_anti").select("ip", "public_key", F.lit(sender).alias("relay"))
    return old.unionByName(new)


def traffic(peers: DataFrame) -> DataFrame:
    return peers.groupBy("nation").agg(F.sum("rx").alias("rx"), F.sum("tx").alias("tx"), F.count_if("connected").cast("long").alias("connected"), F.count(F.lit(1)).alias("peers"))


def stale_packets(packets: DataFrame, by: list[str], on: str, counter: str, width: int = ordered.WIDTH) -> DataFrame:
    """Packets more than REORDER behind the highest counter so far, unless they look like a restart."""
    p = ordered.running_max(packets, by, on, counter, "highest", width, before=True)
    restart = (F.col(counter) < RESTART) & (F.col("highest") > RESTART)
    return p.where((F.col("highest") - F.col(counter) > REORDER) & ~restart)


def status_table(peers: DataFrame) -> DataFrame:
    """One row per peer as shown to a user: '-' for no endpoint, the greatest long for never seen."""
    return peers.select("peer_id", F.col("ip").alias("address"), F.coalesce("endpoint", F.lit("-")).alias("endpoint"), F.coalesce("last_seen_s", F.lit(2**63 - 1)).alias("last_seen_s"), F.col("rx").alias("rx_bytes"), F.col("tx").alias("tx_bytes"), "connected", "is_gateway")


def dispatched(packets: DataFrame, peers: DataFrame, routes: DataFrame, own: str) -> DataFrame:
    """What becomes of packets (dest) that arrive at `own`: deliver, broadcast, forward to a peer, route to a host that is
    a peer, drop (the host cannot be reached) or local (an unknown destination; the kernel's routes decide)."""
    near = own.rsplit(".", 1)[0] + ".255"
    up = peers.where("connected").select("ip").distinct()
    hop = packets.join(up.select(F.col("ip").alias("dest"), F.lit(True).alias("__peer")), "dest", "left").join(routes.groupBy("dest").agg(F.min("host").alias("__host")), "dest", "left").join(up.select(F.col("ip").alias("__host"), F.lit(True).alias("__up")), "__host", "left")
    action = (
        F.when((F.col("dest") == own), "deliver").when(F.col("dest").isin(near, "255.255.255.255"), "broadcast").when(F.col("__peer"), "forward")
        .when(F.col("__host") == own, "deliver").when(F.col("__up"), "route").when(F.col("__host").isNotNull(), "drop").otherwise("local")
    )
    out = hop.withColumn("action", action)
    return out.withColumn("hop", F.when(F.col("action") == "forward", F.col("dest")).when(F.col("action") == "route", F.col("__host"))).select(*packets.columns, "action", "hop")
