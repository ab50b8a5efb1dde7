"""Operators on small inputs: bucket borders, nulls, ties, empty tables, a random replay."""

import json
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logmere.functions import scalars, statements
from logmere.operators import changelog, cluster, objects, ordered
from logmere.plans import registry
from logmere.session import shared_folder, written
from logmere.sources import files
from logmere.streaming import apply


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_ordered_across_buckets(spark, width):
    r = random.Random(width)
    rows = [(r.choice("ab"), i, r.choice([None, r.randrange(50)])) for i in sorted(r.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    want = {"prev": {}, "most": {}, "sum": {}, "last": {}}
    for k in "ab":
        own = [x for x in rows if x[0] == k]
        for n, (_, i, _v) in enumerate(own):
            seen = [x[2] for x in own[: n + 1] if x[2] is not None]
            want["prev"][i] = own[n - 1][2] if n else None
            want["most"][i] = max(seen, default=None)
            want["sum"][i] = n + 1
            want["last"][i] = seen[-1] if seen else None
    got = {
        "prev": ordered.previous(df, ["k"], "i", "v", "x", width), "most": ordered.running_max(df, ["k"], "i", "v", "x", width),
        "sum": ordered.numbered(df, ["k"], "i", "x", width), "last": ordered.running_last(df, ["k"], "i", "v", "x", width),
    }
    for name, out in got.items():
        assert {x["i"]: x["x"] for x in out.collect()} == want[name], name
        assert out.where("false").count() == 0
    as_of = ordered.as_of(df.where("i % 2 = 0").select("k", "i"), df.where("i % 3 = 0").select("k", "i", F.col("i").alias("at")), ["k"], "i", width)
    pairs = {x["i"]: x["at"] for x in as_of.collect()}
    assert pairs == {i: max(j for k2, j, _ in rows if k2 == k and j <= i and j % 3 == 0) for k, i, _ in rows if i % 2 == 0 and any(k2 == k and j <= i and j % 3 == 0 for k2, j, _ in rows)}


def test_rolling_across_buckets(spark):
    df = spark.range(100).select(F.col("id").alias("i"))
    for width in (5, 7, 1000):
        got = {x["i"]: x["s"] for x in ordered.rolling(df, "i", 5, {"s": F.sum("i")}, width).collect()}
        assert got == {i: sum(range(max(0, i - 4), i + 1)) for i in range(100)}


def test_replay_random(spark):
    r = random.Random(7)
    ops = [(n, r.choice(["insert", "update", "upsert", "delete", "noop"]), r.randrange(40), r.random() < 0.5, r.random() < 0.5, r.random() < 0.5, r.random() < 0.5, r.choice([None, r.randrange(9)]), r.choice([None, r.randrange(9)])) for n in range(1, 1500)]
    state: dict[int, dict] = {}
    for _, op, k, aset, bset, ua, ub, a, b in ops:
        if op == "insert" and k not in state or op == "upsert" and k not in state:
            state[k] = {"a": a, "b": b}
        elif op == "delete":
            state.pop(k, None)
        elif op in ("update", "upsert") and k in state:
            if aset if op == "update" else ua:
                state[k]["a"] = a
            if bset if op == "update" else ub:
                state[k]["b"] = b
    log = spark.createDataFrame(ops, "lsn long, op string, k long, aset boolean, bset boolean, ua boolean, ub boolean, a long, b long")
    got = changelog.replay(log, ["k"], {"a": ("aset", "ua"), "b": ("bset", "ub")})
    assert {x["k"]: {"a": x["a"], "b": x["b"]} for x in got.collect()} == state
    assert changelog.replay(log.limit(0), ["k"], {"a": ("aset", "ua")}).count() == 0


def test_quorum_and_delta(spark):
    p = spark.createDataFrame([("a", 10), ("b", 7), ("c", 3)], "id string, last_applied_lsn long")
    assert changelog.commit_lsn(p).first()[:] == (7, 3, 2)
    c = spark.createDataFrame([(v, v % 2, False) for v in range(1, 11)], "version long, path long, is_deleted boolean")
    asked = spark.createDataFrame([(0,), (3,), (6,), (10,)], "from_version long")
    assert dict(x[:] for x in changelog.delta_or_full(c, asked, 5).collect()) == {0: "full", 3: "full", 6: "delta", 10: "empty"}


def test_node_numbers_and_clusters(spark):
    rolled = lambda s: __import__("functools").reduce(lambda h, b: (h * 31 + b) % 2**64, s.encode(), 0) % 1024
    names = ["node-5", "node-42", "server123", "alpha", "beta", "n70000", "x1025", "é", ""]
    got = {x[0]: x[1] for x in spark.createDataFrame([(n,) for n in names], "n string").select("n", scalars.node_number(F.col("n"))).collect()}
    assert got == {"node-5": 5, "node-42": 42, "server123": 123, "alpha": rolled("alpha"), "beta": rolled("beta"), "n70000": 0, "x1025": 1, "é": rolled("é"), "": 0}
    m = spark.createDataFrame([("a", None), ("b", 4), ("c", 9)], "id string, age_s int")
    assert [x[0] for x in m.where(cluster.is_fresh(F.col("age_s"), 5)).collect()] == ["b"]


def test_pieces():
    assert statements.pieces("a; 'x;''y' b;; -- c;d\n e; `;` f; /* ; */ g") == ["a", "'x;''y' b", "-- c;d\n e", "`;` f", "/* ; */ g"]
    assert statements.pieces(None) == statements.pieces(" ; ") == []
    assert statements.pieces("x 'open; end") == ["x 'open; end"]


def test_chunks_round_trip(spark):
    rows = [("a", b""), ("b", b"x" * 999), ("c", bytes(range(256)) * 9), ("d", None)]
    c = objects.chunked(spark.createDataFrame(rows, "path string, content binary"), 100)
    whole = objects.read_range(c, c.select("path").distinct().select("path", F.lit(0).alias("lo"), F.lit(1 << 20).alias("hi")))
    assert {x["path"]: bytes(x["data"]) for x in whole.collect()} == {"b": rows[1][1], "c": rows[2][1]}
    assert objects.store(c, c.select("hash").limit(0)).count() == c.select("hash").distinct().count()


def test_fan_out_is_written_compactly(spark):
    members = spark.range(60000).select(F.format_string("node-%08d", "id").alias("id"), (F.col("id") % 5 == 0).alias("is_lb"))
    messages = spark.range(0, 300, 1, 1).select(F.col("id").alias("lsn"), F.expr("CASE id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' END").alias("op"))
    out = cluster.fan_out(written(messages), members, "node-00000000", F.col("op") == "insert", F.col("is_lb"), lambda ids: F.array_join(ids, " "))
    out.write.parquet(path := shared_folder(spark))
    assert sum(p.stat().st_size for p in Path(path).rglob("*.parquet")) < 5e6  # 300 lists of 0.8 MB
    got = spark.read.parquet(path).groupBy("op").agg(F.count("lsn"), F.min(F.length("targets")), F.max(F.length("targets"))).collect()
    assert {r[0]: r[1:] for r in got} == {"insert": (100, 48000 * 14 - 1, 48000 * 14 - 1), "update": (100, 59999 * 14 - 1, 59999 * 14 - 1), None: (100, 59999 * 14 - 1, 59999 * 14 - 1)}


def test_fan_out_is_dealt_evenly(spark):
    """Messages of one partition are sent by many tasks, and a written list is not compared with the smallest and largest."""
    members = spark.range(50).select(F.format_string("node-%02d", "id").alias("id"), (F.col("id") % 5 == 0).alias("is_lb"))
    messages = spark.range(0, 4000, 1, 1).select(F.col("id").alias("lsn"), F.when(F.col("id") % 4 == 0, "insert").otherwise("update").alias("op"))
    out = cluster.fan_out(messages, members, "node-00", F.col("op") == "insert", F.col("is_lb"), lambda ids: F.array_join(ids, " "))
    out.write.parquet(path := shared_folder(spark))
    found = [pq.ParquetFile(p).metadata for p in Path(path).rglob("*.parquet")]
    assert sum(m.num_rows for m in found) == 4000 and max(m.num_rows for m in found) <= 1000
    kept = {m.row_group(0).column(c).path_in_schema: m.row_group(0).column(c).is_stats_set for m in found if m.num_rows for c in range(3)}
    assert kept == {"lsn": True, "op": True, "targets": False}


def test_short_segments_share_files(spark):
    log = spark.range(1, 1001).select(F.col("id").alias("lsn"), F.lit("x").alias("op"))
    files.write_log(log, one := shared_folder(spark), 10)
    assert len({p.parent for p in Path(one).rglob("*.parquet")}) == 1
    assert [r[0] for r in files.list_segments(spark, one).collect()] == list(range(100))


def test_ranges_across_shared_partitions(spark, monkeypatch):
    log = spark.range(1, 1001).select(F.col("id").alias("lsn"), F.lit("x").alias("op"))
    monkeypatch.setattr(files, "SHARED", 450)  # partitions of four segments
    files.write_log(log, several := shared_folder(spark), 100)
    assert len({p.parent for p in Path(several).rglob("*.parquet")}) == 3
    assert files.list_segments(spark, several).count() == 10
    for first, last in ((399, 402), (400, 400), (401, 800), (None, 5), (996, None)):
        want = list(range(first or 1, (last or 1000) + 1))
        assert sorted(r["lsn"] for r in files.read_log(spark, several, first, last, 100).collect()) == want
    assert files.read_log(spark, several).columns == ["lsn", "op"]


def test_segment_query_writes_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(registry, "shared_folder", lambda _: f"{tmp_path}/log")
    got = registry.QUERIES["S6_segment_files"](spark, "/root/testdata/sf0.01")
    assert sorted(r["lsn"] for r in got.collect()) == list(range(150, 750))
    assert len(list(tmp_path.rglob("*.parquet"))) < 10  # of 100 segments


def test_files_and_streams(spark):
    top = shared_folder(spark)
    log = spark.range(1, 1001).select(F.col("id").alias("lsn"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tbl"))
    files.write_log(log, f"{top}/log", 100)
    part = files.read_log(spark, f"{top}/log", 250, 449, 100)
    assert part.agg(F.min("lsn"), F.max("lsn"), F.count("lsn")).first()[:] == (250, 449, 200)
    stream = apply.log_stream(spark, f"{top}/log", "lsn long, tbl string", 3)
    apply.follow(stream, f"{top}/applied", f"{top}/state")
    apply.follow(apply.log_stream(spark, f"{top}/log", "lsn long, tbl string", 3), f"{top}/applied", f"{top}/state")  # nothing new
    assert apply.applied(spark, f"{top}/applied").agg(F.count("lsn"), F.sum("lsn")).first()[:] == (1000, 500500)
    index = spark.createDataFrame([("a/b", 3, False)], "path string, size long, is_dir boolean").select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("permissions", "int"), ("symlink_target", "string"))])
    files.write_index(index, f"{top}/index")
    assert files.read_index(spark, f"{top}/index").select("path", "size").collect()[0][:] == ("a/b", 3)
    spark.createDataFrame([(json.dumps({"172.16.0.2": "10.0.0.1"}),)], "value string").write.text(f"{top}/routes")
    assert files.read_routes(spark, f"{top}/routes").first()[:] == ("172.16.0.2", "10.0.0.1")


def test_heartbeats(spark):
    top = shared_folder(spark)
    spark.createDataFrame([("a", 5), ("a", 0), ("b", 0)], "node string, lsn long").coalesce(1).write.parquet(f"{top}/beats")
    out: list = []
    beats = spark.readStream.schema("node string, lsn long").parquet(f"{top}/beats")
    apply.heartbeats(beats).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).outputMode("update").option("checkpointLocation", f"{top}/state").trigger(once=True).start().awaitTermination()
    assert sorted(x[:] for x in out) == [("a", "ACTIVE", 5, 2), ("b", "ACTIVE", 0, 1)]


def test_heartbeat_rules():
    """A silent node lags, is dropped and then removed; a beat does not bring a dropped one back, lag keeps one syncing."""
    steps, status = [], "ACTIVE"
    for _ in range(3):
        status = apply.after_silence(status)
        steps.append(status)
    assert steps == ["LAGGING", "DROPPED", "REMOVED"] and apply.after_silence("SYNCING") == "SYNCING"
    assert [apply.after_beat(s, 0) for s in ("JOINING", "OFFLINE", "LAGGING", "SYNCING", "DROPPED", "ACTIVE")] == ["ACTIVE", "ACTIVE", "SYNCING", "ACTIVE", "DROPPED", "ACTIVE"]
    assert apply.after_beat("SYNCING", 5) == "SYNCING"
