
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmere.functions import scalars as S
from logmere.functions import statements as Q
from logmere.operators import changelog as C
from logmere.operators import cluster as M
from logmere.operators import mesh as N
from logmere.operators import objects as O
from logmere.operators import ordered
from logmere.session import shared_folder
from logmere.sources import files as IO
from logmere.sources import views as V
from logmere.streaming import apply as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable:
    """Register a query; `views` name the derived tables that its SQL uses."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ctes = ", ".join(f"{v} AS ({V.SQL[v]})" for v in views)
            SQL[name] = sql if not views else sql.replace("WITH ", f"WITH {ctes}, ", 1) if sql.startswith("WITH ") else f"WITH {ctes} {sql}"
        return f

    return put


def on_log(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame], more: tuple[str, ...] = ()) -> None:
    query(name, sql, "wal", *more)(lambda s, d: f(V.wal(s, d)))


def on_members(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, "members")(lambda s, d: f(V.members(s, d)))


def on_files(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, "files")(lambda s, d: f(V.files(s, d)))


def on_peers(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql, "peers")(lambda s, d: f(V.peers(s, d)))


# Scans of the log
on_log("S1_scan_from", "SELECT lsn, tbl, pk, op FROM wal WHERE lsn >= 501", lambda w: C.scan_from(w, 501).select("lsn", "tbl", "pk", "op"))
on_log("S2_range", "SELECT lsn, tbl, pk, op FROM wal WHERE lsn BETWEEN 100 AND 199", lambda w: C.scan_range(w, 100, 199).select("lsn", "tbl", "pk", "op"))
on_log("S3_batch", "SELECT lsn, tbl, pk, op FROM wal WHERE lsn >= 501 ORDER BY lsn LIMIT 1000", lambda w: C.scan_batch(w, 501, 1000).select("lsn", "tbl", "pk", "op"))
on_log("S4_get", "SELECT lsn, tbl, pk, op FROM wal WHERE lsn = 42", lambda w: C.get(w, 42).select("lsn", "tbl", "pk", "op"))
on_log("S7_segment_floor", "SELECT tbl, max(lsn) AS lsn, (max(lsn) - 1) // 100 AS segment, ((max(lsn) - 1) // 100) * 100 + 1 AS first_lsn FROM wal GROUP BY tbl", lambda w: C.floor_segment(C.watermark(w).withColumnRenamed("last_lsn", "lsn"), C.segments(w, 100), "lsn", 100))
on_log("S9_segments", "SELECT (lsn - 1) // 100 AS segment, min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS entries FROM wal GROUP BY 1", lambda w: C.segments(w, 100))
on_log("S10_ends", "SELECT min(lsn) AS first_lsn, max(lsn) AS last_lsn, count(*) AS entries FROM wal", C.ends)
on_log("O1_sorted", "SELECT lsn, ts, tbl FROM wal ORDER BY lsn", lambda w: w.select("lsn", "ts", "tbl").orderBy("lsn"))


@query("S6_segment_files", "SELECT lsn, tbl, pk, op FROM wal WHERE lsn BETWEEN 150 AND 749", "wal")
def segment_files(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s)
    IO.write_log(V.wal(s, d).select("lsn", "tbl", "pk", "op"), path, 100)
    return IO.read_log(s, path, 150, 749, 100)


@query("S8_segment_list", "SELECT DISTINCT (lsn - 1) // 100 AS segment FROM wal", "wal")
def segment_list(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/listed"
    IO.write_log(V.wal(s, d).select("lsn", "op"), path, 100)
    return IO.list_segments(s, path).select(F.col("segment").cast("long").alias("segment"))


@query("S21_status_file", "SELECT status, count(*) AS nodes, CAST(sum(lag) AS BIGINT) AS lag FROM members GROUP BY status", "members")
def status_file(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/status"
    IO.write_status(M.by_status(V.members(s, d)), path)
    return IO.read_status(s, path, "status string, nodes long, lag long")


on_log("S17_processes", "SELECT lsn, tbl FROM wal WHERE op <> 'noop' ORDER BY lsn LIMIT 10", lambda w: M.running(w.select("lsn", "tbl", F.when(F.col("op") == "noop", "Sleep").otherwise(F.col("op")).alias("command")), "lsn").select("lsn", "tbl"))
query(
    "R18_fan_out",
    "WITH t AS (SELECT string_agg(id, ' ' ORDER BY id) AS everyone, string_agg(id, ' ' ORDER BY id) FILTER (NOT is_lb) AS stores FROM members WHERE id <> 'node-1') SELECT lsn, CASE WHEN op = 'insert' THEN stores ELSE everyone END AS targets FROM wal, t WHERE op <> 'noop'",
    "wal",
    "members",
)(lambda s, d: M.fan_out(V.wal(s, d).where("op <> 'noop'").select("lsn", "op"), V.members(s, d), "node-1", F.col("op") == "insert", F.col("is_lb"), lambda ids: F.when(F.size(ids) > 0, F.array_join(ids, " "))).select("lsn", "targets"))

# Aggregates of the log
on_log("A5_watermark", "SELECT tbl, max(lsn) AS last_lsn FROM wal GROUP BY tbl", C.watermark)
on_log("A6_node_progress", "SELECT origin_node, max(lsn) AS last_applied_lsn, max(ts) AS last_heartbeat FROM wal GROUP BY 1", C.node_progress)
on_log("A12_latest_op", "SELECT path, max(version) AS version, arg_max(is_deleted, version) AS is_deleted FROM changes WHERE version > 500 GROUP BY path", lambda w: C.latest_op(V.changes(w), 500), ("changes",))
on_log("A15_acks", "WITH p AS (SELECT max(lsn) AS m FROM wal GROUP BY origin_node) SELECT lsn, (SELECT count(*) FROM p WHERE m >= lsn) AS acks, (SELECT count(*) FROM p WHERE m >= lsn) >= (SELECT count(*) // 2 + 1 FROM p) AS committed FROM wal", lambda w: C.acknowledged(w, C.node_progress(w)))
on_log("A16_commit_lsn", "WITH p AS (SELECT max(lsn) AS m FROM wal GROUP BY origin_node), r AS (SELECT m, row_number() OVER (ORDER BY m DESC) AS k, count(*) OVER () AS n FROM p) SELECT m AS commit_lsn, n AS nodes, n // 2 + 1 AS quorum FROM r WHERE k = n // 2 + 1", lambda w: C.commit_lsn(C.node_progress(w)))
on_log("A13_throughput", "WITH r AS (SELECT tbl, lsn, lsn - lag(lsn) OVER w AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS us FROM wal WINDOW w AS (PARTITION BY tbl ORDER BY lsn)) SELECT tbl, round(max(n / (us / 1e6)), 4) AS peak, round(max(n / (us / 1e6)) * 1.2, 4) AS scale FROM r WHERE us > 0 GROUP BY tbl", lambda w: C.rates(w, ["tbl"]).groupBy("tbl").agg(F.round(F.max("rate"), 4).alias("peak"), F.round(F.max("rate") * 1.2, 4).alias("scale")))

# Ordered computations of the log
on_log("W1_rate", "SELECT lsn, tbl, round((lsn - lag(lsn) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 4) AS rate FROM wal WINDOW w AS (PARTITION BY tbl ORDER BY lsn)", lambda w: C.rates(w, ["tbl"]).select("lsn", "tbl", F.round("rate", 4).alias("rate")))
on_log("W2_rolling", "SELECT lsn, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, max(value) OVER w AS most FROM wal WINDOW w AS (ORDER BY lsn ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)", lambda w: ordered.rolling(w.select("lsn", "value"), "lsn", 40, {"cents": F.sum(F.round(F.col("value") * 100).cast("long")), "most": F.max("value")}).select("lsn", "cents", "most"))
on_log("W3_ring", "SELECT tbl, lsn, rank FROM (SELECT tbl, lsn, row_number() OVER (PARTITION BY tbl ORDER BY lsn DESC) AS rank FROM wal) WHERE rank <= 20", lambda w: C.last_n(w, 20).select("tbl", "lsn", F.col("rank").cast("long").alias("rank")))
on_log("W4_gaps", "SELECT tbl, lsn, prev_lsn FROM (SELECT tbl, lsn, lag(lsn) OVER (PARTITION BY tbl ORDER BY lsn) AS prev_lsn FROM wal) WHERE lsn - prev_lsn <> 1", lambda w: C.gaps(w, ["tbl"]).select("tbl", "lsn", "prev_lsn"))
on_log("W4_gaps_global", "SELECT lsn, lag(lsn) OVER (ORDER BY lsn) AS prev_lsn FROM (SELECT lsn FROM wal WHERE op <> 'noop') QUALIFY lsn - prev_lsn <> 1", lambda w: C.gaps(w.where("op <> 'noop'").select("lsn"), []))
on_log("W5_running_max", "SELECT lsn, max(value) OVER (PARTITION BY origin_node ORDER BY lsn) AS so_far FROM wal", lambda w: ordered.running_max(w, ["origin_node"], "lsn", "value", "so_far").select("lsn", "so_far"))
on_log("W6_age", "SELECT lsn, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY origin_node ORDER BY lsn)) // 1 AS age_us FROM wal", lambda w: ordered.previous(w.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), ["origin_node"], "lsn", "us", "p").select("lsn", (F.col("us") - F.col("p")).alias("age_us")))
on_log("W7_regressions", "SELECT lsn, origin_node FROM (SELECT lsn, origin_node, value, lag(value) OVER (PARTITION BY origin_node ORDER BY lsn) AS p FROM wal) WHERE value < p", lambda w: C.regressions(w, ["origin_node"], "value").select("lsn", "origin_node"))
on_log("K1_append", "SELECT lsn, CAST(row_number() OVER (ORDER BY lsn) + 1000 AS BIGINT) AS new_lsn FROM wal WHERE op <> 'noop'", lambda w: C.assign_lsn(w.select("lsn", "op"), "lsn", 1000).select("lsn", "new_lsn"))
on_log("K4_upsert_state", "SELECT pk, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM wal GROUP BY pk", lambda w: w.groupBy("pk").agg(F.max_by("value", "lsn").alias("value"), F.max("lsn").alias("lsn")))
on_log("J1_as_of", "WITH m AS (SELECT lsn AS at, tbl, pk AS mapped FROM wal WHERE op = 'upsert'), e AS (SELECT lsn, tbl FROM wal WHERE op = 'update') SELECT lsn, tbl, mapped FROM (SELECT e.lsn, e.tbl, m.mapped, row_number() OVER (PARTITION BY e.lsn ORDER BY m.at DESC) AS k FROM e JOIN m ON m.tbl = e.tbl AND m.at <= e.lsn) WHERE k = 1", lambda w: ordered.as_of(w.where("op = 'update'").select("lsn", "tbl"), w.where("op = 'upsert'").select("lsn", "tbl", F.col("pk").alias("mapped")), ["tbl"], "lsn"))
on_log("P7_unapplied", "SELECT lsn, pk FROM wal WHERE lsn > 500", lambda w: C.unapplied(w.union(w), 500).select("lsn", "pk"))
on_log("M_last_wins", "SELECT pk, lsn, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY lsn DESC) AS k FROM wal) WHERE k = 1 AND op <> 'delete'", lambda w: C.last_row(w, ["pk"], ["value"]))

_REPLAY = """WITH o AS (SELECT *, json_extract_string(props, '$.k') AS b, lsn % 2 = 0 AS sets_a, lsn % 3 = 0 AS sets_b, lsn % 2 = 1 AS over_a, lsn % 5 <> 0 AS over_b FROM wal),
e AS (SELECT *, coalesce(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY pk ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY pk) AS live FROM o),
l AS (SELECT * FROM e WHERE epoch = live AND op <> 'delete'),
n AS (SELECT pk, min(lsn) AS born_lsn FROM l WHERE op IN ('insert', 'upsert') GROUP BY pk),
x AS (SELECT l.*, n.born_lsn FROM l JOIN n USING (pk) WHERE l.lsn >= n.born_lsn),
a AS (SELECT pk, max(lsn) AS at FROM x WHERE lsn = born_lsn OR (op = 'update' AND sets_a) OR (op = 'upsert' AND over_a) GROUP BY pk),
c AS (SELECT pk, max(lsn) AS at FROM x WHERE lsn = born_lsn OR (op = 'update' AND sets_b) OR (op = 'upsert' AND over_b) GROUP BY pk)
SELECT n.pk, n.born_lsn, xa.value AS value, xb.b AS b FROM n JOIN a USING (pk) JOIN c USING (pk) JOIN x xa ON xa.lsn = a.at JOIN x xb ON xb.lsn = c.at
"""
on_log("M_replay", _REPLAY, lambda w: C.replay(w.select("lsn", "pk", "op", "value", F.get_json_object("props", "$.k").alias("b"), *[F.expr(e).alias(n) for n, e in (("sets_a", "lsn % 2 = 0"), ("sets_b", "lsn % 3 = 0"), ("over_a", "lsn % 2 = 1"), ("over_b", "lsn % 5 <> 0"))]), ["pk"], {"value": ("sets_a", "over_a"), "b": ("sets_b", "over_b")}))


@query("R11_delta_or_full", "WITH h AS (SELECT max(version) AS newest, min(version) AS first FROM changes), q AS (SELECT DISTINCT version AS from_version FROM changes UNION SELECT 0) SELECT from_version, CASE WHEN from_version = 0 THEN 'full' WHEN from_version = newest THEN 'empty' WHEN from_version < greatest(first, newest - 199) THEN 'full' ELSE 'delta' END AS answer FROM q, h", "changes")
def delta_or_full(s: SparkSession, d: str) -> DataFrame:
    c = V.changes(V.wal(s, d))
    asked = c.select(F.col("version").alias("from_version")).union(s.range(1).select("id")).distinct()
    return C.delta_or_full(c, asked, 200)


on_log("A3_row_count", "SELECT tbl, count(*) AS entries FROM wal GROUP BY tbl", lambda w: w.groupBy("tbl").agg(F.count(F.lit(1)).alias("entries")))
on_log("A6_applied_count", "SELECT origin_node, count(*) AS applied FROM wal WHERE lsn <= 900 GROUP BY 1", lambda w: C.scan_range(w, 1, 900).groupBy("origin_node").agg(F.count(F.lit(1)).alias("applied")))
on_log("A13_average", "SELECT tbl, round((max(lsn) - min(lsn)) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 4) AS average FROM wal GROUP BY tbl", lambda w: C.average_rate(w, "tbl"))
on_log("R15_retained", "SELECT lsn, tbl FROM wal WHERE lsn >= 300", lambda w: C.retained(w, 300).select("lsn", "tbl"))
on_log("M5_bulk_insert", "SELECT lsn, tbl, CAST(unnest([0, 1, 2]) AS INTEGER) AS part, unnest([pk, pk + 1, pk + 2]) AS pk FROM wal WHERE op = 'insert'", lambda w: C.single_rows(w.where("op = 'insert'").withColumn("rows", F.array("pk", F.col("pk") + 1, F.col("pk") + 2)), "rows"))
on_log("M6_transactions", "SELECT (lsn - 1) // 4 AS tx, min(lsn) AS first_lsn, max(lsn) AS last_lsn, arg_min(tbl, lsn) AS tbl, count(*) AS entries FROM wal GROUP BY 1", lambda w: C.transactions(w.withColumn("tx", C.segment_of("lsn", 4)), "tx"))
on_log("M12_statuses", "WITH b AS (SELECT lsn, pk, op, last_value(CASE WHEN op IN ('insert', 'upsert', 'delete') THEN op <> 'delete' END IGNORE NULLS) OVER (PARTITION BY pk ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS there FROM wal) SELECT lsn, CASE WHEN op = 'noop' THEN 'skipped' WHEN op = 'insert' AND coalesce(there, false) THEN 'failed' WHEN op IN ('update', 'delete') AND NOT coalesce(there, false) THEN 'empty' ELSE 'applied' END AS status FROM b", lambda w: C.statuses(w.select("lsn", "pk", "op"), ["pk"]).select("lsn", "status"))
on_log("P1_key", "SELECT lsn, value FROM wal WHERE tbl = 'tbl_2' AND pk % 7 = 3 AND origin_node = 'node-1'", lambda w: w.where(C.key_equals({"tbl": "tbl_2", "origin_node": "node-1"}) & (F.col("pk") % 7 == 3)).select("lsn", "value"))
on_log("F5_tables", "SELECT lsn, CASE WHEN sql NOT LIKE 'SELECT%' THEN tbl END AS written FROM logged", lambda w: V.logged_statements(w).select("lsn", Q.dml_table(F.col("sql")).alias("written")), ("logged",))
on_log("Q1_class_log", "SELECT lsn, sql NOT LIKE 'SELECT%' AS writes, sql NOT LIKE 'SELECT%' AND sql NOT LIKE '/*%' AS writes_old, sql LIKE 'SELECT%' AS fast_read FROM logged", lambda w: V.logged_statements(w).select("lsn", Q.is_write(F.col("sql")).alias("writes"), Q.is_write_old(F.col("sql")).alias("writes_old"), Q.is_fast_read(F.col("sql")).alias("fast_read")), ("logged",))
on_members("P13_live", "SELECT id FROM members WHERE age_s < 4 AND NOT is_lb", lambda m: M.live_servers(m).select("id"))
on_members("P16_stats", "SELECT id, address, status, last_applied_lsn, lag FROM members", lambda m: m.select("id", "address", "status", "last_applied_lsn", "lag"))
on_peers("P14_connected", "SELECT peer_id FROM peers WHERE peer_id % 3 > 0 AND rx % 300 < 120", lambda p: N.connected(p.withColumns({"session": F.when(F.col("peer_id") % 3 > 0, F.col("public_key")), "seen_s": F.col("rx") % 300})).select("peer_id"))
on_files("F9_bucket_key", "SELECT path, split_part(path, '/', 1) AS b, substr(path, length(split_part(path, '/', 1)) + 2) AS k, 'X' || chr(39) || lower(hex(encode(key))) || chr(39) AS literal, key AS plain FROM files", lambda f: f.select("path", F.substring_index("path", "/", 1).alias("b"), F.regexp_replace("path", "^[^/]*/", "").alias("k"), S.bytes_literal(F.encode("key", "utf-8")).alias("literal"), S.without_ansi(F.concat(F.lit("\x1b[31m"), "key", F.lit("\x1b[0m"))).alias("plain")))
on_files("R13_monotone", "SELECT path, size + CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END AS size FROM files WHERE path IS NOT NULL", lambda f: f.where("path IS NOT NULL").transform(lambda g: O.merged_sizes(g, g.withColumn("size", F.expr("CASE WHEN doc_id % 3 = 0 THEN size + 4 ELSE size - least(size, 2) END")))))
on_files("P12_exists_child", "SELECT DISTINCT bucket || '/' || split_part(key, '/', 1) AS path FROM files WHERE path IS NOT NULL", lambda f: O.with_children(f.select(F.concat("bucket", F.lit("/"), F.substring_index("key", "/", 1)).alias("path")).union(f.select(F.concat("path", F.lit("/none")))).distinct(), f.select("path")))
on_files("O6_offset", "SELECT path, size FROM files WHERE path IS NOT NULL ORDER BY path LIMIT 100 OFFSET 40", lambda f: f.where("path IS NOT NULL").select("path", "size").orderBy("path").offset(40).limit(100))
on_files("J7_inode_path", "SELECT doc_id AS ino, path, size FROM files WHERE path IS NOT NULL AND doc_id % 2 = 0", lambda f: f.where("doc_id % 2 = 0").select(F.col("doc_id").alias("ino"), "path").join(f.select("path", "size"), "path").select("ino", "path", "size"))
on_files("B11_updates", "SELECT path, CASE WHEN doc_id % 3 = 1 THEN 0 WHEN doc_id % 3 = 2 THEN size + 9 ELSE size END AS size, doc_id % 3 = 1 AS is_dir FROM files WHERE path IS NOT NULL AND doc_id % 5 <> 0", lambda f: f.where("path IS NOT NULL").withColumn("is_dir", F.lit(False)).transform(lambda g: O.updated(g, g.where("doc_id % 3 > 0").select(F.col("doc_id").alias("seq"), F.expr("CASE WHEN doc_id % 3 = 1 THEN 'mkdir' ELSE 'upsert' END").alias("op"), "path", (F.col("size") + 9).alias("size")).union(g.where("doc_id % 5 = 0").select(F.col("doc_id") + 1, F.lit("delete"), "path", "size")))))
on_files("B9_links", "SELECT 'link/' || doc_id AS path, size, hash FROM files WHERE path IS NOT NULL AND doc_id % 4 = 0", lambda f: O.linked(f, f.where("doc_id % 4 = 0").select(F.concat(F.lit("link/"), F.col("doc_id").cast("string")).alias("path"), F.col("path").alias("target")).union(f.select(F.lit("broken"), F.concat("path", F.lit("?"))))))
on_files("B7_unlink", "SELECT path, size FROM files WHERE path IS NOT NULL AND doc_id % 6 <> 0", lambda f: f.where("path IS NOT NULL").select("doc_id", "path", "size").transform(lambda g: O.removed(g, g.where("doc_id % 6 = 0").select("path").union(g.select(F.regexp_replace("path", "/[^/]*$", "")).distinct()))).select("path", "size"))

# Scalars
on_log("F13_times", "SELECT lsn, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS log_time, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso_time, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS http_time FROM wal", lambda w: w.select("lsn", S.log_time(F.col("ts")).alias("log_time"), S.iso_time(F.col("ts")).alias("iso_time"), S.http_time(F.col("ts")).alias("http_time")))
on_log("F17_snowflake", "WITH i AS (SELECT lsn, ((lsn - 1) << 22) | ((pk % 1024) << 12) | ((lsn - 1) % 4096) AS id FROM wal) SELECT id, id >> 22 AS ms, (id >> 12) & 1023 AS node, id & 4095 AS sequence FROM i", lambda w: w.select(S.snowflake(F.col("lsn") - 1, F.col("pk") % 1024, (F.col("lsn") - 1) % 4096).alias("id")).select("id", *[c.alias(n) for n, c in S.snowflake_parts(F.col("id")).items()]))
on_log("F30_json", "SELECT lsn, json_extract_string(props, '$.k') AS k FROM wal", lambda w: w.select("lsn", F.get_json_object("props", "$.k").alias("k")))
on_log("F16_days", "SELECT lsn, CAST(DATE '1970-01-01' + CAST(lsn % 40000 AS INTEGER) AS VARCHAR) AS day FROM wal", lambda w: w.select("lsn", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("lsn") % 40000).cast("int")).cast("string").alias("day")))
on_log("F21_format", "SELECT lsn, greatest(lsn - 500, 0) AS behind, CASE WHEN lsn >= 3600 THEN (lsn // 3600) || 'h ' || ((lsn % 3600) // 60) || 'm' WHEN lsn >= 60 THEN (lsn // 60) || 'm ' || (lsn % 60) || 's' ELSE lsn || 's' END AS age FROM wal", lambda w: w.select("lsn", F.greatest(F.col("lsn") - 500, F.lit(0)).alias("behind"), S.duration_text(F.col("lsn")).alias("age")))
on_log("F20_tuning", "SELECT lsn, greatest(least(lsn // 4, 8), 1) AS workers, greatest(greatest(least(lsn // 4, 8), 1), 2) AS replication_workers, least(greatest(((lsn * 64 * 15 // 100) // 1024) * 1000, 100), 10000) AS batch, least(greatest(((lsn * 64 * 15 // 100) // 1024) * 1000, 100), 10000) * 10 AS buffer FROM wal", lambda w: w.select("lsn", *[c.alias(n) for n, c in S.tuned(F.col("lsn"), F.col("lsn") * 64).items()]))
on_members("F10_hosts", "SELECT id, split_part(address, ':', 1) AS host, split_part(address, ':', 1) || ':8007' AS proxy FROM members", lambda m: m.select("id", S.host(F.col("address")).alias("host"), F.concat(S.host(F.col("address")), F.lit(":8007")).alias("proxy")))
on_members("F19_node_number", "SELECT id, CASE WHEN CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) > 65535 THEN 0 ELSE CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 1024 END AS node FROM members", lambda m: m.select("id", S.node_number(F.col("id")).alias("node")))
query("F1_literals", "SELECT doc_id, coalesce('''' || replace(text, '''', '''''') || '''', 'NULL') AS literal, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS short, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM documents")(lambda s, d: V.table(s, d, "documents").select("doc_id", S.literal(F.col("text")).alias("literal"), S.shortened(F.col("text"), 20).alias("short"), S.xml_text(F.col("text")).alias("xml")))
on_files("F23_hashes", "SELECT path, hash, left(hash, 2) || '/' || substr(hash, 3) AS chunk_path, CASE WHEN size = 0 THEN md5('') ELSE left(hash, 32) END AS etag, regexp_replace(path, '/?[^/]*$', '') AS parent FROM files", lambda f: f.select("path", "hash", S.chunk_path(F.col("hash")).alias("chunk_path"), O.etag(F.col("hash"), F.col("size")).alias("etag"), S.parent(F.col("path")).alias("parent")))
on_files("F22_crc32", None, lambda f: f.select("path", F.crc32("content").alias("crc")))
on_members("F6_sizes", None, lambda m: m.select("id", S.size_text(F.pow(F.lit(3), F.col("lag") % 30).cast("long")).alias("size"), S.json_kind(F.concat(F.lit('{"a":'), F.col("lag").cast("string"), F.lit("}"))).alias("kind")))

# Statements
_W, _WO = "|".join(Q.WRITES), "|".join(Q.WRITES_OLD)
_BARE = r"regexp_replace(trim(sql), '^(\s+|/\*(.|\n)*?\*/|--[^\n]*\n|#[^\n]*\n)+', '')"
query("Q1_class", f"SELECT n, regexp_matches(upper({_BARE}), '^({_W})') AS writes, regexp_matches(upper(trim(sql)), '^({_WO})') AS writes_old, regexp_matches(upper(sql), '^(SELECT|SHOW)') AS fast_read FROM statements", "statements")(lambda s, d: V.statements(s).select("n", Q.is_write(F.col("sql")).alias("writes"), Q.is_write_old(F.col("sql")).alias("writes_old"), Q.is_fast_read(F.col("sql")).alias("fast_read")))
query("Q4_route", f"SELECT n, CASE WHEN NOT regexp_matches(upper({_BARE}), '^({_W})') THEN 'local' WHEN n % 3 = 0 THEN 'local+log' WHEN n % 3 = 1 THEN 'forward' ELSE 'error' END AS route FROM statements", "statements")(lambda s, d: V.statements(s).select("n", Q.route(F.col("sql"), F.col("n") % 3 == 0, F.col("n") % 3 == 1).alias("route")))
query("P8_filters", r"SELECT n, NOT (regexp_matches(sql, '^(BEGIN|COMMIT|ROLLBACK)') OR sql LIKE '%wsrep%' OR sql LIKE '%WSREP%' OR (starts_with(sql, 'SET ') AND NOT contains(sql, '@@global'))) AS replicates, NOT (regexp_matches(upper(trim(sql)), '^(BEGIN|COMMIT|ROLLBACK|SAVEPOINT|RELEASE SAVEPOINT)') OR regexp_matches(upper(sql), 'INFORMATION_SCHEMA|PERFORMANCE_SCHEMA|MYSQL\.') OR (starts_with(upper(trim(sql)), 'SET ') AND NOT contains(upper(sql), '@@GLOBAL') AND NOT regexp_matches(upper(trim(sql)), '^SET (NAMES|CHARACTER)'))) AS logged FROM statements", "statements")(lambda s, d: V.statements(s).select("n", Q.replicates(F.col("sql")).alias("replicates"), Q.replicates_logged(F.col("sql")).alias("logged")))
query(
    "L2_ddl",
    "WITH k AS (SELECT n, sql, CASE WHEN upper(sql) LIKE 'CREATE TABLE%' THEN 'create table' WHEN upper(sql) LIKE 'DROP TABLE%' THEN 'drop table' WHEN upper(sql) LIKE 'ALTER TABLE%' THEN CASE WHEN upper(sql) LIKE '%ADD COLUMN%' THEN 'add column' WHEN upper(sql) LIKE '%DROP COLUMN%' THEN 'drop column' WHEN upper(sql) LIKE '%MODIFY%' THEN 'modify column' WHEN upper(sql) LIKE '%ADD INDEX%' THEN 'add index' WHEN upper(sql) LIKE '%DROP INDEX%' THEN 'drop index' ELSE 'other' END WHEN upper(sql) LIKE 'CREATE INDEX%' THEN 'create index' WHEN upper(sql) LIKE 'DROP INDEX%' THEN 'drop index' END AS kind FROM statements) SELECT n, kind, CASE WHEN kind IS NOT NULL THEN kind IN ('create table', 'add column', 'add index', 'drop index', 'create index') END AS safe, CASE WHEN kind IS NOT NULL THEN lower(replace(CASE WHEN regexp_matches(upper(sql), '^(CREATE|DROP) INDEX') THEN split_part(split_part(sql, ' ON ', 2), ' ', 1) ELSE split_part(sql, ' ', 3) END, '`', '')) END AS tbl FROM k",
    "statements",
)(lambda s, d: V.statements(s).select("n", Q.ddl_class(F.col("sql")).alias("kind"), Q.is_safe(Q.ddl_class(F.col("sql"))).alias("safe"), Q.ddl_table(F.col("sql")).alias("tbl")))
query("M10_skipped", "SELECT n, regexp_matches(upper(trim(sql)), '^(USE |LOCK TABLES|UNLOCK TABLES)') AS skipped, CASE WHEN regexp_matches(sql, '^(CREATE|DROP) DATABASE') THEN 'shop' END AS database, CASE WHEN sql LIKE 'USE %' THEN 'db' END AS used FROM statements", "statements")(lambda s, d: V.statements(s).select("n", Q.is_skipped(F.col("sql")).alias("skipped"), Q.database_of(F.col("sql")).alias("database"), Q.used_database(F.col("sql")).alias("used")))
query("M9_split")(lambda s, d: s.createDataFrame([(1, "USE a; INSERT INTO t VALUES ('x;y'); -- c;\nUPDATE t SET a=\"p;q\"; # z;\nDELETE FROM t"), (2, None), (3, "")], "n long, text string").select("n", F.posexplode_outer(Q.split_statements("text")).alias("k", "sql")))
on_log("Q6_session", "SELECT lsn, origin_node, last_value(CASE WHEN op = 'upsert' THEN tbl END IGNORE NULLS) OVER (PARTITION BY origin_node ORDER BY lsn) AS used FROM wal", lambda w: ordered.running_last(w.withColumn("u", F.when(F.col("op") == "upsert", F.col("tbl"))), ["origin_node"], "lsn", "u", "used").select("lsn", "origin_node", "used"))

# Members
_LEAD = "(SELECT max(last_applied_lsn) FROM members)"
on_members("P2_active", "SELECT id, address FROM members WHERE status = 'ACTIVE'", lambda m: M.active(m).select("id", "address"))
on_members("P3_others", "SELECT id FROM members WHERE id <> 'node-1' AND id NOT LIKE 'peer-%'", lambda m: M.others(m, "node-1").select("id"))
on_members("P4_needing_sync", "SELECT id FROM members WHERE id <> 'node-1' AND (status IN ('JOINING', 'SYNCING', 'LAGGING') OR lag > 0)", lambda m: M.needing_sync(m, "node-1").select("id"))
on_members("P5_readers", f"SELECT id, {_LEAD} - last_applied_lsn AS behind FROM members WHERE status = 'ACTIVE' AND NOT is_lb AND {_LEAD} - last_applied_lsn <= 50000", lambda m: M.healthy_readers(m, 50_000).select("id", "behind"))
on_members("P6_fresh", "SELECT id, coalesce(age_s < 10, false) AS fresh FROM members", lambda m: m.select("id", M.is_fresh(F.col("age_s"), 10).alias("fresh")))
on_members("P15_clusters", "SELECT id, CASE WHEN lag % 3 > 0 THEN 'c' || (lag % 2) END IS NULL OR CASE WHEN lag % 5 > 0 THEN 'c' || (lag % 4) END IS NULL OR 'c' || (lag % 2) = 'c' || (lag % 4) AS matches FROM members", lambda m: m.select("id", M.clusters_match(F.when(F.col("lag") % 3 > 0, F.concat(F.lit("c"), (F.col("lag") % 2).cast("string"))), F.when(F.col("lag") % 5 > 0, F.concat(F.lit("c"), (F.col("lag") % 4).cast("string")))).alias("matches")))
on_members("A1_summary", "SELECT count(*) AS total, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'LAGGING') AS lagging, count(*) FILTER (status = 'DROPPED') AS dropped, count(*) FILTER (is_lb) AS balancers, (SELECT id FROM members ORDER BY last_applied_lsn DESC, id DESC LIMIT 1) AS leader_id, min(id) FILTER (status = 'ACTIVE') AS lowest_active, count(*) // 2 + 1 AS quorum, count(*) FILTER (status = 'ACTIVE') >= 2 AS has_quorum FROM members", M.summary)
on_members("A19_by_status", "SELECT status, count(*) AS nodes, CAST(sum(lag) AS BIGINT) AS lag FROM members GROUP BY status", M.by_status)
on_members("J2_lag", f"SELECT id, greatest({_LEAD} - last_applied_lsn, 0) AS behind FROM members", lambda m: M.with_lag(m).select("id", "behind"))
on_members("J3_priority", "SELECT id FROM members WHERE status = 'ACTIVE' AND id < 'node-7' AND last_applied_lsn >= (SELECT max(last_applied_lsn) FROM members WHERE id = 'node-7')", lambda m: M.yields_to(m, "node-7").select("id"))
on_members("R7_timeouts", "SELECT id, CASE WHEN age_s IS NULL OR age_s < 5 THEN status WHEN status = 'ACTIVE' THEN 'LAGGING' WHEN status = 'LAGGING' AND age_s > 30 THEN 'DROPPED' WHEN status = 'DROPPED' AND age_s > 30 THEN 'REMOVED' ELSE status END AS next_status FROM members", lambda m: M.timeouts(m, 5, 10).select("id", "next_status"))
on_members("R6_heartbeat", "SELECT id, CASE WHEN status IN ('JOINING', 'OFFLINE') THEN 'ACTIVE' WHEN status = 'SYNCING' AND lag = 0 THEN 'ACTIVE' WHEN status = 'LAGGING' THEN 'SYNCING' ELSE status END AS next_status FROM members", lambda m: m.select("id", M.after_heartbeat(F.col("status"), F.col("lag")).alias("next_status")))
on_members("U1_merged", "WITH f AS (SELECT 'node-' || (lag + 1) AS id, min(address) AS address FROM members GROUP BY 1) SELECT id, address, 'known' AS origin FROM members UNION ALL SELECT id, address, 'found' FROM f WHERE id NOT IN (SELECT id FROM members)", lambda m: M.merged(m, m.select(F.concat(F.lit("node-"), (F.col("lag") + 1).cast("string")).alias("id"), "address")))
query("O7_round_robin", "WITH p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM members WHERE status = 'ACTIVE' AND NOT is_lb AND (SELECT max(last_applied_lsn) FROM members) - last_applied_lsn <= 100000) SELECT o_orderkey AS seq, p.id FROM orders LEFT JOIN p ON p.k = o_orderkey % p.n", "members")(lambda s, d: M.round_robin(V.table(s, d, "orders").select(F.col("o_orderkey").alias("seq")), V.members(s, d), "seq", 100_000))

on_members("K6_json", """SELECT '{"id":"' || id || '","lag":' || lag || CASE WHEN age_s IS NULL THEN '' ELSE ',"age_s":' || age_s END || '}' AS json FROM members""", lambda m: IO.as_json(m.select("id", "lag", "age_s")))

# Objects
query("B1_lookup", "WITH q AS (SELECT path FROM files WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'none/' || doc_id FROM labels) SELECT q.path, f.path IS NOT NULL AS found, f.size FROM q LEFT JOIN files f USING (path)", "files")(lambda s, d: V.files(s, d).transform(lambda f: O.looked_up(f.join(V.table(s, d, "labels"), "doc_id", "left_semi").select("path").unionByName(V.table(s, d, "labels").select(F.concat(F.lit("none/"), F.col("doc_id").cast("string")).alias("path"))), f)))
on_files("B6_create", "SELECT path, size, false AS is_dir FROM files UNION ALL SELECT DISTINCT path || '.new', 0, true FROM files WHERE path IS NOT NULL AND doc_id % 2 = 1", lambda f: O.created(f.select("path", "size", F.lit(False).alias("is_dir")), f.select(F.when(F.col("doc_id") % 2 == 1, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path")), directories=True))
on_files("A8_totals", "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files", lambda f: f.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")))
on_files("A9_buckets", "SELECT bucket, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE bucket IS NOT NULL GROUP BY bucket", O.buckets)
on_files("A10_listing", "SELECT DISTINCT split_part(key, '/', 1) || '/' AS prefix, CAST(NULL AS VARCHAR) AS key FROM files WHERE bucket = 'en' AND starts_with(key, 'src1') AND contains(key, '/') UNION ALL SELECT NULL, key FROM files WHERE bucket = 'en' AND starts_with(key, 'src1') AND NOT contains(key, '/')", lambda f: O.listing(f, "en", "src1"))
on_files("A11_dedup", "WITH p AS (SELECT hash, count(*) AS n, max(size) AS size FROM files GROUP BY hash) SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS stored_bytes FROM p", O.dedup_ratio)
on_files("O3_page", "WITH k AS (SELECT key, size, hash, row_number() OVER (ORDER BY key) AS r, count(*) OVER () AS n FROM files WHERE bucket = 'en' AND key > 'src2') SELECT key, size, hash, n > 50 AS truncated, CASE WHEN n > 50 THEN (SELECT key FROM k WHERE r = 50) END AS next_key FROM k WHERE r <= 50", lambda f: O.page(f, "en", "src2", 50))
_CHUNKS = "c AS (SELECT path, unnest(range(0, size, 1000)) AS \"offset\", size, h FROM files WHERE path IS NOT NULL), k AS (SELECT path, \"offset\", least(1000, size - \"offset\") AS size, sha256(unhex(substr(h, 2 * \"offset\" + 1, 2000))) AS hash FROM c)"
on_files("F33_chunks", f'WITH {_CHUNKS} SELECT path, CAST("offset" AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, hash FROM k', lambda f: O.chunked(f.where("path IS NOT NULL"), 1000).drop("data"))
on_files("K8_store", f"WITH {_CHUNKS} SELECT hash, CAST(max(size) AS BIGINT) AS size FROM k WHERE hash NOT IN (SELECT hash FROM k WHERE \"offset\" = 1000) GROUP BY hash", lambda f: O.chunked(f.where("path IS NOT NULL"), 1000).transform(lambda c: O.store(c, c.where("offset = 1000").select("hash").distinct())).drop("data"))
on_files("B3_read_range", "SELECT path, sha256(unhex(substr(h, 2 * (size // 3) + 1, 2 * (size // 2)))) AS digest FROM files WHERE path IS NOT NULL AND size // 2 > 0", lambda f: O.read_range(O.chunked(f.where("path IS NOT NULL"), 1000), f.where("path IS NOT NULL").select("path", F.floor(F.col("size") / 3).alias("lo"), (F.floor(F.col("size") / 3) + F.floor(F.col("size") / 2)).alias("hi"))).select("path", F.sha2("data", 256).alias("digest")))
on_files("J9_range", f'WITH {_CHUNKS} SELECT path, CAST("offset" AS BIGINT) AS "offset", CAST(greatest(500, "offset") AS BIGINT) AS from_byte, CAST(least(2500, "offset" + size) AS BIGINT) AS to_byte FROM k WHERE "offset" < 2500 AND "offset" + size > 500', lambda f: O.clipped(O.chunked(f.where("path IS NOT NULL"), 1000), f.where("path IS NOT NULL").select("path", F.lit(500).cast("long").alias("lo"), F.lit(2500).cast("long").alias("hi"))))
on_files("B4_overwrite", f'WITH {_CHUNKS} SELECT path, CAST("offset" AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size, hash FROM k WHERE "offset" + size <= 1500 OR "offset" >= 2100 UNION ALL SELECT path, 1500, 600, \'new\' FROM files WHERE path IS NOT NULL', lambda f: f.where("path IS NOT NULL").transform(lambda g: O.overwritten(O.chunked(g, 1000), g.select("path", F.lit(1500).cast("long").alias("offset"), F.lit(600).cast("long").alias("size"), F.lit("new").alias("hash")))))
on_files("R19_overlay", f'WITH {_CHUNKS} SELECT path, CAST("offset" AS BIGINT) AS "offset", CAST(CASE WHEN "offset" = 1000 THEN 7 ELSE size END AS BIGINT) AS size, CASE WHEN "offset" = 1000 THEN \'new\' ELSE hash END AS hash FROM k', lambda f: O.chunked(f.where("path IS NOT NULL"), 1000).transform(lambda c: O.overlaid(c, c.where("offset = 1000").select("path", "offset", F.lit(7).cast("long").alias("size"), F.lit("new").alias("hash")))))
on_files("B5_truncate", f'WITH {_CHUNKS} SELECT path, CAST("offset" AS BIGINT) AS "offset", CAST(least(size, 1500 - "offset") AS BIGINT) AS size FROM k WHERE "offset" < 1500', lambda f: O.truncated(O.chunked(f.where("path IS NOT NULL"), 1000), 1500).select("path", "offset", F.col("size").cast("long").alias("size")))
on_files("R17_messages", f'WITH {_CHUNKS}, m AS (SELECT path, "offset", (row_number() OVER (PARTITION BY path ORDER BY "offset") - 1) // 4 AS message FROM k) SELECT path, CAST(message AS BIGINT) AS message, count(*) AS chunks, CAST(min("offset") AS BIGINT) AS first FROM m GROUP BY path, message', lambda f: O.message_batches(O.chunked(f.where("path IS NOT NULL"), 1000), "path", "offset", 4))
query("J5_missing", "SELECT DISTINCT hash FROM files WHERE hash NOT IN (SELECT hash FROM files JOIN labels USING (doc_id))", "files")(lambda s, d: V.files(s, d).transform(lambda f: O.missing(f, f.join(V.table(s, d, "labels").select("doc_id"), "doc_id").select("hash").distinct())))
query("J6_exists", "SELECT path, size FROM files WHERE doc_id IN (SELECT doc_id FROM labels)", "files")(lambda s, d: V.files(s, d).join(V.table(s, d, "labels"), "doc_id", "left_semi").select("path", "size"))
on_files("J12_diff", "SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM files WHERE path IS NOT NULL AND NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)", lambda f: f.where("path IS NOT NULL").transform(lambda g: O.diff(g.where("doc_id % 5 <> 0").withColumn("size", F.when(F.col("doc_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))), g.where("doc_id % 7 <> 0"))))
on_files("U3_merge", "SELECT path, size + CASE WHEN doc_id % 4 = 0 THEN 5 WHEN doc_id % 4 = 2 THEN -least(size, 3) ELSE 0 END AS size, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS from_upsert FROM files WHERE path IS NOT NULL AND doc_id % 11 <> 0", lambda f: f.where("path IS NOT NULL").transform(lambda g: O.merge(g, g.where("doc_id % 2 = 0").withColumn("size", F.expr("size + CASE WHEN doc_id % 4 = 0 THEN 5 ELSE -least(size, 3) END")), g.where("doc_id % 11 = 0").select("path"))))
query("J10_changed", "WITH l AS (SELECT path, arg_max(is_deleted, version) AS gone FROM changes GROUP BY path) SELECT l.path, f.size FROM l JOIN files f ON f.doc_id = l.path WHERE NOT l.gone", "changes", "files")(lambda s, d: O.changed_entries(C.latest_op(V.changes(V.wal(s, d)), 0), V.files(s, d).select("doc_id", "size"), "doc_id"))
on_files("B2_children", "SELECT split_part(substr(path, 4), '/', 1) AS name, bool_or(contains(substr(path, 4), '/')) AS is_dir FROM files WHERE starts_with(path, 'en/') GROUP BY 1", lambda f: O.children(f, "en"))
on_files("B8_rename", "SELECT CASE WHEN starts_with(path, 'en/') THEN 'english' || substr(path, 3) ELSE path END AS path, size FROM files", lambda f: O.renamed(f, "en", "english"))
on_log("R12_islands", "WITH w AS (SELECT lsn AS seq, tbl, pk * 10 AS \"offset\", (pk % 3) * 10 AS size FROM wal), p AS (SELECT *, lag(\"offset\" + size) OVER (PARTITION BY tbl ORDER BY seq) AS e FROM w), g AS (SELECT *, sum(CASE WHEN e IS NULL OR e <> \"offset\" THEN 1 ELSE 0 END) OVER (PARTITION BY tbl ORDER BY seq) AS run FROM p) SELECT tbl, CAST(run AS BIGINT) AS run, min(seq) AS first_seq, min(\"offset\") AS \"offset\", CAST(sum(size) AS BIGINT) AS size, count(*) AS writes FROM g GROUP BY tbl, run", lambda w: O.coalesced_writes(w.select(F.col("lsn").alias("seq"), "tbl", (F.col("pk") * 10).alias("offset"), (F.col("pk") % 3 * 10).alias("size")), ["tbl"]))
on_log("R16_merge", "WITH w AS (SELECT tbl, lsn * 10 AS lo, lsn * 10 + pk * 2 AS hi FROM wal), p AS (SELECT *, max(hi) OVER (PARTITION BY tbl ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM w), g AS (SELECT *, sum(CASE WHEN e IS NULL OR lo > e THEN 1 ELSE 0 END) OVER (PARTITION BY tbl ORDER BY lo) AS run FROM p) SELECT tbl, CAST(run AS BIGINT) AS run, min(lo) AS lo, max(hi) AS hi, count(*) AS writes FROM g GROUP BY tbl, run", lambda w: O.merged_intervals(w.select("tbl", (F.col("lsn") * 10).alias("lo"), (F.col("lsn") * 10 + F.col("pk") * 2).alias("hi")), ["tbl"], "lo", 10 * ordered.WIDTH))
query("A18_schema_hash")(lambda s, d: S.schema_hash(s.createDataFrame([("a", "x", "int"), ("a", "y", "text"), ("b", "x", "int")], "table_name string, column_name string, data_type string")))

# Mesh
query("J8_next_hop", "WITH up AS (SELECT ip, min(peer_id) AS p FROM peers WHERE connected GROUP BY ip), d AS (SELECT DISTINCT ip AS dest FROM peers UNION SELECT 'net-' || n_nationkey FROM nation), r AS (SELECT 'net-' || n_nationkey AS dest, '10.0.' || n_nationkey || '.' || n_nationkey AS host FROM nation), v AS (SELECT r.dest, min(up.p) AS p FROM r JOIN up ON up.ip = r.host GROUP BY r.dest), y AS (SELECT p.ip AS dest, min(q.peer_id) AS p FROM peers p JOIN peers q ON q.ip = '10.0.' || p.nation || '.' || ((p.peer_id + 25) % 250) WHERE NOT p.connected AND p.peer_id % 2 = 0 GROUP BY p.ip), g AS (SELECT min(peer_id) AS p FROM peers WHERE connected AND is_gateway) SELECT d.dest, coalesce(up.p, v.p, y.p, g.p) AS hop, CASE WHEN up.p IS NOT NULL THEN 'direct' WHEN v.p IS NOT NULL THEN 'route' WHEN y.p IS NOT NULL THEN 'relay' WHEN g.p IS NOT NULL THEN 'gateway' ELSE 'broadcast' END AS how FROM d LEFT JOIN up ON up.ip = d.dest LEFT JOIN v ON v.dest = d.dest LEFT JOIN y ON y.dest = d.dest CROSS JOIN g", "peers")(lambda s, d: _hops(V.peers(s, d), V.table(s, d, "nation")))
on_peers("N2_broadcast", "WITH g AS (SELECT nation, min(peer_id) AS g FROM peers WHERE is_gateway GROUP BY nation) SELECT CASE WHEN connected THEN peer_id ELSE g END AS hop, count(*) AS peers FROM peers LEFT JOIN g USING (nation) WHERE connected OR g IS NOT NULL GROUP BY 1", N.broadcast_hops)
on_peers("A7_traffic", "SELECT nation, CAST(sum(rx) AS BIGINT) AS rx, CAST(sum(tx) AS BIGINT) AS tx, count(*) FILTER (connected) AS connected, count(*) AS peers FROM peers GROUP BY nation", N.traffic)
on_peers("J11_identity", "WITH k AS (SELECT peer_id, CASE WHEN peer_id % 2 = 0 THEN ip ELSE 'moved' END AS ip, public_key FROM peers), i AS (SELECT ip, min(peer_id) AS p FROM peers GROUP BY ip) SELECT k.peer_id, coalesce(i.p, k.peer_id) AS sender FROM k LEFT JOIN i USING (ip)", lambda p: N.identified(p.select("peer_id", F.when(F.col("peer_id") % 2 == 0, F.col("ip")).otherwise("moved").alias("ip"), "public_key"), p).select("peer_id", "sender"))
on_peers("U4_exchange", "WITH k AS (SELECT 'h' || peer_id AS ip, public_key, connected FROM peers WHERE peer_id % 3 > 0), o AS (SELECT 'h' || peer_id AS ip, public_key FROM peers WHERE peer_id % 2 = 0 AND 'h' || peer_id <> 'h4') SELECT k.ip, k.public_key, CASE WHEN o.ip IS NOT NULL AND NOT k.connected THEN 'h1' END AS relay FROM k LEFT JOIN o ON o.ip = k.ip UNION ALL SELECT ip, public_key, 'h1' FROM o WHERE ip NOT IN (SELECT ip FROM k)", lambda p: p.withColumn("ip", F.concat(F.lit("h"), F.col("peer_id").cast("string"))).transform(lambda q: N.exchanged(q.where("peer_id % 3 > 0"), q.where("peer_id % 2 = 0"), "h1", "h4")))
on_log("F34_replay_window", "WITH p AS (SELECT lsn, pk * 7 % 1000 AS counter, max(pk * 7 % 1000) OVER (PARTITION BY origin_node ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM wal) SELECT lsn, counter FROM p WHERE highest - counter > 32 AND NOT (counter < 100 AND highest > 100)", lambda w: N.stale_packets(w.withColumn("counter", F.col("pk") * 7 % 1000), ["origin_node"], "lsn", "counter").select("lsn", "counter"))


on_peers("N5_status", "SELECT peer_id, ip AS address, CASE WHEN connected THEN ip || ':9600' ELSE '-' END AS endpoint, CASE WHEN connected THEN peer_id % 60 ELSE 9223372036854775807 END AS last_seen_s, rx AS rx_bytes, tx AS tx_bytes, connected, is_gateway FROM peers", lambda p: N.status_table(p.withColumn("endpoint", F.when(F.col("connected"), F.concat("ip", F.lit(":9600")))).withColumn("last_seen_s", F.when(F.col("connected"), F.col("peer_id") % 60))))


@query(
    "N8_inbound",
    """WITH k AS (SELECT o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN '10.0.1.1' WHEN 1 THEN '10.0.1.255' WHEN 2 THEN '10.0.' || (o_custkey % 25) || '.' || (o_custkey % 250) WHEN 3 THEN 'net-' || (o_custkey % 40) ELSE '255.255.255.255' END AS dest FROM orders),
u AS (SELECT DISTINCT ip FROM peers WHERE connected), r AS (SELECT 'net-' || n_nationkey AS dest, '10.0.' || n_nationkey || '.' || n_nationkey AS host FROM nation),
a AS (SELECT seq, k.dest, host, CASE WHEN k.dest = '10.0.1.1' THEN 'deliver' WHEN k.dest IN ('10.0.1.255', '255.255.255.255') THEN 'broadcast' WHEN k.dest IN (SELECT ip FROM u) THEN 'forward' WHEN host IS NULL THEN 'local' WHEN host = '10.0.1.1' THEN 'deliver' WHEN host IN (SELECT ip FROM u) THEN 'route' ELSE 'drop' END AS action FROM k LEFT JOIN r ON r.dest = k.dest)
SELECT seq, dest, action, CASE action WHEN 'forward' THEN dest WHEN 'route' THEN host END AS hop FROM a""",
    "peers",
)
def inbound(s: SparkSession, d: str) -> DataFrame:
    text = lambda e: F.expr(f"CAST({e} AS STRING)")
    kind = F.col("o_orderkey") % 5
    dest = F.when(kind == 0, "10.0.1.1").when(kind == 1, "10.0.1.255").when(kind == 2, F.concat(F.lit("10.0."), text("o_custkey % 25"), F.lit("."), text("o_custkey % 250"))).when(kind == 3, F.concat(F.lit("net-"), text("o_custkey % 40"))).otherwise("255.255.255.255")
    k = text("n_nationkey")
    routes = V.table(s, d, "nation").select(F.concat(F.lit("net-"), k).alias("dest"), F.concat(F.lit("10.0."), k, F.lit("."), k).alias("host"))
    return N.dispatched(V.table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), dest.alias("dest")), V.peers(s, d), routes, "10.0.1.1")


def _hops(peers: DataFrame, nation: DataFrame) -> DataFrame:
    net = F.concat(F.lit("net-"), F.col("n_nationkey").cast("string"))
    routes = nation.select(net.alias("dest"), F.concat(F.lit("10.0."), F.col("n_nationkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string")).alias("host"))
    relays = peers.where("NOT connected AND peer_id % 2 = 0").select(F.col("ip").alias("dest"), F.concat(F.lit("10.0."), F.col("nation").cast("string"), F.lit("."), ((F.col("peer_id") + 25) % 250).cast("string")).alias("relay"))
    return N.next_hops(peers.select(F.col("ip").alias("dest")).union(nation.select(net)), peers, routes, relays)


# Streams
@query("R5_follow", "SELECT tbl, count(*) AS entries, max(lsn) AS last_lsn FROM wal GROUP BY tbl", "wal")
def follow(s: SparkSession, d: str) -> DataFrame:
    """The log as a stream of files, with a repeated part, applied once."""
    top = shared_folder(s)
    log = V.wal(s, d).select("lsn", "tbl", "pk", "op")
    log.repartitionByRange(4, "lsn").write.parquet(f"{top}/log")
    log.where("lsn <= 100").write.mode("append").parquet(f"{top}/log")
    R.follow(R.log_stream(s, f"{top}/log", log.schema, 2), f"{top}/applied", f"{top}/state")
    return R.progress(R.applied(s, f"{top}/applied")).select("tbl", "entries", "last_lsn")
