"""Log, member, file and peer tables, derived from the driver's tables; each also as SQL for the oracle.

On real data, read the log and the index with the readers of sources.files and pass them to the same operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ["ACTIVE", "JOINING", "SYNCING", "LAGGING", "DROPPED", "OFFLINE", "NEEDS_MIGRATION"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wal(spark: SparkSession, sf: str) -> DataFrame:
    """The change log: lsn, ts, origin_node, tbl, pk, op, value, props."""
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "purchase", "upsert").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "delete").otherwise("noop")
    return table(spark, sf, "events").select((F.col("event_id") + 1).alias("lsn"), "ts", F.concat(F.lit("node-"), (F.col("user_id") % 3 + 1).cast("string")).alias("origin_node"), F.concat(F.lit("tbl_"), (F.col("user_id") % 5).cast("string")).alias("tbl"), F.col("user_id").alias("pk"), op.alias("op"), "value", "props")


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster members: id, address, status, is_lb, last_applied_lsn, lag, age_s (null: never heard of)."""
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (k % 7 + 1).cast("int"))
    lsn = F.floor(F.greatest(F.col("s_acctbal"), F.lit(0.0)) * 10).cast("long")
    return table(spark, sf, "supplier").select(F.concat(F.when(k % 13 == 0, "peer-").otherwise("node-"), k.cast("string")).alias("id"), F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."), (k % 250).cast("string"), F.lit(":7654")).alias("address"), status.alias("status"), (k % 5 == 0).alias("is_lb"), lsn.alias("last_applied_lsn"), (k % 150).alias("lag"), F.when(k % 11 != 0, k % 40).alias("age_s"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """The object index: path, bucket, key, size (bytes), hash, text."""
    d = table(spark, sf, "documents")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return d.select("doc_id", F.concat("lang", F.lit("/"), key).alias("path"), F.col("lang").alias("bucket"), key.alias("key"), F.octet_length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("hash"), raw.alias("content"))


def changes(log: DataFrame) -> DataFrame:
    """The index change log: version, path, is_deleted."""
    return log.where("op <> 'noop'").select(F.col("lsn").alias("version"), F.col("pk").alias("path"), (F.col("op") == "delete").alias("is_deleted"))


def peers(spark: SparkSession, sf: str) -> DataFrame:
    """Mesh peers: peer_id, ip, public_key, nation, is_gateway, connected, rx, tx."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("peer_id"), F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."), (k % 250).cast("string")).alias("ip"), F.sha2(k.cast("string"), 256).alias("public_key"), F.col("s_nationkey").alias("nation"), (k % 10 == 0).alias("is_gateway"), (F.col("s_acctbal") > 0).alias("connected"), (k * 7).alias("rx"), (k * 3).alias("tx"))


def logged_statements(log: DataFrame) -> DataFrame:
    """A statement for each entry of the log: lsn, sql."""
    pk, tbl = F.col("pk").cast("string"), F.concat(F.lit("`"), "tbl", F.lit("`"))
    sql = F.when(F.col("op") == "insert", F.concat(F.lit("INSERT INTO "), tbl, F.lit(" VALUES ("), pk, F.lit(")"))).when(F.col("op") == "upsert", F.concat(F.lit("/* up */ replace into "), tbl, F.lit("(id) VALUES ("), pk, F.lit(")"))).when(F.col("op") == "update", F.concat(F.lit("UPDATE "), tbl, F.lit(" SET a = 1 WHERE id = "), pk)).when(F.col("op") == "delete", F.concat(F.lit("DELETE FROM "), tbl, F.lit(" WHERE id = "), pk)).otherwise(F.concat(F.lit("SELECT "), pk))
    return log.select("lsn", "tbl", sql.alias("sql"))


#: Fixed statements that exercise each class, with their database.
STATEMENTS = [
    "INSERT INTO test VALUES (1)", "SELECT * FROM test", "/* c */ insert into t values (1)", "RENAME TABLE a TO b", "CALL p()", "GRANT ALL ON a TO b", "BEGIN", "FLUSH LOGS", "USE db", "SET x=1",
    "WITH c AS (SELECT 1) INSERT INTO t SELECT * FROM c", "CREATE TABLE `users` (id INT)", "ALTER TABLE users ADD COLUMN name VARCHAR(255)", "drop table `test`", "ALTER TABLE a DROP COLUMN b", "ALTER TABLE a MODIFY b INT", "ALTER TABLE a ADD INDEX i (b)", "ALTER TABLE a DROP INDEX i", "ALTER TABLE a ENGINE=InnoDB", "CREATE INDEX i ON Users (id)", "DROP INDEX i ON Users",
    "SAVEPOINT s", "SET NAMES utf8", "SET @@global.x = 1", "SELECT * FROM information_schema.tables", "update mysql.user SET a = 1", "insert into wsrep_log values (1)", "  # note", "CREATE DATABASE IF NOT EXISTS shop", "DROP DATABASE shop", "LOCK TABLES a READ", "UNLOCK TABLES", "START TRANSACTION", "COMMIT", "show tables", "DELETE FROM `Orders` WHERE id=1", "REPLACE INTO t(a) VALUES (1)",
]


def statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(STATEMENTS)], "n long, sql string")


_status = "CASE s_suppkey % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUSES)) + " END"
_text = ", ".join("({}, '{}')".format(i, s.replace("'", "''")) for i, s in enumerate(STATEMENTS))
#: The same tables as SQL.
SQL = {
    "wal": "SELECT event_id + 1 AS lsn, ts, 'node-' || (user_id % 3 + 1) AS origin_node, 'tbl_' || (user_id % 5) AS tbl, user_id AS pk, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'upsert' WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'noop' END AS op, value, props FROM events",
    "members": f"SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'peer-' ELSE 'node-' END || s_suppkey AS id, '10.0.' || s_nationkey || '.' || (s_suppkey % 250) || ':7654' AS address, {_status} AS status, s_suppkey % 5 = 0 AS is_lb, CAST(floor(greatest(s_acctbal, 0.0) * 10) AS BIGINT) AS last_applied_lsn, s_suppkey % 150 AS lag, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 40 END AS age_s FROM supplier",
    "files": "SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, lang AS bucket, source || '/' || doc_id AS key, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS hash, hex(encode(coalesce(text, ''))) AS h FROM documents",
    "changes": "SELECT event_id + 1 AS version, user_id AS path, event_type = 'error' AS is_deleted FROM events WHERE event_type IN ('signup', 'purchase', 'click', 'error')",
    "peers": "SELECT s_suppkey AS peer_id, '10.0.' || s_nationkey || '.' || (s_suppkey % 250) AS ip, sha256(CAST(s_suppkey AS VARCHAR)) AS public_key, s_nationkey AS nation, s_suppkey % 10 = 0 AS is_gateway, s_acctbal > 0 AS connected, s_suppkey * 7 AS rx, s_suppkey * 3 AS tx FROM supplier",
    "logged": "SELECT event_id + 1 AS lsn, 'tbl_' || (user_id % 5) AS tbl, CASE event_type WHEN 'signup' THEN 'INSERT INTO `tbl_' || (user_id % 5) || '` VALUES (' || user_id || ')' WHEN 'purchase' THEN '/* up */ replace into `tbl_' || (user_id % 5) || '`(id) VALUES (' || user_id || ')' WHEN 'click' THEN 'UPDATE `tbl_' || (user_id % 5) || '` SET a = 1 WHERE id = ' || user_id WHEN 'error' THEN 'DELETE FROM `tbl_' || (user_id % 5) || '` WHERE id = ' || user_id ELSE 'SELECT ' || user_id END AS sql FROM events",
    "statements": f"SELECT CAST(n AS BIGINT) AS n, sql FROM (VALUES {_text}) AS v(n, sql)",
}
