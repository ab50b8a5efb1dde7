"""Readers and writers: change logs, file indexes, status and route files, listings.

Everything goes through Spark's readers, so any store that Spark knows will do. Logs are written in segments of a
fixed number of positions, in order, and partitioned by ranges of positions, so that a range scan reads only the
partitions, and by the files' bounds only the parts of them, that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "lsn long, term long, ts timestamp, origin_node string, tbl string, pk long, op string, value double, props string"
INDEX = "path string, size long, is_dir boolean, permissions int, uid int, gid int, created timestamp, modified timestamp, accessed timestamp, chunks array<struct<hash:string,offset:bigint,size:bigint>>, symlink_target string"
INDEX_VERSION = 1
#: Positions that share a partition, where segments are shorter.
SHARED = 1 << 20


def _positions(segment: int) -> int:
    """Positions of a partition: whole segments, one at least."""
    return max(1, SHARED // segment) * segment


def write_log(log: DataFrame, path: str, segment: int = 1 << 20, mode: str = "append") -> None:
    """Segments of `segment` positions, numbered by a column; short ones share a partition, so files grow with the entries and not with the segments."""
    s = log.withColumn("segment", F.floor((F.col("lsn") - 1) / segment).cast("long")).withColumn("range", F.floor((F.col("lsn") - 1) / _positions(segment)).cast("long"))
    s.repartitionByRange(F.col("lsn")).sortWithinPartitions("range", "lsn").write.mode(mode).partitionBy("range").parquet(path)


def read_log(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, segment: int = 1 << 20) -> DataFrame:
    """The log, or a range of it; the bounds also prune partitions."""
    log = spark.read.parquet(path)
    if first is not None:
        log = log.where((F.col("range") >= (first - 1) // _positions(segment)) & (F.col("lsn") >= first))
    if last is not None:
        log = log.where((F.col("range") <= (last - 1) // _positions(segment)) & (F.col("lsn") <= last))
    return log.drop("segment", "range")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON lines with a version; entries of another version go."""
    return spark.read.schema(f"version int, {INDEX}").json(path).where(F.col("version") == INDEX_VERSION).drop("version")


def write_index(index: DataFrame, path: str) -> None:
    index.withColumn("version", F.lit(INDEX_VERSION)).write.json(path)


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """(dest, host) of JSON maps, one map a line."""
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("dest", "host"))


def read_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A snapshot of a database's table, read in `parts` ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def write_listing(listing: DataFrame, path: str) -> None:
    """A listing as XML."""
    listing.write.option("rowTag", "Contents").option("rootTag", "ListBucketResult").xml(path)


def tables(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, data_type, ordinal) of the catalog; its size is the catalog's."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")


def list_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a written log by number; only this column is read."""
    return spark.read.parquet(path).select("segment").distinct().orderBy("segment")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; null fields stay out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def write_status(status: DataFrame, path: str) -> None:
    """A status file, as JSON lines; a status before it goes."""
    status.write.mode("overwrite").json(path)


def read_status(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
