"""Scalar functions of the log, the store and the mesh, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An id is milliseconds after EPOCH (41 bits), a node (10) and a sequence (12).
EPOCH, NODE_BITS, SEQUENCE_BITS = 1704067200000, 10, 12


def snowflake(ms: Column, node: Column, sequence: Column) -> Column:
    return F.shiftleft(ms, NODE_BITS + SEQUENCE_BITS).bitwiseOR(F.shiftleft(node, SEQUENCE_BITS)).bitwiseOR(sequence)


def snowflake_parts(ident: Column) -> dict[str, Column]:
    return {"ms": F.shiftright(ident, NODE_BITS + SEQUENCE_BITS), "node": F.shiftright(ident, SEQUENCE_BITS).bitwiseAND(F.lit((1 << NODE_BITS) - 1)), "sequence": ident.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1))}


def node_number(name: Column) -> Column:
    """Trailing digits modulo 1024 (0 beyond 65535), else the 31-times rolling hash of the bytes modulo 1024.

    1024 divides 2^64, so the hash can be kept modulo 1024 all along.
    """
    digits = F.regexp_extract(name, r"([0-9]+)$", 1)
    number = F.when((F.length(F.ltrim(digits, F.lit("0"))) > 5) | (F.try_to_number(F.right(F.concat(F.lit("000000"), digits), F.lit(6)), F.lit("999999")) > 65535), F.lit(0)).otherwise(F.right(F.concat(F.lit("000000"), digits), F.lit(6)).try_cast("int"))
    code = lambda h, i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    h = F.hex(F.encode(name, "utf-8"))
    rolling = F.aggregate(F.when(F.length(name) > 0, F.sequence(F.lit(0), F.octet_length(F.encode(name, "utf-8")) - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda acc, i: (acc * 31 + code(h, i)) % 1024)
    return F.when(digits == "", rolling).otherwise(number % 1024).cast("long")


def literal(value: Column) -> Column:
    """A string as an SQL literal; null as NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def bytes_literal(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("X'"), F.lower(F.hex(value)), F.lit("'")), F.lit("NULL"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def size_text(n: Column) -> Column:
    """Bytes for people."""
    unit = lambda k, name: F.concat(F.format_string("%.1f", n / float(1 << 10 * k)), F.lit(name))
    return F.when(n >= 1 << 40, unit(4, " TB")).when(n >= 1 << 30, unit(3, " GB")).when(n >= 1 << 20, unit(2, " MB")).when(n >= 1 << 10, unit(1, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def duration_text(s: Column) -> Column:
    whole = lambda a, b: F.floor(a / b).cast("long").cast("string")
    return F.when(s >= 3600, F.concat(whole(s, 3600), F.lit("h "), whole(s % 3600, 60), F.lit("m"))).when(s >= 60, F.concat(whole(s, 60), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def xml_text(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def host(address: Column) -> Column:
    return F.substring_index(address, ":", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def log_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def iso_time(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))


def http_time(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def chunk_path(hash_: Column) -> Column:
    return F.concat(F.left(hash_, F.lit(2)), F.lit("/"), F.substring(hash_, 3, 64))


def json_kind(text: Column) -> Column:
    """The kind of value that a JSON text becomes."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), "invalid").when(kind == "VOID", "null").when(kind == "BOOLEAN", "bool").when(kind == "STRING", "string").when(kind.isin("BIGINT"), "int").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").otherwise("json")


def tuned(cores: Column, ram_mb: Column) -> dict[str, Column]:
    """Worker threads, replication workers, batch and buffer sizes for a machine."""
    workers = F.greatest(F.least(F.floor(cores / 4), F.lit(8)), F.lit(1)).cast("long")
    batch = F.least(F.greatest(F.floor(F.floor(ram_mb * 15 / 100) / 1024) * 1000, F.lit(100)), F.lit(10000)).cast("long")
    return {"workers": workers, "replication_workers": F.greatest(workers, F.lit(2)), "batch": batch, "buffer": batch * 10}


def schema_hash(columns) -> "object":
    """(schema_crc): CRC-32 over sorted table, column and type names. columns: table_name, column_name, data_type."""
    rows = columns.agg(F.sort_array(F.collect_list(F.concat_ws("\x1f", "table_name", "column_name", "data_type"))).alias("r"))
    return rows.select(F.crc32(F.encode(F.array_join("r", "\x1e"), "utf-8")).alias("schema_crc"))
