"""Classes of SQL statements, as column expressions; and the splitter of multi-statement text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The first words of writing statements, of the current and of the older rule.
WRITES = ["CREATE", "ALTER", "DROP", "RENAME", "TRUNCATE", "INSERT", "UPDATE", "DELETE", "REPLACE", "LOAD", "CALL", "GRANT", "REVOKE", "START", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "ANALYZE", "OPTIMIZE", "REPAIR", "FLUSH"]
WRITES_OLD = ["INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "TRUNCATE", "REPLACE"]
SPACES = " \t\n\r"
_COMMENT = r"^(?:\s+|/\*(?s:.*?)\*/|--[^\n]*\n|#[^\n]*\n)+"


def without_comments(sql: Column) -> Column:
    """The statement from its first word on."""
    return F.regexp_replace(F.trim(sql), _COMMENT, "")


def is_write(sql: Column) -> Column:
    return F.upper(without_comments(sql)).rlike("^(?:" + "|".join(WRITES) + ")")


def is_write_old(sql: Column) -> Column:
    """Comments hide a write from this rule."""
    return F.upper(F.trim(sql)).rlike("^(?:" + "|".join(WRITES_OLD) + ")")


def is_fast_read(sql: Column) -> Column:
    return F.upper(sql).rlike("^(?:SELECT|SHOW)")


def route(sql: Column, leads: Column, leader_known: Column) -> Column:
    """Where a statement runs."""
    return F.when(is_fast_read(sql) | ~is_write(sql), "local").when(leads, "local+log").when(leader_known, "forward").otherwise("error")


def replicates(sql: Column) -> Column:
    """The filter that decides: case matters."""
    control = sql.rlike("^(?:BEGIN|COMMIT|ROLLBACK)") | sql.rlike("wsrep|WSREP")
    return ~(control | (sql.startswith("SET ") & ~F.contains(sql, F.lit("@@global"))))


def replicates_logged(sql: Column) -> Column:
    """The other filter, which only decides what is reported."""
    s = F.upper(F.trim(sql))
    control = s.rlike("^(?:BEGIN|COMMIT|ROLLBACK|SAVEPOINT|RELEASE SAVEPOINT)") | s.rlike(r"INFORMATION_SCHEMA|PERFORMANCE_SCHEMA|MYSQL\.")
    return ~(control | (s.startswith("SET ") & ~s.rlike("@@GLOBAL") & ~s.rlike("^SET (?:NAMES|CHARACTER)")))


def ddl_class(sql: Column) -> Column:
    """The kind of schema change; null for other statements. An ALTER is tried in this order."""
    s = F.upper(sql)
    alter = F.when(s.rlike("ADD COLUMN|ADD `"), "add column").when(s.rlike("DROP COLUMN|DROP `"), "drop column").when(s.rlike("MODIFY|CHANGE"), "modify column").when(s.rlike("ADD INDEX|ADD KEY"), "add index").when(s.rlike("DROP INDEX|DROP KEY"), "drop index").otherwise("other")
    return F.when(s.startswith("CREATE TABLE"), "create table").when(s.startswith("DROP TABLE"), "drop table").when(s.startswith("ALTER TABLE"), alter).when(s.startswith("CREATE INDEX"), "create index").when(s.startswith("DROP INDEX"), "drop index")


def is_safe(kind: Column) -> Column:
    """Whether a schema change loses no data; null for none."""
    return F.when(kind.isin("create table", "add column", "add index", "drop index", "create index"), True).when(kind.isNotNull(), False)


_NAME = r"[`\"]?([^`\"\s(;]+)"


def ddl_table(sql: Column) -> Column:
    """The lower-cased table of a schema change; null for other statements."""
    index = F.regexp_extract(sql, r"(?i)^\s*(?:CREATE|DROP)\s+INDEX\s+\S+\s+ON\s+" + _NAME, 1)
    table = F.regexp_extract(sql, r"(?i)^\s*(?:CREATE|DROP|ALTER)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?" + _NAME, 1)
    return F.nullif(F.lower(F.concat(index, table)), F.lit(""))


def dml_table(sql: Column) -> Column:
    """The table that a statement writes to; null for other statements."""
    return F.nullif(F.regexp_extract(without_comments(sql), r"(?i)^(?:(?:INSERT|REPLACE)\s+INTO|UPDATE|DELETE\s+FROM)\s+" + _NAME, 1), F.lit(""))


def database_of(sql: Column) -> Column:
    """The database that CREATE or DROP DATABASE names; null for other statements."""
    return F.nullif(F.regexp_extract(sql, r"(?i)^\s*(?:CREATE|DROP)\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?" + _NAME, 1), F.lit(""))


def is_skipped(sql: Column) -> Column:
    """Session statements that replay leaves out."""
    return F.upper(F.trim(sql)).rlike("^(?:USE |LOCK TABLES|UNLOCK TABLES)")


def used_database(sql: Column) -> Column:
    return F.nullif(F.regexp_extract(sql, r"(?i)^\s*USE\s+" + _NAME, 1), F.lit(""))


#: Quoted strings, quoted names and comments are taken whole, so their semicolons part nothing.
_PIECE = re.compile(r"""(?:'(?:[^'\\]|\\.|'')*(?:'|$)|"(?:[^"\\]|\\.|"")*(?:"|$)|`[^`]*(?:`|$)|--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|$)|[^;])+""", re.S)


def pieces(text: str | None) -> list[str]:
    return [p for m in _PIECE.finditer(text or "") if (p := m[0].strip())]


@F.pandas_udf(ArrayType(StringType()))
def split_statements(text: pd.Series) -> pd.Series:
    """The statements of a text; null has none."""
    return text.map(pieces)
