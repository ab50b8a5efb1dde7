"""Every registered query against its SQL; the others against known answers."""

import zlib

import pytest
from compare import differences

from logmere.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    assert not differences(QUERIES[name](spark, sf), SQL[name], sf)


def test_known_answers(spark, sf):
    pieces = [r["sql"] for r in QUERIES["M9_split"](spark, sf).where("n = 1").orderBy("k").collect()]
    assert pieces == ["USE a", "INSERT INTO t VALUES ('x;y')", '-- c;\nUPDATE t SET a="p;q"', "# z;\nDELETE FROM t"]
    assert QUERIES["A18_schema_hash"](spark, sf).first()[0] == zlib.crc32(b"a\x1fx\x1fint\x1ea\x1fy\x1ftext\x1eb\x1fx\x1fint")
    sizes = {r["size"] for r in QUERIES["F6_sizes"](spark, sf).collect()}
    assert {"1 B", "27 B"} <= sizes
    assert QUERIES["F22_crc32"](spark, sf).where("crc IS NULL").count() == 0
