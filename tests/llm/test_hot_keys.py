"""Joins by keys of which one may hold most rows."""

import pytest

pytest.importorskip("logmere.llm")
from pyspark.sql import functions as F

from logmere.llm._common import HOT, joined_by_key


@pytest.mark.parametrize("hot", [0, 1, 2500])
def test_joined_by_key(spark, hot):
    rows = [(i, "hot") for i in range(hot)] + [(i, f"k{i % 1500}") for i in range(3000)] + [(9, None), (None, "k3"), (None, "hot")]
    times = {}
    for _, k in rows:
        times[k] = times.get(k, 0) + 1
    facts = [(k, k.upper(), n) for k, n in times.items() if k and n > 1]
    assert hot < 2500 or max(times.values()) * HOT > len(rows)
    left = spark.createDataFrame(rows, "id long, key string").repartition(3)
    right = spark.createDataFrame(facts, "key string, value string, n long")
    got = joined_by_key(left, right, "key", F.col("id").cast("string"))
    assert got.columns == ["id", "key", "value"]
    known = {k: v for k, v, _ in facts}
    order = lambda r: tuple((x is not None, x if x is not None else 0) if i == 0 else (x is not None, x or "") for i, x in enumerate(r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted([(i, k, known.get(k)) for i, k in rows], key=order)
