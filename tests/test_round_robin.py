"""Turns of readers against plain Python, and no array of all readers."""

from logmere.operators import cluster


def test_round_robin(spark):
    for count in (0, 1, 7, 300):
        ids = [f"node-{i}" for i in range(count)]
        m = spark.createDataFrame([*((i, "ACTIVE", False, 5) for i in ids), ("down", "OFFLINE", False, 5), (None, "ACTIVE", False, 5)], "id string, status string, is_lb boolean, last_applied_lsn long").repartition(5)
        asked = spark.range(-3, 400).withColumnRenamed("id", "seq")
        out = cluster.round_robin(asked, m, "seq")
        ids.sort()
        assert sorted(x[:] for x in out.select("seq", "id").collect()) == [(i, ids[i % count] if count else None) for i in range(-3, 400)]
        assert out.columns == ["seq", "id"]
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
