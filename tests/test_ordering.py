"""Positions within keys, in files, and figures of running jobs."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators import ordering as O


def test_positions_within_keys(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([1, 1, 1, 2, None]), r.random(), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, j int, x double, id long").repartition(7)
    groups = defaultdict(list)
    for k, j, x, i in rows:
        groups[k, j].append((-x, i))
    want = {i: n for own in groups.values() for n, (_, i) in enumerate(sorted(own))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the hot key is several ranges
    try:
        out = O.positioned_within(df, ["k", "j"], F.desc("x"), "id", name="at")
        assert out.columns == ["k", "j", "x", "id", "at"] and {r.id: r["at"] for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.id: r.position for r in O.positioned_within(df, ["k", "j"], F.desc("x"), "id").collect()} == want
    assert O.positioned_within(df.limit(0), ["k"], "id").count() == 0


def test_file_order(spark, tmp_path):
    for part, ids in enumerate([[5, 3, 9], [1], [8, 8, 2]]):
        spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, n int").coalesce(1).sortWithinPartitions("n").write.parquet(f"{tmp_path}/t/p={part}")
    out = O.in_file_order(spark.read.parquet(f"{tmp_path}/t")).orderBy("position").collect()
    assert [r.id for r in out] == [5, 3, 9, 1, 8, 8, 2] and [r.position for r in out] == list(range(7))


def test_figures_of_the_job_that_stores(spark, tmp_path):
    df = spark.range(100).withColumn("odd", F.col("id") % 2)
    out, seen = M.stored(df, f"{tmp_path}/x", odd=F.sum("odd"), most=F.max("id"))
    assert out.count() == 100 and (seen["rows"], seen["odd"], seen["most"]) == (100, 50, 99) and seen["seconds"] > 0
    _, seen = M.stored(df.limit(0), f"{tmp_path}/y", most=F.max("id"))
    assert seen["rows"] == 0 and seen["most"] is None
