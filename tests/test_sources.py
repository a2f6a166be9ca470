"""Sources over tables that are folders of part files, and streams of them."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.queries.sources import src_baseline, src_list_files
from plumbline.sources import files, paths
from plumbline.streaming import stateful


def test_a_folder_of_parts_is_one_table(spark, tmp_path):
    for name, size in (("a.parquet", 3), ("b.parquet/part-0000.parquet", 2), ("b.parquet/k=1/part-0001", 5), ("b.parquet/part-0002.parquet", 0), ("b.parquet/_SUCCESS", 1), ("c d.parquet/part-0000.parquet", 1), ("e.txt", 4)):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * size)
    want = {("a.parquet", 1, 3), ("b.parquet", 2, 7), ("c d.parquet", 1, 1)}
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert {tuple(r) for r in files.list_tables(spark, folder).collect()} == want
        assert {tuple(r) for r in src_list_files(spark, folder).collect()} == {("a.parquet", True), ("b.parquet", True), ("c d.parquet", True)}


def test_footers_are_counted_without_reading_files_whole(spark, tmp_path):
    spark.range(3000).repartition(1).write.parquet(f"{tmp_path}/t.parquet")
    part = next((tmp_path / "t.parquet").glob("part-*.parquet")).rename(tmp_path / "t.parquet" / "a b+c%20é.parquet")
    spark.range(0).write.parquet(f"{tmp_path}/empty.parquet")
    for name in ("short.parquet", "long.parquet"):
        (tmp_path / name).write_bytes(b"PAR1" + b"x" * (9 if name == "short.parquet" else 9000) + b"PAR1")
    names = [f"{tmp_path}/{x}.parquet" for x in ("t", "empty", "short", "long", "none")] + [str(part)]
    for most in (4000, 1 << 20):  # the file with rows has over 4,000 bytes, an empty one fewer
        found, errors = paths.footers(spark, names, whole_bytes=most)
        assert sorted((r.path.rsplit("/", 1)[-1] == part.name, r.line, r.message) for r in found.collect()) == [(False, 0, "rows"), (True, 3000, "rows")]
        assert sorted((r.path.rsplit("/", 1)[-1], r.rule) for r in errors.collect()) == [("long.parquet", "path.internal-error"), ("none.parquet", "path.missing"), ("short.parquet", "path.internal-error")]


def test_bursts_of_a_stream_need_no_python(spark, tmp_path):
    second = lambda n: datetime(2024, 1, 1) + timedelta(seconds=n)
    rows = [(0, 1, 0, 1), (0, 1, 100, 2), (0, 1, 199, 3), (0, 1, 199, 4), (0, None, 0, 5), (0, 2, 150, 6), (0, 2, 150, 6), (0, 3, 1000, 7)]  # exactly the gap lies between 1 and 2
    rows += [(1, 2, 240, 8), (1, 1, 900, 9), (1, 1, 951, 10), (1, 3, 1099, 11), (1, 3, 1200, 12), (1, 9, 3000, 13)]  # 8 and 9 are not after the watermark (900)
    rows = [(a, k, second(s), t) for a, k, s, t in rows]
    events = spark.createDataFrame(rows, "a int, key int, ts timestamp, tie long")
    plans = []

    def start(stream, n):
        with stateful.state_store(spark):
            q = stateful.append(stateful.debounced(stream, "key", "ts", "tie", gap_seconds=100, late="100 seconds"), str(tmp_path))
            q.awaitTermination()
            plans.append(q._jsq.explainInternal(False))
            return q

    stateful.replay(events, F.col("a"), 2, str(tmp_path), start)
    out = spark.read.schema("key int, at long, tie long").parquet(f"{tmp_path}/out")
    assert sorted((r.key or 0, r.tie) for r in out.collect()) == [(0, 5), (1, 1), (1, 4), (1, 10), (2, 6), (3, 11), (3, 12)]
    assert all("Session" in p and "Python" not in p and "TransformWithState" not in p for p in plans)


def test_baselines_are_written_by_several_tasks_into_one_folder(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/at"
    monkeypatch.setattr("plumbline.queries.sources.shared_folder", lambda *_: at)
    spark.range(3000).select(F.col("id").alias("c_custkey"), F.when(F.col("id") % 2 == 0, -1.0).otherwise(1.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    assert src_baseline(spark, str(tmp_path)).count() == 1500
    names = [p.name for p in (tmp_path / "at").rglob("part-*")]
    assert len(names) == 30 and all((tmp_path / "at" / n).is_file() for n in names) and len({n.split("-")[1] for n in names}) > 1
