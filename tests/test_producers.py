"""Stored results of producers, and work on paths that a user gives."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.sources import paths as A
from plumbline.sources import producers as P


def put(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(f"{folder}/{name}.txt", "w") as f:
            f.write(text)


def test_results_are_made_once_for_the_same_inputs(spark, tmp_path):
    src, cache, made = f"{tmp_path}/in", P.Cache(spark, f"{tmp_path}/store"), []
    put(src, a="1", b="2")

    def compute():
        made.append(1)
        return spark.read.text(src).agg(F.count("*").alias("n"))

    def fetch(comparator="digest", **params):
        return cache.fetch("count", P.described(spark, src, comparator, "*.txt"), compute, params).first()["n"]

    assert [fetch(), fetch(), len(made)] == [2, 2, 1]
    os.utime(f"{src}/a.txt", (1, 1))
    assert fetch() == 2 and len(made) == 1  # a digest doesn't see the time
    assert fetch("mtime") == 2 and len(made) == 2
    os.utime(f"{src}/a.txt", (2, 2))
    assert fetch("mtime") == 2 and len(made) == 3
    assert fetch("exists") == 2 and len(made) == 4
    put(src, a="1\n1")
    assert fetch("exists") == 2 and len(made) == 4
    assert fetch() == 3 and len(made) == 5
    put(src, c="x")
    assert fetch("exists") == 4 and len(made) == 6
    assert fetch(x=1) == 4 and fetch(x=2) == 4 and fetch(x=1) == 4 and len(made) == 8
    assert [tuple(r) for r in cache.stats().collect()] == [("count", 4, 8, 8)]
    assert [(r.producer, r.entries) for r in cache.inventory().collect()] == [("count", 8)]
    again = P.Cache(spark, f"{tmp_path}/store")  # another session's
    assert again.fetch("count", P.described(spark, src, name_filter="*.txt"), compute).first()["n"] == 4
    assert [tuple(r) for r in again.stats().collect()] == [("count", 0, 1, 1)]


def test_nothing_is_left_of_a_result_that_fails(spark, tmp_path):
    cache, inputs = P.Cache(spark, f"{tmp_path}/store"), spark.createDataFrame([("p", "digest", "v")], "path string, comparator string, value string")
    with pytest.raises(Exception):
        cache.fetch("bad", inputs, lambda: spark.range(5).select(F.raise_error(F.lit("no"))))
    assert not [f for _, _, names in os.walk(f"{tmp_path}/store") for f in names if f.endswith(".parquet")]
    assert cache.inventory().collect() == [] and cache.stats().first()["writes"] == 0
    with pytest.raises(ValueError):
        cache.fetch("../out", inputs, lambda: spark.range(1))


def test_the_first_of_two_results_stays(spark, tmp_path):
    """Another session publishes the same result while this one computes."""
    cache, other = P.Cache(spark, f"{tmp_path}/store"), P.Cache(spark, f"{tmp_path}/store")
    inputs = spark.createDataFrame([("p", "digest", "v")], "path string, comparator string, value string")

    def late():
        other.fetch("x", inputs, lambda: spark.range(3))
        return spark.range(7)

    assert cache.fetch("x", inputs, late).count() == 3
    assert cache.stats().first()["writes"] == 0 and other.stats().first()["writes"] == 1
    assert cache.inventory().first()["entries"] == 1 and os.listdir(f"{tmp_path}/store") == ["x"]


def test_entries_are_composed(spark):
    rows = [("a", "exists", "1"), ("a", "digest", "d"), ("a", "mtime", "t"), ("b", "mtime", "t"), ("b", "mtime", "u"), ("b", "exists", "1"), ("c", "digest", "x"), ("c", "digest", "x"), ("d", "exists", "1")]
    e = spark.createDataFrame(rows, "path string, comparator string, value string")
    got = {r.path: (r.comparator, r.value, r.conflict) for r in P.composed(e.limit(4), e).collect()}
    assert got == {"a": ("digest", "d", False), "b": ("mtime", "t", True), "c": ("digest", "x", False), "d": ("exists", "1", False)}
    with pytest.raises(ValueError):
        P.fingerprint(e)
    ok = e.where("path <> 'b'")
    assert P.fingerprint(ok, k=1) == P.fingerprint(ok.repartition(5).orderBy("value"), k=1) != P.fingerprint(ok, k=2)
    assert P.fingerprint(ok) != P.fingerprint(ok.where("path <> 'd'")) and P.fingerprint(e.limit(0))


def test_paths(spark, tmp_path):
    put(f"{tmp_path}/x", one="1", two="22")
    put(f"{tmp_path}/x/deep er/more", three="333")
    put(f"{tmp_path}/x/skip", four="4444")
    open(f"{tmp_path}/x/other.bin", "w").close()
    x = f"{tmp_path}/x"
    files, errors = A.expand(spark, [x, f"{x}/one.txt", f"{x}/skip/four.txt", f"{x}/none.txt", f"{x}/other.bin", x, f"{x}/deep er"], ".txt", ["skip/**"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()) == ["four.txt", "one.txt", "three.txt", "two.txt"]
    assert {(r.path.rsplit("/", 1)[1], r.rule) for r in errors.collect()} == {("none.txt", "path.missing"), ("other.bin", "path.other-kind")}
    none, errors = A.expand(spark, [f"{x}/none.txt"], ".txt")
    assert none.count() == 0 and errors.count() == 1 and A.expand(spark, [], ".txt")[1].count() == 0


def test_every_failure_is_a_row(spark, tmp_path):
    put(f"{tmp_path}/x", good="1\n2", bad="no", large="5" * 100)

    def run(path, content):
        if content == b"no":
            raise KeyError("secret")
        yield from ((k, line.decode()) for k, line in enumerate(content.split(b"\n"), 1))

    found, errors = A.analyse(spark, [f"{tmp_path}/x", f"{tmp_path}/none"], ".txt", run, most_bytes=99)
    name = lambda p: p.rsplit("/", 1)[1]
    assert {(name(r.path), r.line, r.message) for r in found.collect()} == {("good.txt", 1, "1"), ("good.txt", 2, "2")}
    assert {(name(r.path), r.rule, r.message) for r in errors.collect()} == {("none", "path.missing", "no such file or folder"), ("large.txt", "path.too-large", "100 bytes"), ("bad.txt", "path.internal-error", "KeyError")}
