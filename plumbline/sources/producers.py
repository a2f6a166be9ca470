"""Results of producers, stored under a fingerprint of what they were made from and published by a rename."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How strictly files are compared, the least strict first.
COMPARATORS = ("exists", "mtime", "digest")


def described(spark: SparkSession, path: str, comparator: str = "digest", name_filter: str = "*") -> DataFrame:
    """path, comparator, value of each file below path, found by Spark's reader; only a digest reads contents (2 GB a file at most)."""
    if comparator not in COMPARATORS:
        raise ValueError(f"{comparator} is none of {', '.join(COMPARATORS)}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_filter).load(path)
    value = {"digest": F.sha2("content", 256), "mtime": F.concat_ws("/", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")), "exists": F.lit("1")}[comparator]
    return files.select("path", F.lit(comparator).alias("comparator"), value.alias("value"))


def composed(*entries: DataFrame) -> DataFrame:
    """path, comparator, value, conflict: of each path the strictest comparator that any entry asks for; conflict: its values disagree (value is the least then)."""
    rank = F.array_position(F.array(*map(F.lit, COMPARATORS)), F.col("comparator"))
    rows = reduce(DataFrame.unionByName, entries).withColumn("__rank", rank)
    each = rows.groupBy("path", "__rank", "comparator").agg(F.min("value").alias("value"), F.max("value").alias("last"))
    return each.groupBy("path").agg(F.max_by(F.struct("comparator", "value", "last"), "__rank").alias("x")).select("path", "x.comparator", "x.value", (F.col("x.value") != F.col("x.last")).alias("conflict"))


def fingerprint(entries: DataFrame, **what: object) -> str:
    """Of what and all entries in whatever order: sums of their digests, so one row reaches the driver. Entries in conflict raise ValueError."""
    e = composed(entries)
    digest = F.sha2(F.to_json(F.struct("path", "comparator", "value")), 256)
    parts = [F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{k}") for k in (1, 16, 31, 46)]
    r = e.agg(F.count("*").alias("n"), F.min(F.when(F.col("conflict"), F.col("path"))).alias("bad"), *parts).first()
    if r["bad"] is not None:
        raise ValueError(f"descriptions of {r['bad']} disagree")
    return hashlib.sha256(json.dumps([what, r.asDict()], sort_keys=True, default=str).encode()).hexdigest()


class Cache:
    """Results below root (a shared folder), root/producer/fingerprint; a result is there whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.counts: dict[str, dict[str, int]] = {}
        path, files = self._at(self.root)
        files.mkdirs(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._at(name)
        return files.exists(path)

    def _drop(self, name: str) -> None:
        path, files = self._at(name)
        files.delete(path, True)

    def fetch(self, producer: str, inputs: DataFrame, compute: Callable[[], DataFrame], params: Mapping[str, object] | None = None) -> DataFrame:
        """What compute gives, computed only if nothing is stored for this producer, params and inputs (rows of described()).

        A result that fails leaves nothing behind. Of two that are published at once, the first one stays.
        """
        if not producer or set(producer) & set("/."):
            raise ValueError(f"{producer!r} is no name of a producer")
        at = f"{self.root}/{producer}/{fingerprint(inputs, producer=producer, params=dict(params or {}))}"
        counts = self.counts.setdefault(producer, {"hits": 0, "misses": 0, "writes": 0})
        if self._exists(at):
            counts["hits"] += 1
            return self.spark.read.parquet(at)
        counts["misses"] += 1
        name = f".new-{uuid.uuid4().hex}"
        new = f"{self.root}/{name}"
        try:
            compute().write.parquet(new)
            counts["writes"] += self._publish(new, at, name)
        finally:
            self._drop(new)
        return self.spark.read.parquet(at)

    def _publish(self, new: str, at: str, name: str) -> bool:
        source, files = self._at(new)
        target, _ = self._at(at)
        files.mkdirs(target.getParent())
        if not files.exists(target) and files.rename(source, target) and not self._exists(f"{at}/{name}"):
            return True
        self._drop(f"{at}/{name}")  # another result came between: a rename has put this one inside it
        if not files.exists(target):
            raise OSError(f"{at} can't be published")
        return False

    def stats(self) -> DataFrame:
        """producer, hits, misses, writes of this cache since it was opened; a row for each producer."""
        rows = [(p, c["hits"], c["misses"], c["writes"]) for p, c in self.counts.items()]
        return self.spark.createDataFrame(rows, "producer string, hits long, misses long, writes long")

    def inventory(self) -> DataFrame:
        """producer, entries, files, bytes of what is stored, by listing alone."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.root)
        place = F.regexp_extract("path", r"/([^/]+)/([0-9a-f]{64})/[^/]+$", 1), F.regexp_extract("path", r"/([^/]+)/([0-9a-f]{64})/[^/]+$", 2)
        rows = files.select(place[0].alias("producer"), place[1].alias("entry"), "length").where("entry <> ''")
        each = rows.groupBy("producer", "entry").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
        return each.groupBy("producer").agg(F.count("*").alias("entries"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
