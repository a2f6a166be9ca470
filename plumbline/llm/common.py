"""What the corpus operators share: tables, stored intermediate results, tokenizer files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class for the JVM's, DuckDB's and Python's expressions.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.plumbline-checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Stash:
    """Results written as Parquet to the shared folder, so that neither lost executors nor long lineages matter.

    put() writes a DataFrame and returns the written one; drop() removes what is no longer needed, clear() all of it. What is left
    goes when the driver ends. Stash.made lists the stashes in order, so that a caller who has stored an operator's result can
    clear those that the operator made (see cleared()).
    """

    made: list["Stash"] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0
        path, files = self._at(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        Stash.made.append(self)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *numbers: int) -> None:
        for n in numbers:
            path, files = self._at(f"{self.root}/{n}")
            files.delete(path, True)

    def clear(self) -> None:
        path, files = self._at(self.root)
        files.delete(path, True)

    @staticmethod
    def cleared(since: int) -> None:
        """Clears all stashes made from number since on."""
        while len(Stash.made) > since:
            Stash.made.pop().clear()


def join_hot(rows: DataFrame, by: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of by, by the key that both have; by: a row for each key, and size, the number of its rows.

    Keys of more than 1 / 65,536 of all rows (total) are fewer than 65,536: their rows of by are broadcast, and rows with these
    keys are not shuffled. All others are joined by a shuffle, where no key has more rows than that (1,000 in small tables).
    """
    most = max(1000, total >> 16)
    hot = F.broadcast(by.where(F.col(size) > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(by.where(F.col(size) <= most), key)
    return rows.join(hot, key).unionByName(rest)


def with_least(rows: DataFrame, key: str, value: str | Column, name: str, total: int) -> DataFrame:
    """rows with the least value of all rows of their key as name; hot keys are neither shuffled whole nor joined in one task."""
    least = rows.groupBy(key).agg(F.min(value).alias(name), F.count("*").alias("rows_of_key"))
    return join_hot(rows, least, key, "rows_of_key", total).drop("rows_of_key")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary lies (a file of the installed package; never part of this repository)."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
