"""Positions in a global order, without a task that sees all rows: ranges, their counts, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept


def positioned(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """df with name: 0, 1, ... in the order given. Rows equal in order get neighbouring positions in no fixed order.

    A row for each range reaches the driver; rows of one value of order share a range, so ties should be few: add columns that tell
    rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id().cast("long"), "__row": F.monotonically_increasing_id()})
    ranged = kept(ranged)
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    at = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    out = ranged.join(F.broadcast(at), F.col("__part") == F.col("__p"))  # as many rows as there are ranges
    return out.withColumn(name, F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__row", "__p", "__before")


def positioned_within(df: DataFrame, keys: list[str], *order: Column | str, name: str = "position") -> DataFrame:
    """df with name: 0, 1, ... within each combination of keys, in the order given; nulls are a key like others.

    A key of any size is many ranges: what a range holds of a key is numbered there, and what the ranges before it hold of the key is
    added. Only (range, key) pairs are grouped and joined. As in positioned(), order should tell rows apart.
    """
    ranged = kept(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    each = ranged.groupBy("__part", *keys).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the key
    each = each.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    each = each.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__first", "__before")
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = ranged.join(each, same).withColumn(name, F.col("__row") - F.col("__first") + F.col("__before"))
    return out.select(*df.columns, name)


def in_file_order(df: DataFrame, name: str = "position") -> DataFrame:
    """df, as read from files, with name: its rows' positions in the files, the files in order of their paths. Whatever follows can be sorted by it."""
    at = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__index"))
    return positioned(at, "__path", "__index", name=name).drop("__path", "__index")
