"""Hierarchies: closure, nearest ancestor, class order, and dependency order."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder


class CycleError(ValueError):
    pass


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that driver and executors share; a lost executor costs none of it."""
    at = shared_folder(df.sparkSession, "round")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def closure(edges: DataFrame) -> DataFrame:
    """child, ancestor, depth of all ancestors (depth 0: itself; several paths: the shortest); edges: child, parent (null: none).

    Rounds, each one level up from what the round before found new, until nothing is new; runs a job for each level. A class that is
    its own ancestor raises CycleError.
    """
    start = edges.select(F.explode(F.array("child", "parent")).alias("child")).where("child is not null").distinct()
    edges = kept(edges.where("child is not null and parent is not null").select("child", "parent").distinct())
    found = start.select("child", F.col("child").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    new, depth = kept(edges.select("child", F.col("parent").alias("ancestor"))), 1
    while not new.isEmpty():
        if loop := new.where("child = ancestor").first():
            raise CycleError(f"{loop['child']} is its own ancestor")
        found = found.unionByName(new.select("child", "ancestor", F.lit(depth).cast("long").alias("depth")))
        up = new.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        new, depth = kept(up.join(found.where("depth > 0"), ["child", "ancestor"], "left_anti")), depth + 1
    return found


def nearest(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    """child, member, owner: the nearest ancestor that owns member, of equally near ones the first by name; owned: owner, member."""
    found = pairs.join(owned, pairs["ancestor"] == owned["owner"])
    return found.groupBy("child", "member").agg(F.min_by("owner", F.struct("depth", "owner")).alias("owner"))


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """name, level: 0 for those that need nothing, else one more than the highest of what they need; so producers come before consumers.

    nodes: name; needs: consumer, producer. Nulls and repeated rows count for nothing, needs of names that aren't there neither. A
    producer that isn't there is a ValueError, needs in a circle a CycleError. One round for each level; edges met are left behind.
    """
    names = kept(nodes.select("name").where("name is not null").distinct())
    edges = needs.where("consumer is not null and producer is not null").select("consumer", "producer").distinct()
    waiting = kept(edges.join(names.withColumnRenamed("name", "consumer"), "consumer", "left_semi"))
    if lost := waiting.join(names.withColumnRenamed("name", "producer"), "producer", "left_anti").first():
        raise ValueError(f"{lost['consumer']} needs {lost['producer']}, which is not there")
    ready, level = kept(names.join(waiting.select(F.col("consumer").alias("name")).distinct(), "name", "left_anti")), 0
    found = ready.withColumn("level", F.lit(level))
    while not waiting.isEmpty():
        rest = kept(waiting.join(ready.withColumnRenamed("name", "producer"), "producer", "left_anti"))
        free = waiting.select("consumer").distinct().join(rest.select("consumer").distinct(), "consumer", "left_anti")
        ready, level, waiting = kept(free.withColumnRenamed("consumer", "name")), level + 1, rest
        if ready.isEmpty():
            raise CycleError(f"{waiting.first()['consumer']} needs itself or one that does")
        found = found.unionByName(ready.withColumn("level", F.lit(level)))
    return found


def topological(order: list[str], needs: dict[str, list[str]]) -> list[str]:
    """Plugins so that producers come before consumers; ties in configured order. A missing producer or a cycle is an error."""
    for k, v in needs.items():
        for x in v:
            if x not in order:
                raise ValueError(f"{k} needs {x}, which is not there")
    left = {k: len(needs.get(k, [])) for k in order}
    ready, out = deque(k for k in order if not left[k]), []
    while ready:
        k = ready.popleft()
        out.append(k)
        for x in order:
            if k in needs.get(x, []):
                left[x] -= 1
                if not left[x]:
                    ready.append(x)
    if len(out) < len(order):
        raise CycleError(", ".join(k for k in order if k not in out))
    return out
