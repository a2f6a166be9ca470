"""Relational division: which names do all classes of a receiver answer to, which only some, and which fail on nil."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NIL = "NilClass"

#: Tasks that the rows of one set of classes are dealt to when names are given back to its receivers.
_DEALT = 32


def _sets(members: DataFrame) -> DataFrame:
    """receiver, cls, once each, with __set: equal for receivers with the same classes (their number, and sums of their SHA-256 digests)."""
    digest = F.sha2(F.to_json(F.struct("cls")), 256)
    each = Window.partitionBy("receiver")
    sums = [F.sum(F.conv(F.substring(digest, k, 15), 16, 10).cast("decimal(20,0)")).over(each).cast("string") for k in (1, 16, 31, 46)]
    return members.select("receiver", "cls").distinct().withColumn("__set", F.concat_ws("/", F.count("*").over(each).cast("string"), *sums))


def divided(members: DataFrame, registry: DataFrame) -> DataFrame:
    """receiver, name, matched, members, on_every of each name that a class of the receiver (members: receiver, cls) has (registry: cls, name).

    A null receiver and a null class are values like others; a class without names counts as a member. A row says "on any"; on_every
    that all members have the name. Repeated rows count once. Names are counted once for each set of classes, not for each receiver
    that has it; receivers then take their set's names, without a further shuffle of the rows.
    """
    return _given(*_divided(members, registry))


def _divided(members: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receiver, __set) and (__set, name, matched, members, on_every)."""
    rows = _sets(members)
    has = registry.select(F.col("cls").alias("__c"), "name").distinct()
    found = rows.select("__set", "cls").distinct().join(has, F.col("cls").eqNullSafe(F.col("__c"))).groupBy("__set", "name").agg(F.count("*").alias("matched"))
    size = F.substring_index("__set", "/", 1).cast("long")
    found = found.withColumn("members", size).withColumn("on_every", F.col("matched") == size)
    return rows.select("receiver", "__set").distinct(), found


def _given(receivers: DataFrame, found: DataFrame) -> DataFrame:
    """Each receiver with its set's rows. The receivers of one set are dealt to several tasks, as most may have the same one."""
    deal = F.pmod(F.xxhash64("receiver"), F.lit(_DEALT)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1)))
    return receivers.withColumn("__deal", deal).join(found.withColumn("__deal", every), ["__set", "__deal"]).select("receiver", "name", "matched", "members", "on_every")


def nil_receivers(members: DataFrame, registry: DataFrame) -> DataFrame:
    """receiver, name: calls that go wrong only for nil. The receiver may be nil (a null class, or NilClass), every other class of it has
    the name, nil has it not. A receiver that is only nil is no such case. What nil has is set aside before anything is counted."""
    members = members.select("receiver", F.coalesce("cls", F.lit(NIL)).alias("cls"))
    registry = registry.select(F.coalesce("cls", F.lit(NIL)).alias("cls"), "name").distinct()
    nil = members.where(F.col("cls") == NIL).select(F.col("receiver").alias("__r")).distinct()
    may = members.where(F.col("cls") != NIL).join(nil, F.col("receiver").eqNullSafe(F.col("__r")), "left_semi")
    on_nil = registry.where(F.col("cls") == NIL).select(F.col("name").alias("__n"))
    others = registry.where(F.col("cls") != NIL).join(on_nil, F.col("name").eqNullSafe(F.col("__n")), "left_anti")
    receivers, found = _divided(may, others)
    return _given(receivers, found.where("on_every")).select("receiver", "name")
