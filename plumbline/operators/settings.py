"""Settings of many configurations as rows: what they include is followed in rounds, nearer and later settings win."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import CycleError, kept

LAST = 2**31 - 1


def effective(settings: DataFrame, includes: DataFrame) -> DataFrame:
    """name, key, value, origin (whose setting it is): what holds for each configuration.

    settings: name, key, value; includes: name, base, position. A configuration's own settings override those of what it includes,
    later positions override earlier ones, and so on down. Keys are paths (``rules.flow``): of a setting and another one above it
    (``rules``), the one that overrides the other stays, and of two of one configuration the longer. Rows without a name, key or
    base go; an include without a position comes first; a base without settings gives none; of two values of one key in one
    configuration the greater counts. A configuration that includes itself raises CycleError. One round for each level of includes.
    """
    own = settings.where("name is not null and key is not null").select("name", F.col("key").cast("string"), F.col("value").cast("string"))
    links = includes.where("name is not null and base is not null").select("name", "base", F.coalesce(F.col("position").cast("int"), F.lit(-1)).alias("position"))
    links = kept(links.groupBy("name", "base").agg(F.max("position").alias("position")))
    names = own.select("name").union(links.select("name")).distinct()
    new = kept(names.select("name", F.col("name").alias("source"), F.array().cast("array<int>").alias("order")))
    reach = new
    while True:
        step = new.join(links.select(F.col("name").alias("source"), "base", "position"), "source")
        step = step.select("name", F.col("base").alias("source"), F.concat("order", F.array("position")).alias("order"))
        new = kept(step.groupBy("name", "source").agg(F.max("order").alias("order")))
        if new.isEmpty():
            break
        if loop := new.where("name = source").first():
            raise CycleError(f"{loop['name']} includes itself")
        reach = reach.unionByName(new)
    found = reach.join(own.withColumnRenamed("name", "source"), "source")
    rank = F.struct(F.concat("order", F.array(F.lit(LAST))), "value")
    best = kept(found.groupBy("name", "key").agg(F.max_by(F.struct("value", F.col("source").alias("origin"), "order"), rank).alias("best")))
    best = best.select("name", "key", "best.*").withColumn("order", F.concat("order", F.array(F.lit(LAST))))
    parts = F.split("key", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    below = best.where(F.size(parts) > 1).select("name", F.explode(above).alias("key"), F.col("key").alias("long"), F.col("order").alias("other"))
    met = below.join(best.select("name", "key", "order"), ["name", "key"])
    lost = met.select("name", F.when(F.col("order") > F.col("other"), F.col("long")).otherwise(F.col("key")).alias("key")).distinct()
    return best.join(lost, ["name", "key"], "left_anti").select("name", "key", "value", "origin")


def without_base(settings: DataFrame, includes: DataFrame) -> DataFrame:
    """path, rule, message of includes whose base has neither settings nor includes."""
    there = settings.select("name").union(includes.select("name")).where("name is not null").distinct().withColumnRenamed("name", "base")
    lost = includes.where("base is not null").join(there, "base", "left_anti")
    return lost.select(F.col("name").alias("path"), F.lit("config.missing-include").alias("rule"), F.col("base").alias("message"))
