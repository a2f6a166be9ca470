"""Shapes of nested records: which members objects have at every path, how often and of which class, held against a contract.

A shape is a frame of counts (by, path, cls, n), so shapes of parts of a table add up to that of the whole. Paths begin with ``$``; members
are ``.name``, elements of arrays ``[]``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept


def _class(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "Hash").when(kind.startswith("ARRAY"), "Array").when(kind == "BIGINT", "Integer").when(kind == "STRING", "String")
        .when(kind == "BOOLEAN", "Boolean").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "Float").otherwise("NilClass")
    )


def shape_of(df: DataFrame, column: str, by: str) -> DataFrame:
    """by, path, cls, n: how many values of each class there are at each path of the JSON texts in column, for each value of by.

    Texts that are null or no JSON have no shape. Runs a round for each level of nesting, until no value is an object or array; values are
    counted before anything is shuffled. Names of members are taken as they are.
    """
    level = df.select(F.col(by).alias("by"), F.lit("$").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    counts = None
    while True:
        level = kept(level.withColumn("cls", _class(F.col("v"))))
        here = level.groupBy("by", "path", "cls").agg(F.count("*").alias("n"))
        counts = here if counts is None else counts.unionByName(here)
        inner = level.where(F.col("cls").isin("Hash", "Array"))
        if inner.isEmpty():
            return counts
        step = F.when(F.col("cls") == "Hash", F.concat(F.lit("."), F.col("__e.key"))).otherwise("[]")
        inside = inner.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("__e"))
        level = inside.select("by", F.concat("path", step).alias("path"), F.col("__e.value").alias("v"))


def merged(*shapes: DataFrame) -> DataFrame:
    """The shape of all rows, from those of parts."""
    every = shapes[0]
    for s in shapes[1:]:
        every = every.unionByName(s)
    return every.groupBy("by", "path", "cls").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Record:
    """A contract of records: for each path its classes; optional paths may be missing from their object; open objects (by path) may have other members."""

    members: Mapping[str, Iterable[str]]
    optional: frozenset[str] = field(default_factory=frozenset)
    open: frozenset[str] = field(default_factory=frozenset)


FINDINGS = ("class", "extra", "missing")


def findings(shape: DataFrame, contract: Record) -> DataFrame:
    """by, path, finding, n: values of a class the contract does not name, members of closed objects that it does not have (with what is inside
    them only the member itself counts), and objects without a required member. Elements of an array that the contract does not name may be
    anything. A shape without rows here accepts the contract.
    """
    spark = shape.sparkSession
    declared = [(p, sorted(c), p in contract.optional) for p, c in contract.members.items()]
    known = spark.createDataFrame(declared, "p string, classes array<string>, optional boolean")
    total = shape.groupBy("by", "path").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("cls") == "Hash", F.col("n"))).alias("objects"))
    above = F.regexp_extract("path", r"^(.*)(?:\.[^.\[]*|\[\])$", 1)
    found = shape.join(F.broadcast(known), F.col("path") == F.col("p"), "left")  # as long as the contract
    wrong = found.where(F.col("p").isNotNull() & ~F.array_contains("classes", F.col("cls"))).select("by", "path", F.lit("class").alias("finding"), "n")
    closed = sorted(set(contract.members) - contract.open)
    extra = found.where(F.col("p").isNull() & ~F.col("path").endswith("[]") & above.isin(closed)).groupBy("by", "path").agg(F.sum("n").alias("n")).select("by", "path", F.lit("extra").alias("finding"), "n")
    asked = known.where("not optional").select(F.col("p").alias("path")).where("path like '%.%' and path not like '%[]'").select(F.col("path").alias("m"), above.alias("o"))
    objects = total.where("objects > 0").select("by", F.col("path").alias("at"), "objects").join(F.broadcast(asked), F.col("at") == F.col("o"))
    seen = total.select(F.col("by").alias("b"), F.col("path").alias("s"), F.col("n").alias("there"))
    missing = objects.join(seen, F.col("by").eqNullSafe(F.col("b")) & (F.col("m") == F.col("s")), "left").withColumn("lack", F.col("objects") - F.coalesce("there", F.lit(0)))
    missing = missing.where("lack > 0").select("by", F.col("m").alias("path"), F.lit("missing").alias("finding"), F.col("lack").alias("n"))
    return wrong.unionByName(extra).unionByName(missing).groupBy("by", "path", "finding").agg(F.sum("n").alias("n"))
