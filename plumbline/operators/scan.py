"""How much of some tables is recognised: values whose class is known and which one of the domains asked for proves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import class_of
from .refine import compile_payload

KNOWN = ("Integer", "Float", "String", "bool", "Date", "Time", "Array", "Struct", "Map")


def _recognised(c: Column, cls: str, domains: Mapping[str, Sequence[str]]) -> Column:
    if cls not in domains:
        return F.lit(cls in KNOWN)
    out: Column = F.lit(False)
    for payload in domains[cls]:
        test = compile_payload(payload)
        if test is None:
            raise ValueError(f"{payload} is no known refinement")
        out = out | F.coalesce(test(c), F.lit(False))
    return out


def type_scan(tables: Mapping[str, DataFrame], domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """tbl, col, cls, visited, unrecognised of every column of all tables; a scan of each table, one row of sums a task.

    visited: values that aren't null. domains: for a class the payloads one of which has to be proven; values of other classes are
    recognised if the class is. Columns of an empty table are visited 0 times; a table without columns has no rows.
    """
    parts = []
    for name, df in tables.items():
        aggs, rows = [], []
        for k, f in enumerate(df.schema.fields):
            c, cls = F.col("`" + f.name.replace("`", "``") + "`"), class_of(f.dataType.simpleString())
            aggs += [F.count(c).alias(f"v{k}"), F.count_if(c.isNotNull() & ~_recognised(c, cls, domains)).alias(f"u{k}")]
            rows.append(F.struct(F.lit(name).alias("tbl"), F.lit(f.name).alias("col"), F.lit(cls).alias("cls"), F.col(f"v{k}").alias("visited"), F.col(f"u{k}").alias("unrecognised")))
        if rows:
            parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def by_class(scanned: DataFrame, show_recognised: bool = False) -> DataFrame:
    """cls, visited, unrecognised, ratio; classes wholly recognised only if asked for."""
    out = scanned.groupBy("cls").agg(F.sum("visited").alias("visited"), F.sum("unrecognised").alias("unrecognised"))
    out = out if show_recognised else out.where("unrecognised > 0")
    return out.withColumn("ratio", F.when(F.col("visited") > 0, F.round(F.col("unrecognised") / F.col("visited"), 6)).otherwise(F.lit(0.0)))


def exit_status(scanned: DataFrame, threshold: float | None = None, errors: DataFrame | None = None) -> int:
    """1 if there is an error (rows of errors: what could not be read) or more than threshold of all values is unrecognised, else 0. Runs jobs."""
    if errors is not None and not errors.isEmpty():
        return 1
    if threshold is None:
        return 0
    r = scanned.agg(F.sum("visited").alias("v"), F.sum("unrecognised").alias("u")).first()
    return int(bool(r["v"]) and r["u"] / r["v"] > threshold)
