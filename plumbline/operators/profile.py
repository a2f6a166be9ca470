"""Profiles: one row per column with what its values can be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .refine import STRINGS

#: Fixed value: more literals than this widen to an interval, or to no literals.
MOST_LITERALS = 8
PROVABLE = ("non-empty-string", "lowercase-string", "uppercase-string", "numeric-string", "decimal-int-string")
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def class_of(kind: str) -> str:
    if kind in _INTEGERS:
        return "Integer"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "Float"
    return {"string": "String", "boolean": "bool", "date": "Date"}.get(kind, "Time" if kind.startswith("timestamp") else kind.split("<")[0].capitalize())


#: At this estimate or below, a column's distinct values are counted exactly.
_FEW = 32


def profile(df: DataFrame, name: str) -> DataFrame:
    """tbl, col, cls, n, n_null, lo, hi (integers), n_distinct and literals (where at most 8, sorted), refinements proven of all strings.

    One pass gives counts, bounds, proofs and estimates of distinct values, as one row. Only columns that may have few values
    take part in a second pass, whose distinct values are combined on each task before they are shuffled.
    """
    kinds = dict(df.dtypes)
    aggs: list[Column] = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        aggs += [F.count_if(col.isNull()).alias(f"{i}_null"), F.approx_count_distinct(col).alias(f"{i}_about")]
        if kinds[c] in _INTEGERS:
            aggs += [F.min(col).cast("long").alias(f"{i}_lo"), F.max(col).cast("long").alias(f"{i}_hi")]
        if kinds[c] == "string":
            aggs += [F.bool_and(STRINGS[p](col)).alias(f"{i}_{p}") for p in PROVABLE]
    r = df.agg(*aggs).first().asDict()
    rows = []
    for i, c in enumerate(df.columns):
        proven = ",".join(sorted(p for p in PROVABLE if r.get(f"{i}_{p}")))
        rows.append((name, c, class_of(kinds[c]), r["n"], r[f"{i}_null"], r.get(f"{i}_lo"), r.get(f"{i}_hi"), proven))
    out = df.sparkSession.createDataFrame(rows, "tbl string, col string, cls string, n long, n_null long, lo long, hi long, refinements string")
    few = [c for i, c in enumerate(df.columns) if (kinds[c] == "string" or kinds[c] in _INTEGERS) and r[f"{i}_about"] <= _FEW]
    if not few:
        return out.withColumns({"n_distinct": F.lit(None).cast("long"), "literals": F.lit(None).cast("string")})
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in few])).alias("p")).select("p.*").where("v is not null").distinct()
    texts = values.groupBy("k").agg(F.count("*").alias("n_distinct"), F.array_join(F.array_sort(F.collect_list("v")), "|").alias("literals")).where(F.col("n_distinct") <= MOST_LITERALS)
    return out.join(F.broadcast(texts), out["col"] == texts["k"], "left").drop("k")


def coverage(df: DataFrame, by: str, unrecognised: Column) -> DataFrame:
    """node_class, visited, unrecognised, ratio of the unrecognised (0 where nothing was visited)."""
    out = df.groupBy(F.col(by).alias("node_class")).agg(F.count("*").alias("visited"), F.count_if(F.coalesce(unrecognised, F.lit(True))).alias("unrecognised"))
    return out.withColumn("ratio", F.when(F.col("visited") == 0, 0.0).otherwise(F.round(F.col("unrecognised") / F.col("visited"), 6)))


def repeated(df: DataFrame, key: str, text: str) -> DataFrame:
    """text, n, first_id of each text that more than one row has; key gives the first. Null texts and null keys are values like others.

    Rows are grouped by digest; of the texts only those of first rows are read again.
    """
    rows = df.select(F.col(key).alias("first_id"), F.col(text).alias("text"), F.sha2(text, 256).alias("digest"))
    again = rows.groupBy(F.col("digest").alias("__d")).agg(F.count("*").alias("n"), F.min("first_id").alias("__k")).where("n > 1")
    found = rows.join(again, F.col("first_id").eqNullSafe(F.col("__k")) & F.col("digest").eqNullSafe(F.col("__d")))
    return found.groupBy("digest").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("first_id").alias("first_id")).drop("digest")
