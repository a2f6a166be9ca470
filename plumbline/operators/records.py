"""Policies of a table's fields, kept in their metadata: fields that are only read, and rows that change them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READONLY = "readonly"


def readonly(df: DataFrame, *columns: str) -> DataFrame:
    """df with these fields (none named: all) marked; values are as before, unknown names change nothing."""
    def marked(c):
        return F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, READONLY: True})

    return df.select(*[marked(c) if not columns or c in columns else F.col(f"`{c}`") for c in df.columns])


def overwritten(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, field, was, now (as text) where after has another value in a field that before marks; nulls are equal.

    Rows are matched by key; those without a key or without a counterpart change nothing, nor do fields that after lacks. A key
    that repeats is compared with each counterpart.
    """
    fields = [f.name for f in before.schema.fields if f.metadata.get(READONLY) and f.name != key and f.name in after.columns]
    none = F.array().cast("array<struct<field:string,was:string,now:string>>")
    old = before.select(F.col(f"`{key}`").alias("__key"), F.struct(*[F.col(f"`{c}`") for c in fields] or [F.lit(0)]).alias("__was"))
    new = after.select(F.col(f"`{key}`").alias("__key"), F.struct(*[F.col(f"`{c}`") for c in fields] or [F.lit(0)]).alias("__now"))
    differ = [
        F.when(~F.col("__was")[c].eqNullSafe(F.col("__now")[c]), F.struct(F.lit(c).alias("field"), F.col("__was")[c].cast("string").alias("was"), F.col("__now")[c].cast("string").alias("now")))
        for c in fields
    ]
    changes = F.filter(F.array(*differ), lambda x: x.isNotNull()) if fields else none
    return old.join(new, "__key").select(F.col("__key").alias(key), F.inline(changes))
