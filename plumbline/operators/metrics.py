"""What is measured while a job runs: figures of rows that pass, without a scan of their own."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """df, and an observation of aggregates over it, whose get is there once an action on df has run."""
    seen = Observation(f"figures-{uuid.uuid4().hex}")
    return df.observe(seen, *[c.alias(k) for k, c in figures.items()]), seen


def stored(df: DataFrame, path: str, **figures: Column) -> tuple[DataFrame, dict]:
    """df as written to path (Parquet; a shared folder), and figures, rows and seconds of that one job."""
    out, seen = measured(df, rows=F.count(F.lit(1)), **figures)
    begin = time.monotonic()
    out.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), {**seen.get, "seconds": time.monotonic() - begin}


def fallbacks(scanned: DataFrame) -> DataFrame:
    """An info diagnostic for each column of scan.type_scan() of which some values aren't recognised."""
    none = F.lit(None).cast("string")
    message = F.format_string("%d of %d values of %s (%s) are not recognised", "unrecognised", "visited", "col", "cls")
    rows = scanned.where("unrecognised > 0")
    return rows.select(F.col("tbl").alias("path"), none.alias("line"), F.col("col").alias("column"), F.lit("info").alias("severity"), F.lit("fallback").alias("rule"), F.lit("builtin").alias("source_family"), message.alias("message"))
