"""The function catalogue: what the engine's registry offers, with how pure each function is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions whose result is not determined by their arguments, and those that look at the session.
IMPURE = ("rand", "random", "randn", "randstr", "uniform", "shuffle", "uuid", "monotonically_increasing_id", "spark_partition_id", "input_file_name", "input_file_block_start", "input_file_block_length")
SESSION = ("now", "current_timestamp", "current_date", "curdate", "current_time", "localtimestamp", "current_timezone", "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "version", "unix_timestamp")


def catalogue(spark: SparkSession) -> DataFrame:
    """name, purity ("leaf", "session" or "impure"); foldable are leaves alone."""
    names = spark.sql("SHOW SYSTEM FUNCTIONS").select(F.col("function").alias("name"))
    c = F.col("name")
    return names.select("name", F.when(c.isin(*IMPURE), "impure").when(c.isin(*SESSION), "session").otherwise("leaf").alias("purity"))


def permitted(calls: DataFrame, spark: SparkSession, blocked: tuple[str, ...] = ()) -> DataFrame:
    """calls (name, ...) with foldable: a known leaf that isn't blocked; names that change their receiver (``!``) never are."""
    known = F.broadcast(catalogue(spark))  # some hundred rows
    fold = F.coalesce((F.col("purity") == "leaf") & ~F.col("name").isin(*(blocked or ("",))) & ~F.col("name").endswith("!"), F.lit(False))
    return calls.join(known, "name", "left").withColumn("foldable", fold).drop("purity")
