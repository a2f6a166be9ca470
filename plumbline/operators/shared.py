"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets one below its warehouse; any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.plumbline-checkpoints"
    return f"{base}/{what}-{uuid.uuid4().hex}"
