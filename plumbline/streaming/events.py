"""Latest versions, debouncing and publishing over event streams, each with its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(df: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """Last write wins: works on batches and, in complete or update mode, on streams."""
    return df.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Bursts with no pause of gap or more inside, by session windows; on a stream, put a watermark on time first."""
    return df.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.max(time).alias("last"))


def debounced(df: DataFrame, key: str, time: str, gap_seconds: int, tie: str) -> DataFrame:
    """The last event of each burst: no other of its key follows within the gap."""
    following = F.lead(time).over(Window.partitionBy(key).orderBy(time, tie))
    pause = F.expr(f"timestampdiff(SECOND, `{time}`, __next)")
    return df.withColumn("__next", following).withColumn("__pause", pause).drop("__next").where(F.col("__pause").isNull() | (F.col("__pause") >= gap_seconds)).drop("__pause")


def publish(stream: DataFrame, rule: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, contract: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch's diagnostics go to sink, with the batch's number, so that a batch that runs again replaces itself.

    contract is read anew for every batch, so a new generation of it holds from the next batch on; rule then gets the batch
    joined with nothing but what it asks for: rule(batch) or, with a contract, rule(batch, contract()).
    """
    def each(batch: DataFrame, number: int) -> None:
        sink(rule(batch, contract()) if contract else rule(batch), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
