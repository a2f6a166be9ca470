"""Streams that keep state: debouncing by session windows, windows with late rows, contracts in generations; and how a table is replayed as a stream.

State is kept per key in the state store below the query's checkpoint, so it survives lost executors and restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state on executors' disks, not in their heaps; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def debounced(stream: DataFrame, key: str, time: str, tie: str, *, gap_seconds: int, late: str) -> DataFrame:
    """key, at (milliseconds), tie of the last event of each burst of a stream, once the watermark is past its time plus the gap.

    time: a timestamp column, whose milliseconds count; equal times are ordered by tie (a long). Rows behind the watermark (late) and
    repeated ones are dropped: by dropDuplicates, whose state is the events ahead of the watermark, as a session takes late rows as
    long as it is open. Bursts are session windows, so the rest of the state is one row a burst. A session's end still belongs to it: it is
    a microsecond less than the gap away. On a batch, events.debounced says the same of all rows but the bursts that are still open.
    """
    ts = F.timestamp_millis(F.unix_millis(time))
    rows = stream.select(F.col(key).alias("key"), F.col(tie).cast("long").alias("tie"), ts.alias("ts")).where("ts is not null").withWatermark("ts", late).dropDuplicates(["key", "ts", "tie"])
    gap = f"{gap_seconds - 1} seconds 999999 microseconds"
    last = rows.groupBy("key", F.session_window("ts", gap)).agg(F.max(F.struct("ts", "tie")).alias("last"))
    return last.select("key", F.unix_millis("last.ts").alias("at"), "last.tie")


def windowed(stream: DataFrame, time: str, by: list[str], *, length: str, slide: str, late: str, **aggregates: Column) -> DataFrame:
    """by, window and aggregates over sliding windows of event time. A row counts in those of its windows that the watermark has not
    passed; a window goes out once, when it has been passed."""
    return stream.withWatermark(time, late).groupBy(*by, F.window(time, length, slide).alias("window")).agg(*[v.alias(k) for k, v in aggregates.items()])


class Generations:
    """A contract in generations below a folder: each is written under its number, whole, and the highest holds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, contract: DataFrame, number: int) -> None:
        contract.write.mode("overwrite").parquet(f"{self.folder}/generation={number}")

    def latest(self) -> DataFrame:
        """The contract with its generation's number; read anew at each call."""
        every = self.spark.read.parquet(self.folder)
        last = every.agg(F.max("generation").alias("last"))
        return every.join(F.broadcast(last), F.col("generation") == F.col("last")).drop("last")


def append(stream: DataFrame, folder: str) -> StreamingQuery:
    """Appends a stream's rows below folder, each micro-batch under its number, as far as the input goes now; checkpointed beside them."""
    return stream.writeStream.outputMode("append").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def replay(rows: DataFrame, arrival: Column, arrivals: int, folder: str, start: Callable[[DataFrame, int], StreamingQuery]) -> None:
    """Plays a table as a stream: for n = 0 to arrivals - 1, rows whose arrival is n reach the watched folder, and start(stream, n) runs
    on what is there and not yet read. Each start continues from the checkpoint of the one before, with its watermark and state."""
    spark = rows.sparkSession
    watched = f"{folder}/in"
    for n in range(arrivals):
        rows.where(arrival == n).write.mode("append").parquet(watched)
        start(spark.readStream.schema(rows.schema).parquet(watched), n).awaitTermination()
