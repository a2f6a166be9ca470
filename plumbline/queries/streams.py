"""Queries of stream operators: batch twins with SQL, and the streams themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..registry import query, table
from ..streaming import events as S
from ..streaming import stateful as T


@query("latest_version", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1")
def latest_version(spark, d):
    out = S.latest(table(spark, d, "events"), "user_id", F.struct("ts", "event_id"), "event_type", "value")
    return out.select("user_id", "event_type", F.round("value", 6).alias("value"))


@query("debounce", "SELECT event_id, user_id FROM (SELECT event_id, user_id, date_diff('second', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS pause FROM events) WHERE pause IS NULL OR pause >= 14400")
def debounce(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return S.debounced(e, "user_id", "ts", 14400, "event_id").drop("ts")


@query("debounce_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM r GROUP BY user_id, s")
def debounce_sessions(spark, d):
    return S.sessions(table(spark, d, "events"), "user_id", "ts", "4 hours").select("user_id", "n", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("tumbling_windows", "SELECT event_type, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    """An extension: windows of event time."""
    g = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


@query("stream_publish", "SELECT event_id, 'call.argument-type-mismatch' AS rule FROM events WHERE value > 90")
def stream_publish(spark, d):
    """Every micro-batch's diagnostics, written under the batch's number."""
    at = shared_folder(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(_globbed(spark, d))
    rule = lambda df: df.where("value > 90").select("event_id", F.lit("call.argument-type-mismatch").alias("rule"))
    S.publish(source, rule, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "rule")


def _globbed(spark, d) -> str:
    """A path that a file stream can watch: the table's folder, or a pattern of its only file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{d}/events.parquet" if fs.getFileStatus(path).isDirectory() else f"{d}/events*.parquet"


@query("stream_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark, d):
    """Latest version by key, kept by the stream itself."""
    at = shared_folder(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(_globbed(spark, d))
    out = S.latest(source, "user_id", F.struct("ts", "event_id"), "event_type")
    q = out.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_generation", "SELECT event_id, event_type FROM events WHERE event_type = 'click' AND value > 50 OR event_type = 'view' AND value > 80")
def stream_generation(spark, d):
    """Micro-batches see the contract as it is when they run."""
    at = shared_folder(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(_globbed(spark, d))
    contract = lambda: spark.createDataFrame([("click", 50.0), ("view", 80.0)], "event_type string, most double")
    rule = lambda df, c: df.join(F.broadcast(c), "event_type").where("value > most").select("event_id", "event_type")
    S.publish(source, rule, lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/checkpoint", contract).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type")


# A table played as a stream: a third of January at a time; every fiftieth event comes a third late, mostly too late for a watermark of a day.
_LATE = "1 day"
_ARRIVALS = 3
_PLAYED = "e AS (SELECT event_id, user_id, event_type, value, ts, least(2, (day(ts) - 1) // 10 + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END) AS a FROM events)"
_PLAYED_SECONDS = _PLAYED.replace("value, ts,", "value, date_trunc('second', ts) AS ts,")
_MARKS = "w AS (SELECT a + 1 AS a, max(max(ts)) OVER (ORDER BY a) - INTERVAL 1 DAY AS w FROM e GROUP BY a)"


def _played(spark, d):
    arrival = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)).cast("int")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")), arrival


@query("stream_debounce", f"WITH {_PLAYED_SECONDS}, {_MARKS}, k AS (SELECT e.* FROM e LEFT JOIN w USING (a) WHERE w.w IS NULL OR e.ts > w.w), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM k) SELECT user_id, event_id FROM n WHERE (after IS NULL OR date_diff('second', ts, after) >= 14400) AND ts + INTERVAL 4 HOUR <= (SELECT max(w) FROM w)")
def stream_debounce(spark, d):
    """Last events of bursts, by session windows: those whose four hours the watermark has passed; late rows are dropped."""
    at = shared_folder(spark, "stream")
    rows, arrival = _played(spark, d)

    def start(stream, n):
        with T.state_store(spark):
            return T.append(T.debounced(stream, "user_id", "ts", "event_id", gap_seconds=14400, late=_LATE), at)

    T.replay(rows.withColumn("ts", F.date_trunc("second", "ts")), arrival, _ARRIVALS, at, start)
    return spark.read.schema("key long, at long, tie long").parquet(f"{at}/out").select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"))


@query("stream_late_windows", f"WITH {_PLAYED}, {_MARKS}, x AS (SELECT e.*, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM e), k AS (SELECT x.* FROM x LEFT JOIN w USING (a) WHERE w.w IS NULL OR start + INTERVAL 2 DAY > w.w) SELECT event_type, strftime(start, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n, max(value) AS most FROM k WHERE start + INTERVAL 2 DAY <= (SELECT max(w) FROM w) GROUP BY 1, 2")
def stream_late_windows(spark, d):
    """Windows of two days, one each day, once the watermark has passed them; a late row counts only in windows still open."""
    at = shared_folder(spark, "stream")
    rows, arrival = _played(spark, d)
    start = lambda stream, n: T.append(T.windowed(stream, "ts", ["event_type"], length="2 days", slide="1 day", late=_LATE, n=F.count("*"), most=F.max("value")), at)
    T.replay(rows, arrival, _ARRIVALS, at, start)
    out = spark.read.schema("event_type string, window struct<start: timestamp, end: timestamp>, n long, most double").parquet(f"{at}/out")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "most")


@query("stream_contract_versions", f"WITH {_PLAYED}, g AS (SELECT DISTINCT a FROM e), c AS (SELECT g.a, e.event_type, min(e.value) AS lo, max(e.value) AS hi FROM g JOIN e ON e.a < g.a GROUP BY 1, 2) SELECT e.event_id, CAST(e.a AS BIGINT) AS generation, CASE WHEN e.value < lo THEN 'below' ELSE 'above' END AS finding FROM e JOIN c ON c.a = e.a AND c.event_type = e.event_type WHERE e.value < lo OR e.value > hi")
def stream_contract_versions(spark, d):
    """The contract is the domain of what came before; it has a new generation for each arrival, and a batch is held against the one then valid."""
    at = shared_folder(spark, "stream")
    rows, arrival = _played(spark, d)
    contract = T.Generations(spark, f"{at}/contract")

    def rule(batch, c):
        v = F.col("value")
        return batch.join(c, "event_type").where((v < F.col("lo")) | (v > F.col("hi"))).select("event_id", F.col("generation").cast("long").alias("generation"), F.when(v < F.col("lo"), "below").otherwise("above").alias("finding"))

    def start(stream, n):
        contract.put(rows.where(arrival < n).groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), n)
        return S.publish(stream, rule, lambda df, k: df.write.mode("overwrite").parquet(f"{at}/out/batch={k}"), f"{at}/checkpoint", contract.latest)

    T.replay(rows, arrival, _ARRIVALS, at, start)
    return spark.read.schema("event_id long, generation long, finding string").parquet(f"{at}/out").select("event_id", "generation", "finding")
