"""Mixing sources to target weights, as a time-varying curriculum.

A source's share of the training tokens is its target; its weight at time t (0 to 1) is the target times a schedule,
1 + slope (2t - 1), whose integral is 1. A source's documents form a stream in an order of hashes, repeated as often as the
target asks for. The position of a copy is the time when the integrated demand reaches the middle of the copy: the integral,
a quadratic, is inverted exactly. Sorting all copies by position, by ranges, gives the training order.

Sums run over buckets of a source's hashes: words are summed by source and bucket (a partial aggregate), bucket
offsets over those sums, and running sums inside one bucket. A hot source is therefore as many groups as it has buckets. Hashes are of
id and text, so many rows of one id, or of none, are spread too; only rows equal in both share a bucket, once for each copy.
Sums are of integers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, table

MOST = 3  # times that a source may be repeated
SLOPES = (-0.5, 0.0, 0.5)
PLAN = ("size", "source_size", "target", "taken", "copies", "positions")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, stash: Stash, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target, slope from sizes (source, size).

    Sources in code point order, null last, get the weights in turn. Their targets share the total by weight, at most
    most times a source's size; what that leaves over goes to the others by weight until none is above. The ranks come
    from ranges of sources and the ranges' counts; only sums reach the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = stash.put(by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, {}
    for r in by.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets[r["part"]], before = before, before + r["n"]
    if not offsets:
        return by.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("slope"))
    offset = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")]
    rank = (F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset) % len(weights)
    by = stash.put(by.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).alias("w"), F.element_at(F.array(*map(F.lit, SLOPES)), (rank % len(SLOPES) + 1).cast("int")).alias("slope")))
    total, level, full = None, 0.0, -1
    while True:
        capped = F.col("w") * F.lit(level) >= F.col("source_size") * most
        r = by.agg(F.sum("source_size").alias("total"), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)).alias("w"), F.count_if(capped).alias("full")).first()
        total = r["total"]
        if r["full"] == full or not r["w"]:
            break
        full, level = r["full"], (total - most * r["held"]) / r["w"]
    return by.select("source", "source_size", F.least(F.col("w") * F.lit(level), (F.col("source_size") * most).cast("double")).alias("target"), "slope")


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 7, with_row: bool = False, cut: str = "words") -> DataFrame:
    """One row per row of docs: id_col, the columns PLAN, and with with_row the whole row as a struct ``row``.

    taken: words that the mix takes of it, repeats counted; copies: array of (words taken, whole). cut="words": the last copy of
    a source ends at the word that its target ends at; cut="whole": copies are whole, and one is left out if its middle is
    beyond the target. positions: where in training (0 to 1) each copy comes. Null or blank texts have size 0 and are never
    taken; null ids and sources are values like others; repeated rows are documents each. Other columns, whatever their names,
    have no influence.
    """
    stash = Stash(docs.sparkSession, "mix")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)), F.lit(seed)).alias("h"), *row)
    small = stash.put(rows.select("source", "h", "size", *(["id"] * (not with_row))))
    base = rows if with_row else small
    shared = targets(small, stash, weights, most)
    buckets = max(256, 1 << math.ceil(math.log2(max(1, small.count()) / 65_536 + 1)))
    bucket = F.pmod(F.shiftright("h", 16), F.lit(buckets))
    sums = small.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    offsets = stash.put(offsets.join(shared, F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = base.withColumn("bucket", bucket).withColumn("inside", inside)
    out = out.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    out = out.withColumns({"start": F.col("before") + F.col("inside"), "goal": F.round("target").cast("long")})
    # the copy k takes the words of its interval [k * source_size + start, + size) that lie before the goal
    begin = "(k * source_size + start)"
    part = f"least(size, greatest(0, goal - {begin}))" if cut == "words" else f"if(2 * {begin} + size <= 2 * goal, size, 0)"
    copies = F.expr(f"filter(transform(sequence(0, {most - 1}), k -> struct(k as k, if(size > 0, {part}, 0) as n)), c -> c.n > 0)")
    u = "least(1D, (c.k * source_size + start + c.n / 2D) / goal)"
    when = f"if(slope = 0, {u}, (sqrt(pow(1 - slope, 2) + 4 * slope * {u}) - (1 - slope)) / (2 * slope))"
    return out.withColumn("each", copies).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        F.expr("aggregate(each, 0L, (a, c) -> a + c.n)").alias("taken"),
        F.expr("transform(each, c -> struct(c.n as words, c.n = size as whole))").alias("copies"),
        F.expr(f"transform(each, c -> {when})").alias("positions"), *(["row"] * with_row),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs in training order: a row for each copy taken, with all its columns; whole copies only."""
    out = plan(docs, with_row=True, cut="whole", **options).select(F.explode("positions").alias("position"), "row")
    return out.orderBy("position", F.xxhash64("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their first position in training, those not taken last."""
    out = plan(table(spark, sf_dir, "documents"))
    return out.withColumns({"copies": F.size("copies").cast("long"), "first_position": F.get("positions", F.lit(0))}).drop("positions").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
