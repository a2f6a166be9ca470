"""Running numbers and sums within keys, over a table dealt out by ranges: no key has to fit a task.

Rows are range-partitioned and sorted by key and order; each partition is scanned batch by batch in numpy. A key that goes on in the
next partition gets what the partitions before have summed up: a row for each partition reaches the driver, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import release, runs
from .common import Stash

ODD = 0x9E3779B97F4A7C15  # base of the polynomials; odd, so it has an inverse modulo 2^64
INVERSE = pow(ODD, -1, 1 << 64)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each of the exponents, modulo 2^64."""
    out, left = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] *= np.uint64(base)
        base, left = base * base & 0xFFFFFFFFFFFFFFFF, left >> np.uint64(1)
    return out


def _scan(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, total = None, 0, np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            starts, ends = runs(key)
            size = ends - starts
            pos = np.arange(1, len(key) + 1) - np.repeat(starts, size)
            if key[0] == last:
                pos[: ends[0]] += before
            term = batch.column(1).to_numpy().view(np.uint64)
            if base != 1:
                term = term * powers(base, pos)
            s = np.cumsum(term, dtype=np.uint64)
            s -= np.repeat(s[starts] - term[starts], size)
            if key[0] == last:
                s[: ends[0]] += total
            last, before, total = key[-1], int(pos[-1]), s[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos), pa.array(s.view(np.int64))], names=[*batch.schema.names, "pos", "sum"])
        release()

    return run


def _carried(carry: dict[int, tuple[int, int, int]], base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, part, pos, s = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "part", "pos", "sum"))
            pos, s = pos.copy(), s.copy().view(np.uint64)
            for p in np.unique(part).tolist():
                if p in carry:
                    k, n, total = carry[p]
                    at = (part == p) & (key == k)
                    s[at] = s[at] * powers(base, np.array([n]))[0] + np.uint64(total)
                    pos[at] += n
            columns = {"pos": pa.array(pos), "sum": pa.array(s.view(np.int64))}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(k)) for k, c in enumerate(batch.schema.names)], names=batch.schema.names)

    return run


def running(rows: DataFrame, stash: Stash, order: list[Column], base: int = 1, only_order: list[str] | None = None) -> DataFrame:
    """rows, stored, with pos (1, 2, ... in a key's order) and sum: of value * base^pos up to the row, modulo 2^64.

    rows begin with the columns key and value (longs, never null), and have none named part, pos or sum. order: within a key;
    columns only_order are sorted by and then dropped.
    """
    rest = [c for c in rows.columns if c not in ("key", "value")]
    sorted_ = rows.select("key", "value", *rest).repartitionByRange(F.col("key"), *order).sortWithinPartitions(F.col("key"), *order).withColumn("part", F.spark_partition_id()).drop(*(only_order or []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    scanned = stash.put(sorted_.mapInArrow(_scan(base), f"{kinds}, pos long, sum long"))
    carry: dict[int, tuple[int, int, int]] = {}
    key, n, total = None, 0, 0  # of the last key so far
    for r in scanned.groupBy("part").agg(F.min("key").alias("first"), F.max(F.struct("key", "pos", "sum")).alias("last")).orderBy("part").collect():  # a row for each partition
        if r["first"] == key:
            carry[r["part"]] = (key, n, total)
        k, m, s = r["last"]
        if k == key:
            n, total = n + m, (total + (s % (1 << 64)) * pow(base, n, 1 << 64)) % (1 << 64)
        else:
            key, n, total = k, m, s % (1 << 64)
    return scanned.mapInArrow(_carried(carry, base), scanned.schema) if carry else scanned
