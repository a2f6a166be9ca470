"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, with_least


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) that connect what the links (a, b) connect; nodes are integers."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch, so in bounded memory: a forest in place of its links."""
    for batch in batches:
        v, u = forest(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=["v", "u"])


def components(links: DataFrame, stash: Stash, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) of every node in links (columns a, b: longs, a <> b), as a stored table.

    Each round does a large star (every node's larger neighbours go to its smallest) and a small star (its smaller
    neighbours do), each an aggregate and a join by node, and is written to the shared folder; the links then form
    stars when a round changes nothing. A hub's minimum is aggregated partially and comes back to its links by a broadcast, so its
    links never meet in one task. rounds: a bound far above the logarithm needed; beyond it an error is raised.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    links = links.mapInArrow(_local, "v long, u long").distinct()
    at = stash.n
    links = stash.put(links)
    seen, n = None, links.count()
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = with_least(both, "v", "u", "m", 2 * n).where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).distinct()
        joined = with_least(large, "v", "u", "m", 2 * n)
        small = joined.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("v <> u").distinct()
        links = stash.put(small)
        if stash.n > at + 2:
            stash.drop(stash.n - 2)
        r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u") % 1_000_003).alias("h"), F.sum(F.pmod("u", F.lit(1_000_003))).alias("s"), F.count_distinct("v").alias("k")).first()
        now = (r["n"], r["h"], r["s"])
        if now == seen and r["n"] == r["k"]:
            break
        seen, n = now, r["n"]
    else:
        raise RuntimeError("the links' components were not found within the rounds")
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return stash.put(links.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots))
