"""Exact deduplication against a minimal perfect hash of historical digests.

The digests of a historical table (grouped first, so that copies meet nowhere) and those of new rows are dealt to
shards by their leading bits. In a shard a minimal perfect hash function is built over the distinct historical
digests: level by level, each digest sets one bit of a bit array; digests alone on their bit keep it, the others go to
the next level; the rank of a digest's bit is its slot. A slot holds the full digest and the locator of its winner.
A new digest is looked up in its slot and compared byte by byte: a perfect hash answers for nonmembers too. Members
are repeats of the slot's winner; nonmembers form groups of their own.

Shards hold about shard_digests distinct digests each. Copies are counted before any shuffle, so a digest that a
third of all rows share is one row per task. In the last join, rows to groups, hot digests' groups are broadcast
(fewer than 65,536, as they hold more than 1 / 65,536 of the rows each).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import by_key, runs
from .common import SPACE, Stash, join_hot, table

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values: splitmix64

_NONE = np.iinfo(np.int64).max


def _hash(words: np.ndarray, level: int) -> np.ndarray:
    x = words + _MIX[0] * np.uint64(level + 1)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct digests, rows of an (n, 4) array of unsigned 64-bit words.

    slots(words) gives each row's slot, 0 to n - 1, or -1 where it certainly is no member. gamma: bits of a level for
    each digest on it. Digests still colliding at the last level are found by their bytes.
    """

    def __init__(self, words: np.ndarray, gamma: float = 2.0, levels: int = 24):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, base = words, 0
        for level in range(levels):
            if not len(left):
                break
            size = max(64, int(gamma * len(left)))
            at = self._at(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.rest = {row.tobytes(): base + k for k, row in enumerate(left)}

    @staticmethod
    def _at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_hash(words[:, 1] ^ (words[:, 2] << np.uint64(1)), level) % np.uint64(size)).astype(np.int64)

    def slots(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        open_ = np.arange(len(words))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._at(words[open_], level, size)
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        for k in open_ if self.rest else ():
            out[k] = self.rest.get(words[k].tobytes(), -1)
        return out


def _resolve(t: pa.Table) -> pa.RecordBatch:
    """Of whole shards: the historical digests' slots with what new digests add to them, and the nonmembers."""
    k, old = t.column("k").to_numpy(), t.column("old").to_numpy()
    words = np.frombuffer(b"".join(t.column("digest").to_pylist()), "<u8").reshape(-1, 4)
    # the locator of a winner; null ids come last
    ids = pc.fill_null(t.column("keep_id"), _NONE).to_numpy().copy()
    size = t.column("group_size").to_numpy().copy()
    stays = np.ones(len(k), bool)
    for s, e in zip(*runs(k)):
        was, new = s + np.flatnonzero(old[s:e]), s + np.flatnonzero(~old[s:e])
        if not len(was) or not len(new):
            continue
        slot_of = PerfectHash(words[was])
        locator = np.empty(len(was), np.int64)
        locator[slot_of.slots(words[was])] = was  # by slot: the row that holds the full digest and the winner
        slot = slot_of.slots(words[new])
        there = locator[np.maximum(slot, 0)]
        member = (slot >= 0) & (words[there] == words[new]).all(axis=1)
        there, new = there[member], new[member]
        size[there] += size[new]
        ids[there] = np.minimum(ids[there], ids[new])
        stays[new] = False
    at = np.flatnonzero(stays)
    rows = pa.array(at)
    return pa.RecordBatch.from_arrays([t.column("digest").combine_chunks().take(rows), pa.array(ids[at], mask=ids[at] == _NONE), pa.array(size[at]), pa.array(old[at])], names=["digest", "keep_id", "group_size", "historical"])


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest_groups(rows: DataFrame, history: DataFrame, *, shard_digests: int = 100_000) -> DataFrame:
    """digest (32 bytes), keep_id (smallest id, nulls last), group_size, historical, of all digests of both tables.

    Both have columns id (long) and digest. Ids are the winners' locators.
    """
    n = max(1, history.count() + rows.count())
    shards = 1 << max(4, math.ceil(math.log2(n / shard_digests)) if n > shard_digests else 0)
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards))
    sides = [t.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("old", F.lit(old)) for t, old in ((history, True), (rows, False))]
    return by_key(sides[0].unionByName(sides[1]).withColumn("k", shard), _resolve, "digest binary, keep_id long, group_size long, historical boolean")


def exact_dedup(docs: DataFrame, historical: Column, *, id_col: str = "doc_id", text_col: str = "text", shard_digests: int = 100_000) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, known (historical rows have this text).

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. The
    row with the smallest id stays (a null id only in a group of nulls); rows repeated with that same id stay
    together. historical marks the rows the hash is built over (null: not). Other columns are not read.
    """
    stash = Stash(docs.sparkSession, "digests")
    ids = stash.put(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normal_text(F.col(text_col)), 256)).alias("digest"), F.coalesce(historical, F.lit(False)).alias("old")))
    groups = digest_groups(ids.where(~F.col("old")).select("id", "digest"), ids.where("old").select("id", "digest"), shard_digests=shard_digests)
    out = join_hot(ids, stash.put(groups), "digest", "group_size", ids.count())
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("historical").alias("known"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's CRC is even count as historical, the others as a new crawl."""
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0).drop("known")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
