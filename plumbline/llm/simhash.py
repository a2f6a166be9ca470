"""SimHash near-deduplication by anchor-point covering.

A fingerprint's 64 bits are three blocks of 22, 21 and 21 bits, so two fingerprints that differ in at most four bits differ in
at most one bit of some block. Each block, padded with zeros to 23 bits, is covered by the binary Golay code: every word
lies within three bits (its covering radius) of exactly one codeword, its home anchor. A fingerprint is replicated to each anchor
within radius plus threshold, four bits; there are six at most. Then a pair that is near in a block meets at the home anchor
of either. At each anchor those at home are compared with all replicas, and a forest of the links goes on, not all pairs.

From 2^25 distinct fingerprints on the blocks are two halves of 32 bits, of which 23 bits are coded and nine stand as they are: a pair
differs in at most two bits of a half, so replicas go to anchors within five bits whose nine bits differ in at most two (about
105 a half), and a forty-eighth as many pairs are compared.

Equal fingerprints are one row before that, so copies cost nothing. The coarse cover has 3 x 4,096 anchors, the fine one 2 x 2^21;
the table of crowded anchors' sizes is broadcast; they are split into tiles of members at home by tiles of replicas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import blocks_of, by_key, release, row_key, runs, votes
from .common import Stash, join_hot, table, with_least
from .components import components, forest

NEAR = 4
#: Covers: first bit and bits of each block, and how many of them the Golay code takes (the rest stands as it is). One of the
#: blocks of a pair within NEAR bits differs in at most NEAR // number of blocks.
COARSE = ((0, 22, 22), (22, 21, 21), (43, 21, 21))
FINE = ((0, 32, 23), (32, 32, 23))
MANY = 1 << 25  # distinct fingerprints from which the fine cover's replicas cost less than the coarse one's comparisons
GOLAY = 0xAE3  # fixed value: the generator polynomial of the binary Golay code of length 23


class Anchors:
    """Golay codewords near a word of 23 bits."""

    def __init__(self):
        rem = []
        for k in range(23):
            x = 1 << k
            for d in range(k, 10, -1):
                if x >> d & 1:
                    x ^= GOLAY << (d - 11)
            rem.append(x)
        low = np.zeros(1 << 12, np.int32)
        high = np.zeros(1 << 11, np.int32)
        for k in range(23):
            part, bit = (low, k) if k < 12 else (high, k - 12)
            part[np.arange(len(part)) >> bit & 1 == 1] ^= rem[k]
        self.low, self.high = low, high
        self.leader = np.zeros(2048, np.int64)
        far: list[list[int]] = []
        self.coset = [np.zeros((2048, 0), np.int64)] * 6
        for weight in range(6):
            if weight > 3:
                far = [[] for _ in range(2048)]
            for bits in combinations(range(23), weight):
                s = 0
                for k in bits:
                    s ^= rem[k]
                e = sum(1 << k for k in bits)
                if weight <= 3:
                    self.leader[s] = e
                else:
                    far[s].append(e)
            if weight > 3:
                most = max(map(len, far))
                self.coset[weight] = np.array([x + [-1] * (most - len(x)) for x in far], np.int64)

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 4095] ^ self.high[words >> 12]

    def home(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.leader[self.syndrome(words)]

    def others(self, words: np.ndarray, away: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Row and codeword of those exactly away (four or five) bits from a word."""
        e = self.coset[away][self.syndrome(words)]
        row, at = np.nonzero(e >= 0)
        return row, words[row] ^ e[row, at]


def fingerprint_texts(texts: list[bytes | None], words: int = 4) -> np.ndarray:
    """SimHash of each text's shingles of so many words (fewer words: of the whole sequence; none: 0)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        split = text.lower().split() if text else ()  # of bytes: A-Z, and white space of ASCII
        if not split:
            continue
        joined = b" ".join(split)
        if len(split) <= words:
            hashes.append(digest(joined, 42))
            lengths[k] = 1
            continue
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(split) - words + 1].tolist()
        hashes += [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
        lengths[k] = len(starts)
    return votes(np.array(hashes, np.uint64), lengths)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """id_col and fp (long: the fingerprint's bits) of every row, from its whole text; a null text has none: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks_of(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_texts(texts, words).view(np.int64))], names=[id_col, "fp"])
        release()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _replicas(cover: tuple[tuple[int, int, int], ...]):
    """Each fingerprint under its home anchors and, within the threshold of a block, under others."""
    threshold = NEAR // len(cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy()
                keys, home, of = [], [], []
                for b, (first, bits, coded) in enumerate(cover):
                    word = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
                    code, plain = word & ((1 << coded) - 1), word >> coded
                    flips = [sum(1 << x for x in c) for n in range(threshold + 1) for c in combinations(range(bits - coded), n)]
                    for flip in flips:
                        reach = threshold - flip.bit_count()
                        near = [(np.arange(len(fp)), anchors.home(code)), *(anchors.others(code, 3 + n) for n in range(1, reach + 1))]
                        for n, (row, anchor) in enumerate(near):
                            keys.append(b << 32 | (plain[row] ^ flip) << 23 | anchor)
                            home.append(np.full(len(row), n == 0 and flip == 0))
                            of.append(fp[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, home, of)], names=["anchor", "home", "fp"])

    return run


def near_forest(home: np.ndarray, all_: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within near bits between home and all_."""
    v, u = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = max(1, 2_000_000 // max(1, len(all_)))
    for at in range(0, len(home), step):
        part = home[at : at + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ all_[None, :]) <= near)
        a, b = part[i].view(np.int64), all_[j].view(np.int64)
        differ = a != b
        if differ.any():
            v, u = forest(np.concatenate([v, a[differ]]), np.concatenate([u, b[differ]]))
    return v, u


def links(fps: DataFrame, stash: Stash, *, near: int = NEAR, home_tile: int = 4096, tile: int = 65_536, fine: bool | None = None) -> DataFrame:
    """a, b: links between the distinct fingerprints fps (column fp) that connect all pairs within near bits (4 at most)."""
    if near > NEAR:
        raise ValueError("the covers' radius and thresholds are for four differing bits at most")
    cover = FINE if (fps.count() >= MANY if fine is None else fine) else COARSE
    there = stash.put(fps.select("fp").mapInArrow(_replicas(cover), "anchor long, home boolean, fp long"))
    sizes = there.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count("*").alias("r"))
    split = F.ceil(F.col("h") / home_tile).cast("int").alias("hs"), F.ceil(F.col("r") / tile).cast("int").alias("rs")
    if cover is COARSE:  # at most 3 x 4,096 rows; anchors without a pair go
        dealt = there.join(F.broadcast(sizes.where("h > 0 and r > 1").select("anchor", *split)), "anchor")
    else:  # crowded anchors alone
        crowded = sizes.where((F.col("h") > home_tile) | (F.col("r") > tile)).select("anchor", *split)
        dealt = there.join(crowded, "anchor", "left").fillna(1, ["hs", "rs"])
    h = F.xxhash64("fp")
    as_home = dealt.where("home").select("anchor", "fp", F.lit(True).alias("home"), F.pmod(h, F.col("hs")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rs").cast("long") - 1)).alias("j"))
    as_all = dealt.select("anchor", "fp", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("hs", F.lit(1)).cast("long") - 1)).alias("i"), F.pmod(h, F.col("rs")).alias("j"))
    rows = as_home.unionByName(as_all).select((F.col("anchor") + F.shiftleft("i", 34) + F.shiftleft("j", 49)).alias("k"), "home", "fp")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        k, home, fp = (t.column(c).to_numpy() for c in ("k", "home", "fp"))
        fp = fp.view(np.uint64)
        out = [near_forest(fp[s:e][home[s:e]], fp[s:e][~home[s:e]], near) for s, e in zip(*runs(k))]
        a, b = forest(*(np.concatenate(x) for x in zip(*out)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return by_key(rows, compare, "a long, b long")


def hex_fp(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_groups(fps: DataFrame, *, id_col: str = "doc_id", near: int = NEAR) -> DataFrame:
    """Every row of fps (id_col, fp) with component_id, the smallest id reachable by links of at most near differing bits.

    Null ids are reached last (a group of none but nulls has null). Rows repeated, and equal fingerprints, are one node.
    """
    stash = Stash(fps.sparkSession, "simhash")
    fps = stash.put(fps)
    one = stash.put(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows_of_fp")))
    parts = components(links(one, stash, near=near), stash).withColumnsRenamed({"node": "of", "component": "c"})
    node = one.join(parts, one["fp"] == parts["of"], "left").select("fp", "least", "rows_of_fp", F.coalesce("c", "fp").alias("c"))
    node = stash.put(node)
    whole = stash.put(with_least(node, "c", "least", "component_id", node.count()).select("fp", "rows_of_fp", "component_id"))
    return join_hot(fps, whole, "fp", "rows_of_fp", fps.count()).drop("rows_of_fp").select(*fps.columns, "component_id")


def one_of_each(docs: DataFrame, groups_of: Callable[[DataFrame], DataFrame], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, one row of each group: the one with the smallest id, nulls last, and then the smallest row key.

    groups_of gets __i (id and row key) and __t (text), and returns every __i with component_id, the smallest __i of its group. So rows
    with equal or null ids and other texts stay; rows repeated, equal in id and text, stay once.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("rk"))
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    groups = groups_of(keyed.select(F.col("key").alias("__i"), F.col("text").alias("__t")))
    stay = groups.where(F.col("__i").eqNullSafe(F.col("component_id"))).select("__i").distinct()
    return keyed.join(stay, F.col("key").eqNullSafe(F.col("__i")), "left_semi").dropDuplicates(["key"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(fingerprints(table(spark, sf_dir, "documents")))
    return groups.select("doc_id", hex_fp(F.col("fp")).alias("fingerprint"), "component_id")
