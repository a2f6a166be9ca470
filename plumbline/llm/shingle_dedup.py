"""Near deduplication of documents by SimHash anchors and the similarity of word shingles, verified exactly.

A text's set is that of its shingles' 64-bit hashes: five successive words (ASCII case folded, split at ASCII white space); fewer
words are one shingle. Two sets are near if their Jaccard similarity is at least 0.8. Candidates come from two places:

- fingerprints: SimHash of the set, linked within four bits by anchor-point covering (simhash.py);
- bands: the least values of five of 160 hash functions over the set. Four bits alone are not enough at this similarity: a pair at 0.8
  differs in 10 bits of 64 on average, and no cover reaches that far at a bearable cost. A pair at a similarity s shares
  none of the 32 bands with a probability of (1 - s^5)^32: 3e-6 at 0.8, 4e-13 at 0.9.

Every candidate counts only after its whole sets are compared. Equal sets are one node. In a band, all its nodes are first compared
with one of them, so a group of near copies costs a star, not all its pairs. Where nodes of a band are still apart, they are compared
in pairs if the band has at most CROWD of them. Nodes of larger bands (pages of one template, say) find each other another way, which
loses no pair: shingles are ordered by how many of these nodes have them, rarest first. Of two near sets of sizes m <= n, one of the
first m - ceil(8 m / 9) + 1 shingles of the smaller is one of the first n - ceil(4 n / 5) + 1 of the larger (prefix filtering: their
overlap is at least 8 m / 9), and what may follow that shingle has to be enough for it. Pages that share less than 8 / 9 of their
shingles with others, and have the rest for themselves, meet nobody there, so a template costs in proportion to its pages. Sets are
sent only for nodes with candidates; a node that many are compared with is replicated, so that no task holds all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .arrays import bitmap, blocks_of, in_bitmap, mixed, release, row_hashes, votes, words_of
from .common import Stash, join_hot, with_least
from .components import components

WORDS, BANDS, ROWS = 5, 32, 5
PARTS, OF = 4, 5  # a similarity of 4 / 5, in integers
CROWD = 32
_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, joined and ascending within a text; each text's number of them; a hash of each set (0: no words)."""
    word, n = words_of([t.lower() if t else None for t in texts])
    first = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    of = np.repeat(np.arange(len(n)), count)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    shingle = row_hashes(word, start, np.minimum(words, n)[of])
    order = np.lexsort((shingle, of))
    shingle = shingle[order]
    new = np.ones(len(of), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    shingle, size = shingle[new], np.bincount(of[new], minlength=len(n))
    node = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        each = mixed(shingle + np.uint64(0xD6E8FEB86659FD93))
        node[some] = mixed(np.add.reduceat(each, (np.cumsum(size) - size)[some]) ^ mixed(size[some].astype(np.uint64)))
    return shingle, size, node


def bands(shingle: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys of the bands of each set, a row each; sets without shingles have zeros."""
    out = np.zeros((len(size), BANDS), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    starts = (np.cumsum(size) - size)[some]
    for band in range(BANDS):
        key = np.full(len(some), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mixed(key + np.minimum.reduceat((shingle ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1)), starts))
        out[some, band] = key
    return out


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in blocks_of(batch, 1, 250_000):
            shingle, size, node = shingle_sets(texts)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(bands(shingle, size).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node.view(np.int64)), pa.array(votes(shingle, size).view(np.int64)), keys], names=["__i", "node", "fp", "keys"])
    release()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are near."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).cast("int").alias("copies"))
    many = sets.join(hubs, F.col("node") == F.col("b")).select(F.col("b").alias("hub"), F.col("set").alias("set_b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    left = pairs.join(hubs, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).select("a", "b", "part")
    left = left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(many, (F.col("b") == F.col("hub")) & (F.col("part") == F.col("copy")))
    x, y = F.size("set_a"), F.size("set_b")
    both = both.where(OF * F.least(x, y) >= PARTS * F.greatest(x, y))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(OF * shared >= PARTS * (x + y - shared)).select("a", "b")


def _by_fingerprint(nodes: DataFrame, stash: Stash) -> DataFrame:
    """a, b: nodes whose fingerprints are equal or linked: all of a fingerprint's with its smallest, and the smallest of linked ones."""
    least = stash.put(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
    equal = join_hot(nodes, least.where("n > 1"), "fp", "n", nodes.count()).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    links = stash.put(simhash.links(least.select("fp"), stash)).select("a", "b")
    links = links.join(least.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b")
    return equal.unionByName(links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


def _least_shared(x: Column, y: Column) -> Column:
    """Shingles that near sets of sizes x and y have in common, at least."""
    return F.ceil((x + y) * PARTS / (PARTS + OF) - 1e-9)


def by_rare_shingles(crowd: DataFrame, stash: Stash) -> DataFrame:
    """a, b: every near pair of crowd (node, set, c) of different c, and few others; see the module."""
    each = stash.put(crowd.select("node", "c", F.size("set").alias("n"), F.explode("set").alias("shingle")))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1").withColumnRenamed("shingle", "s")
    # a shingle that no other node has comes first, and leads to nobody
    ranked = each.join(often, F.col("shingle") == F.col("s"), "left").withColumn("often", F.coalesce("often", F.lit(1).cast("long")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle")) - 1)
    first = stash.put(ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * PARTS / OF - 1e-9)) & (F.col("often") > 1)).drop("s", "often"))
    small = first.where(F.col("rank") <= F.col("n") - _least_shared(F.col("n"), F.col("n")))
    x, y = small.alias("x"), first.alias("y")
    size = (F.col("y.n") > F.col("x.n")) | (F.col("y.n") == F.col("x.n")) & (F.col("y.node") > F.col("x.node"))
    rest = F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank"))  # this shingle and what follows it
    on = (F.col("x.shingle") == F.col("y.shingle")) & size & (F.col("x.c") != F.col("y.c")) & (OF * F.col("x.n") >= PARTS * F.col("y.n")) & (rest >= _least_shared(F.col("x.n"), F.col("y.n")))
    return x.join(y, on).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def shingle_groups(rows: DataFrame) -> DataFrame:
    """Every __i of rows (__i, __t) with component_id, the smallest __i reachable by near pairs. Texts without words are one group."""
    stash = Stash(rows.sparkSession, "shingles")
    seen = stash.put(rows.select("__i", "__t").mapInArrow(_banded, f"__i {rows.schema['__i'].dataType.simpleString()}, node long, fp long, keys array<long>"))
    one = stash.put(seen.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("rows_of_node")))
    keyed = stash.put(one.where("node <> 0").select("node", F.explode("keys").alias("key")))
    shared = stash.put(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    keyed = stash.put(join_hot(keyed, shared, "key", "n", keyed.count()).select("key", "node", "hub"))
    stars = keyed.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    stars = stash.put(stars.unionByName(_by_fingerprint(one.where("node <> 0").select("node", "fp"), stash)).distinct())
    wanted = stash.put(stars.select(F.explode(F.array("a", "b")).alias("node")).unionByName(keyed.select("node")).distinct())
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, "node", wanted.count()))

    def sets_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks_of(batch, 0, 250_000):
                shingle, size, node = shingle_sets(texts)
                ends = np.cumsum(size)
                _, at = np.unique(node, return_index=True)
                at = at[(size[at] > 0) & in_bitmap(bits.value, node[at])]
                if len(at):
                    values = np.concatenate([shingle[ends[k] - size[k] : ends[k]] for k in at])
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size[at]]).astype(np.int32)), pa.array(values.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), lists], names=["node", "set"])
        release()

    sets = stash.put(rows.select("__t").mapInArrow(sets_in, "node long, set array<long>").dropDuplicates(["node"]))
    links = stash.put(_verified(stars, sets))
    parts = components(links, stash).withColumnRenamed("node", "of")
    # in bands where nodes are still apart: pairs that were not compared, all of them or, in crowded bands, those by rare shingles
    now = stash.put(keyed.join(parts, F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    apart = stash.put(now.groupBy("key").agg((F.min("c") < F.max("c")).alias("apart"), F.count("*").alias("n")).where("apart and n > 2").select(F.col("key").alias("k"), "n"))
    few = stash.put(now.join(apart.where(F.col("n") <= CROWD), F.col("key") == F.col("k"), "left_semi"))
    x, y = few.alias("x"), few.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.c") != F.col("y.c"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = now.join(apart.where(F.col("n") > CROWD), F.col("key") == F.col("k"), "left_semi").select(F.col("node").alias("m"), "c").distinct()
    rest = rest.unionByName(by_rare_shingles(sets.join(many, F.col("node") == F.col("m")).select("node", "set", "c"), stash))
    rest = stash.put(rest.distinct().join(stars, ["a", "b"], "left_anti"))
    more = stash.put(_verified(rest, sets))
    if not more.isEmpty():
        parts = components(links.unionByName(more), stash).withColumnRenamed("node", "of")
    whole = one.join(parts, F.col("node") == F.col("of"), "left").select("node", "rows_of_node", F.coalesce("component", "node").alias("c"))
    placed = stash.put(join_hot(seen.select("__i", "node"), stash.put(whole), "node", "rows_of_node", seen.count()).select("__i", "c"))
    return with_least(placed, "c", "__i", "component_id", placed.count()).select("__i", "component_id")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, one row of each group of near copies: the one with the smallest id (nulls last), then the smallest row key."""
    return simhash.one_of_each(docs, shingle_groups, id_col=id_col, text_col=text_col)
