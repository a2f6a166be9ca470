"""Embedding near-deduplication with randomised-rotation binary codes.

Unit vectors are turned by a seeded random rotation. Stored of each are: its code, the signs of its coordinates; its correction factor,
the inner product of the vector and its own code; and its coordinates in four bits each, rounded at random (seeded), for the
other side of an estimate. (code of x . rounded y) / factor of x estimates the cosine of x and y without bias. The rotation makes
the part of the code beside x point anywhere, so the estimate of a cosine c errs by sqrt(1 - c^2) sqrt(1 - factor^2) / factor / sqrt(d - 1)
(one standard error), and by half a step of the rounding. Pairs whose confidence bounds (eps standard errors) reach the threshold
are recomputed exactly, in double precision; the others, far below it, are not.

Vectors are compared within a label and length only. Equal vectors are one row with a count; each label's rows are dealt to tiles, and
each pair of tiles is a task. Codes alone are dealt (5 / 8 byte a dimension). A pair of tiles answers which of its vectors have a
candidate there; these vectors are fetched for it, and their exact cosines give counts of links and a forest of them, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import by_key, runs
from .common import Stash, join_hot, table, with_least
from .components import components, forest

THRESHOLD = 0.93


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


LEVELS = 15  # steps of the rounded coordinates


class Codes:
    """Codes, correction factors and rounded coordinates of unit vectors (rows)."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray, seed: int = 11):
        self.d = unit.shape[1]
        turned = unit @ turn
        self.positive = turned >= 0
        self.factor = np.abs(turned).sum(axis=1) / np.sqrt(self.d)
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-12) / LEVELS
        noise = np.random.default_rng(seed + 1).random(self.d)
        self.rounded = np.clip(np.floor((turned - self.low[:, None]) / self.step[:, None] + noise), 0, LEVELS).astype(np.uint8)

    def packed(self) -> np.ndarray:
        """A row of bytes for each: signs, then two coordinates a byte."""
        pairs = np.pad(self.rounded, ((0, 0), (0, self.d % 2))).reshape(len(self.rounded), -1, 2)
        return np.concatenate([np.packbits(self.positive, axis=1), pairs[:, :, 0] << 4 | pairs[:, :, 1]], axis=1)

    @staticmethod
    def read(packed: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Signs (-1, 1) and rounded coordinates. Products of the two are sums of small integers, exact in single precision: the same
        numbers that popcounts of the coordinates' bit planes give."""
        cut = -(-d // 8)
        signs = np.unpackbits(packed[:, :cut], axis=1, count=d).astype(np.float32) * 2 - 1
        both = packed[:, cut:]
        return signs, np.stack([both >> 4, both & 15], axis=2).reshape(len(packed), -1)[:, :d].astype(np.float32)


def estimates(signs: np.ndarray, factor: np.ndarray, rounded: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Estimated cosines of all coded (rows) with all rounded (columns) vectors."""
    root = np.float32(np.sqrt(signs.shape[1]))
    return ((signs @ rounded.T) * step + np.outer(signs.sum(axis=1), low)) / (root * factor[:, None])


def errors(factor: np.ndarray, step: float, d: int, cosine: float, eps: float) -> np.ndarray:
    """How far an estimate may be below a cosine of at least this much."""
    beside = np.sqrt(np.maximum(0, 1 - cosine**2)) * np.sqrt(np.maximum(0, 1 - factor**2)) / factor
    return np.hypot(beside * min(1.0, eps / np.sqrt(max(1, d - 1))), eps * step / (2 * factor)) + 1e-5


def candidates(left: tuple, right: tuple, threshold: float, eps: float, same: bool, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Which of left and right (codes, factor, low, step, d) have a pair both of whose bounds (code of either, coordinates of the
    other) reach the threshold. The second bound is found where the first leaves few."""
    d = left[4]
    (signs, mine), (theirs, rounded) = Codes.read(left[0], d), Codes.read(right[0], d)
    least, other = ((threshold - errors(x[1], float(y[3].max(initial=0)), d, threshold, eps)).astype(np.float32) for x, y in ((left, right), (right, left)))
    root, total = np.float32(np.sqrt(d)), theirs.sum(axis=1)
    a, b = np.zeros(len(signs), bool), np.zeros(len(rounded), bool)
    for at in range(0, len(signs), block):
        part = slice(at, at + block)
        near = estimates(signs[part], left[1][part], rounded, right[2], right[3]) >= least[part, None]
        if same:  # each pair once
            near &= np.arange(len(rounded)) > np.arange(at, at + near.shape[0])[:, None]
        i, j = np.nonzero(near) if np.count_nonzero(near) < 200_000 else (None, None)
        if i is None:
            a[part] |= near.any(axis=1)
            b |= near.any(axis=0)
            continue
        i += at
        back = (np.einsum("ij,ij->i", theirs[j], mine[i]) * left[3][i] + total[j] * left[2][i]) / (root * right[1][j])
        stays = back >= other[j]
        a[i[stays]] = True
        b[j[stays]] = True
    return a, b


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, block: int = 1024):
    """(i, j) of rows of x and y with a cosine of at least threshold, in double precision; rows are finite and not zero."""
    norm_x, norm_y = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
    for at in range(0, len(x), block):
        i, j = np.nonzero(x[at : at + block] @ y.T >= (threshold - 1e-9) * norm_x[at : at + block, None] * norm_y)
        for k in range(0, len(i), 200_000):
            p, q = i[k : k + 200_000] + at, j[k : k + 200_000]
            near = np.einsum("ij,ij->i", x[p], y[q]) / (norm_x[p] * norm_y[q]) >= threshold
            yield p[near], q[near]


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list starts and the last ends."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])


def _coded(seed: int):
    """node, class, mark, codes, factor, low, step, d of vectors (node, class, mark, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            flat, at = _matrix(pa.chunked_array([batch.column(3)]))
            size = np.diff(at)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                turn = turns.setdefault(d, rotation(d, seed))
                x = flat[at[rows][:, None] + np.arange(d)]
                c = Codes(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], turn, seed)
                codes = pa.array([r.tobytes() for r in c.packed()], pa.binary())
                floats = [pa.array(v.astype(np.float32)) for v in (c.factor, c.low, c.step)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(3)), codes, *floats, pa.array([d] * len(rows), pa.int32())], names=["node", "class", "mark", "codes", "factor", "low", "step", "d"])

    return run


def _groups(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The table with its groups of equal k and mark, their starts and ends; where several marks met under one k, sorted by both."""
    k, mark = (t.column(c).to_numpy() for c in ("k", "mark"))
    met = (k[1:] == k[:-1]) & (mark[1:] != mark[:-1])
    if met.any():
        order = np.lexsort((mark, k))
        t, k, mark = t.take(pa.array(order)), k[order], mark[order]
    new = (k[1:] != k[:-1]) | (mark[1:] != mark[:-1])
    return t, *runs(np.concatenate([[0], np.cumsum(new)]))


def embedding_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, eps: float = 6, tile: int = 16_384, seed: int = 11, hash_bits: int = 63) -> DataFrame:
    """One row per row of vectors: id_col, n_links (other rows linked directly), component_id, kept (it is the smallest id of its component).

    Links: equal labels, not null, and a cosine of at least threshold. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different length. eps: standard errors in the confidence bound; a pair is
    missed only if both of its estimates err by more (odds under one in 10^10). Rows repeated count as other rows; rows with a null id are linked and
    get the smallest other id of their component. Further columns are not read. Labels and pairs of tiles that share a hash (of
    hash_bits) are told apart by a second one of 64 bits, so they are not compared with each other.
    """
    stash = Stash(vectors.sparkSession, "vectors")
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("v"), F.col(label_col).cast("string").alias("label"))
    fine = F.col("label").isNotNull() & F.coalesce(F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"), F.lit(False))
    key = F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64("v", "label", F.lit(1)).alias("b"))
    rows = stash.put(rows.withColumn("key", F.when(fine, key)).withColumn("v", F.when(fine, F.col("v"))))
    one = rows.where("key is not null").groupBy("label", "v", "key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    cut = lambda h: h.bitwiseAND(F.lit((1 << hash_bits) - 1).cast("long"))
    marks = {"class": cut(F.xxhash64("label", F.size("v"))), "mark": F.xxhash64(F.size("v"), "label", F.lit(5)), "node": F.monotonically_increasing_id()}
    one = stash.put(one.withColumns(marks))  # numbers that stay, as they are stored
    coded = stash.put(one.select("node", "class", "mark", "v").mapInArrow(_coded(seed), "node long, class long, mark long, codes binary, factor float, low float, step float, d int"))
    sizes = stash.put(one.groupBy("class").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    dealt = coded.join(sizes, "class").withColumn("t", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.least("t", "o"), F.greatest("t", "o")
    dealt = dealt.select(cut(F.xxhash64("class", *pair)).alias("k"), F.xxhash64("mark", *pair).alias("mark"), (F.col("t") <= F.col("o")).alias("left"), (F.col("t") == F.col("o")).alias("same"), *coded.drop("class", "mark").columns)

    def sides(left: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        alone = bool(same.all())
        return l, l if alone else r, alone

    def choose(t: pa.Table) -> pa.RecordBatch:
        """The vectors of each pair of tiles that have a candidate there."""
        t, starts, ends = _groups(t)
        k, mark, left, same, node, factor, low, step, d = (t.column(c).to_numpy() for c in ("k", "mark", "left", "same", "node", "factor", "low", "step", "d"))
        codes, chosen = t.column("codes").combine_chunks(), np.zeros(len(k), bool)
        for s, e in zip(starts, ends):
            packed = np.frombuffer(b"".join(codes.slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1)
            l, r, alone = sides(left[s:e], same[s:e])
            if not len(l) or not len(r):
                continue  # the other tile is empty
            a, b = candidates(*((packed[x], factor[s + x], low[s + x], step[s + x], int(d[s])) for x in (l, r)), threshold, eps, alone)
            chosen[s + l[a]] = True
            chosen[s + r[b]] = True
        return pa.RecordBatch.from_arrays([pa.array(x[chosen]) for x in (k, mark, left, same, node)], names=["k", "mark", "left", "same", "node"])

    def compare(t: pa.Table) -> pa.RecordBatch:
        """Counts of links of the vectors in each pair of tiles, and forests of the links."""
        t, starts, ends = _groups(t)
        left, same, node, n = (t.column(c).to_numpy() for c in ("left", "same", "node", "n"))
        flat, at = _matrix(t.column("v"))
        found, count, forests = [], [], []
        for s, e in zip(starts, ends):
            m = flat[at[s] : at[e]].reshape(e - s, -1)
            l, r, alone = sides(left[s:e], same[s:e])
            total = np.zeros(e - s, np.int64)
            v, u = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i, j in near_pairs(m[l], m[r], threshold):
                p, q = l[i], r[j]
                other = p != q
                p, q = p[other], q[other]
                np.add.at(total, p, n[s:e][q])
                if not alone:
                    np.add.at(total, q, n[s:e][p])
                v, u = forest(np.concatenate([v, node[s:e][p]]), np.concatenate([u, node[s:e][q]]))
            some = np.flatnonzero(total)
            found.append(node[s:e][some])
            count.append(total[some])
            forests.append((v, u))
        a, b = (np.concatenate(x) for x in zip(*forests))
        nodes, counts = np.concatenate(found), np.concatenate(count)
        zero = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((nodes, a), (np.zeros_like(nodes), b), (counts, zero), (np.zeros(len(nodes), bool), np.ones(len(a), bool)))], names=["a", "b", "n", "link"])

    chosen = stash.put(by_key(dealt, choose, "k long, mark long, left boolean, same boolean, node long", least_rows=tile))
    fetched = chosen.join(one.select("node", "n", "v"), "node")
    made = stash.put(by_key(fetched, compare, "a long, b long, n long, link boolean", least_rows=tile // 4))
    parts = components(made.where("link").select("a", "b"), stash)
    counts = made.where("not link").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    node = one.select("key", "node", "n", "least").join(parts, "node", "left").join(counts, "node", "left")
    node = stash.put(node.select("key", "n", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    whole = stash.put(with_least(node, "component", "least", "component_id", node.count()).select("key", "n", "n_links", "component_id"))
    linked = join_hot(rows.where("key is not null").select("id", "key"), whole, "key", "n", rows.count()).select("id", "n_links", "component_id")
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
fine AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND len(x) > 0
         AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
          WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {THRESHOLD}),
reach(r, other) AS (SELECT r, r FROM v UNION SELECT s.r, l.b FROM reach s JOIN links l ON l.a = s.other),
component AS (SELECT s.r, min(v.vec_id) AS component_id FROM reach s JOIN v ON v.r = s.other GROUP BY s.r),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN component USING (r) LEFT JOIN n USING (r)
"""
