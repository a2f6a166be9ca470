"""Prefix trie of conversations, by polynomial rolling fingerprints.

A node stands for a distinct sequence of the first d turns (role and text) of some conversations, its members. The fingerprint of a
prefix is a polynomial in its turns' SHA-256 digests, summed up along each conversation by a numpy scan over ranges of (conversation,
turn): a long conversation is many ranges. Equal fingerprints are only candidates: in each group every member's depth, last turn
(128 bits of its digest) and preceding group have to be those of its representative, the smallest conversation. Depth by depth that
makes whole prefixes equal. Members that differ leave the group together with all that follows in their conversations, under a key
made from what they differ in, until no group is mixed.

Then the rollup to parents needs no walk: every node belongs to its representative, which goes on representing all that is below, so
a subtree's sum is the sums of what its members represent, and those of the node's own representative count from its depth on. Groups
are aggregated partially before any shuffle (a third of all conversations may share a turn); hot conversations are scanned by ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mixed, release
from .common import Stash, table
from .mixing import words
from .ranges import INVERSE, ODD, powers, running

ROUNDS = 50
_PIECE = 8192


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def as_turns(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, at (a struct to order a conversation's rows by: turn, nulls first, then role and text), digest, n_words.

    Rows without a conversation's id belong to none and give no turn.
    """
    c = {k: F.col(f"`{v}`") for k, v in (("conv", conv_col), ("turn", turn_col), ("role", role_col), ("text", text_col))}
    rows = conversations.where(c["conv"].isNotNull())
    at = F.struct(c["turn"].alias("turn"), F.coalesce(c["role"], F.lit("")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"))
    return rows.select(c["conv"].cast("long").alias("conv"), at.alias("at"), turn_digest(c["role"], c["text"]).alias("digest"), words(c["text"]).alias("n_words"))


def numbered(turns: DataFrame, stash: Stash) -> DataFrame:
    """conv, depth (1, 2, ... in the order of at), digest, n_words of turns, stored."""
    rows = turns.select(F.col("conv").alias("key"), F.lit(0).cast("long").alias("value"), "at", "digest", "n_words")
    out = running(rows, stash, [F.col("at.turn").asc_nulls_first(), F.col("at.role"), F.col("at.text")], only_order=["at"])
    return stash.put(out.select(F.col("key").alias("conv"), F.col("pos").alias("depth"), "digest", "n_words"))


def rebuilt(turns: DataFrame, stash: Stash, *, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv) and their turns (as numbered ones): the first h of conversation c - c % group, then c's own after its first h;
    h = crc32 of the decimal c, modulo most + 1."""
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most + 1))
    convs = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("depth") <= most, F.struct("depth", "digest", "n_words")))).alias("head"))
    heads = convs.select(F.col("conv").alias("base"), "head")
    convs = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("b")).join(heads, F.col("b") == F.col("base"), "left")
    lead = F.filter(F.coalesce("head", F.array()), lambda t: t["depth"] <= F.col("h"))
    convs = stash.put(convs.select("conv", "h", lead.alias("lead")))
    own = turns.withColumn("h", h).where("depth > h").join(convs.select(F.col("conv").alias("c"), F.size("lead").alias("n")), F.col("conv") == F.col("c"))
    own = own.select("conv", (F.col("depth") - F.col("h") + F.col("n")).alias("depth"), "digest", "n_words")
    lent = convs.select("conv", F.explode("lead").alias("t")).select("conv", "t.depth", "t.digest", "t.n_words")
    return convs.select("conv"), own.unionByName(lent)


def _keyed(keep: int):
    """Group keys of each prefix and of the one before it. keep: bits of a fingerprint that are used (64; fewer in tests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, term, s = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "pos", "value", "sum"))
            digest = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("digest")).to_pylist()), "<i8").reshape(-1, 4)
            s, d = s.view(np.uint64), depth.astype(np.uint64)
            before = s - term.view(np.uint64) * powers(INVERSE, depth)
            mask = np.uint64((1 << keep) - 1)
            g, p = (mixed((x & mask) + k * np.uint64(ODD)) for x, k in ((s, d), (before, d - np.uint64(1))))
            p[depth == 1] = 0
            columns = [conv, depth, g.view(np.int64), p.view(np.int64), digest[:, 0], digest[:, 1]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(batch.schema.get_field_index("n_words"))], names=["conv", "depth", "g", "parent", "d0", "d1", "n_words"])

    return run


def prefixes(convs: DataFrame, turns: DataFrame, stash: Stash, keep: int = 64) -> DataFrame:
    """conv, depth, g (the node's key), parent (its parent's), d0 and d1 (the last turn's digest), n_words of each prefix, d = 0 included."""
    rows = turns.select(F.col("conv").alias("key"), _leading(F.col("digest")).alias("value"), "depth", "digest", "n_words")
    scanned = running(rows, stash, [F.col("depth")], INVERSE)
    out = scanned.mapInArrow(_keyed(keep), "conv long, depth long, g long, parent long, d0 long, d1 long, n_words long")
    zero = F.lit(0).cast("long")
    root = convs.select("conv", *(zero.alias(c) for c in ("depth", "g", "parent", "d0", "d1", "n_words")))
    return stash.put(out.unionByName(root))


def _leading(digest: Column) -> Column:
    """A long from the first bytes of a digest."""
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long")


_SAME = ("depth", "parent", "d0", "d1")


def verified(rows: DataFrame, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """rows with keys that only equal prefixes share, and their groups: g, conv_id (the representative), n_convs and what all members have.

    A group is sound if its members agree in all of _SAME, that is, if its least and greatest values are the representative's.
    """
    for _ in range(ROUNDS):
        groups = rows.groupBy("g").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), *(f(c).alias(f"{c}_{k}") for c in _SAME for k, f in enumerate((F.min, F.max))))
        groups = stash.put(groups)
        mixed_ = groups.where(" or ".join(f"{c}_0 <> {c}_1" for c in _SAME)).select("g", "conv_id")
        if mixed_.isEmpty():
            return rows, groups.select("g", "conv_id", F.col("n_convs"), "n_words", F.col("depth_0").alias("depth"), F.col("parent_0").alias("parent"))
        within = rows.join(mixed_, "g")
        lead = within.where("conv = conv_id").groupBy("g").agg(F.min_by(F.struct(*_SAME), "depth").alias("lead"))
        differ = within.join(lead, "g").where(F.struct(*_SAME) != F.col("lead"))
        leaves = stash.put(differ.groupBy("conv").agg(F.min(F.struct("depth", "g", "parent", "d0", "d1")).alias("x")).select(F.col("conv").alias("c"), "x"))
        new = F.xxhash64("g", "x.depth", "x.g", "x.parent", "x.d0", "x.d1")
        after = F.col("x.depth").isNotNull() & (F.col("depth") >= F.col("x.depth"))
        parent = F.xxhash64("parent", "x.depth", "x.g", "x.parent", "x.d0", "x.d1")
        moved = rows.join(leaves, F.col("conv") == F.col("c"), "left").select("conv", "depth", F.when(after, new).otherwise(F.col("g")).alias("g"), F.when(after & (F.col("depth") > F.col("x.depth")), parent).otherwise(F.col("parent")).alias("parent"), "d0", "d1", "n_words")
        rows = stash.put(moved)
    raise RuntimeError("the fingerprints' collisions were not split within the rounds")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted members to pieces of joined decimal ids: key, first id, text."""
    for batch in batches:
        g, conv = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1])])) if len(g) else []
        bounds = sorted({*(int(c) for c in cut), *range(0, len(g), _PIECE), len(g)})
        out = [(g[s], conv[s], ",".join(map(str, conv[s:e].tolist()))) for s, e in zip(bounds[:-1], bounds[1:])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out])], names=["g", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 of each key, in bounded memory."""
    key, state, done = None, None, []
    for batch in batches:
        for g, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if g != key or state is None:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = g, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield _digests(done)
            done = []
    if state is not None:
        done.append((key, state.hexdigest()))
    if done:
        yield _digests(done)
    release()


def _digests(done: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.int64()), pa.array([d for _, d in done])], names=["g", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """g, ends_sha256: of the ascending ids of conversations that end at a node, comma-joined. A node's ids are joined where they lie,
    sorted by ranges, and the pieces of one node (8,192 ids or more in one, where it has so many) hashed in one stream, as the hash asks for."""
    last = rows.groupBy("conv").agg(F.max(F.struct("depth", "g")).alias("x")).select("x.g", "conv")
    pieces = last.repartitionByRange("g", "conv").sortWithinPartitions("g", "conv").mapInArrow(_pieces, "g long, first long, ids string")
    return pieces.repartition("g").sortWithinPartitions("g", "first").mapInArrow(_hashed, "g long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, stash: Stash, *, keep: int = 64) -> DataFrame:
    """One row per node: g, parent (keys), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    convs: conv, one row each, turnless ones too. turns: conv, depth, digest, n_words as numbered() gives them. The root has depth 0
    and a null parent_conv_id; without conversations there is no node. saved_tokens: of the subtree, (n_convs - 1) * n_words of each
    node's last turn, what sharing prefixes saves. (conv_id, depth) names a node and finds its text among the turns.
    """
    rows, nodes = verified(prefixes(convs, turns, stash, keep), stash)
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "p")
    nodes = nodes.join(children, F.col("g") == F.col("p"), "left").drop("p").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stash.put(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("n_words")))
    below = running(nodes.select(F.col("conv_id").alias("key"), "value", "depth", "g"), stash, [F.col("depth").desc()]).select(F.col("g").alias("g1"), F.col("sum").alias("from_here"))
    own = stash.put(nodes.groupBy("conv_id").agg(F.sum("value").alias("own_value"), F.count_if(F.col("n_children") == 0).alias("own_leaves")).withColumnRenamed("conv_id", "c"))
    sums = rows.select("conv", "g").join(own, F.col("conv") == F.col("c")).groupBy("g").agg(F.sum("own_value").alias("all_values"), F.sum("own_leaves").alias("n_leaves")).withColumnRenamed("g", "g2")
    up = nodes.select(F.col("g").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, F.col("g") == F.col("g1")).join(sums, F.col("g") == F.col("g2")).join(own.select("c", "own_value"), F.col("conv_id") == F.col("c"))
    out = out.join(ends(rows).withColumnRenamed("g", "g3"), F.col("g") == F.col("g3"), "left")
    out = out.join(up, (F.col("parent") == F.col("p")) & (F.col("depth") > 0), "left")
    return out.select(
        "g", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("all_values") - F.col("own_value") + F.col("from_here")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations."""
    stash = Stash(spark, "trie")
    convs, turns = rebuilt(numbered(as_turns(table(spark, sf_dir, "conversations")), stash), stash)
    return prefix_trie(convs, turns, stash).drop("g", "parent")


_CRC = "list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))"

SQL = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
  coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
lead AS (SELECT k.c, h, coalesce(n, 0) AS n FROM k LEFT JOIN (SELECT k.c, count(*) AS n FROM k JOIN t ON t.c = k.c - k.c % 20 AND t.i <= h GROUP BY k.c) l ON l.c = k.c),
b AS (SELECT lead.c, t.i AS d, r, x FROM lead JOIN t ON t.c = lead.c - lead.c % 20 AND t.i <= h
  UNION ALL SELECT lead.c, t.i - h + n, r, x FROM lead JOIN t ON t.c = lead.c AND t.i > h),
p AS (SELECT c, d, sha256(string_agg(sha256(length(r) || ':' || r || x), '' ORDER BY e)) AS g, max(w) FILTER (e = d) AS w
  FROM (SELECT a.c, a.d, e.d AS e, e.r, e.x, len(regexp_extract_all(e.x, '[^ 	-
]+')) AS w FROM b a JOIN b e ON a.c = e.c AND e.d <= a.d) GROUP BY c, d
  UNION ALL SELECT c, 0, '', 0 FROM k),
s AS (SELECT c, max(d) AS n FROM p GROUP BY c),
v AS (SELECT g, d, min(p.c) AS conv_id, count(*) AS n_convs, max(s.n) = d AS leaf, (count(*) - 1) * max(w) AS value,
  sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (s.n = d), '')) AS ends_sha256 FROM p JOIN s ON s.c = p.c GROUP BY g, d),
up AS (SELECT v.g, v.d, u.conv_id AS parent_conv_id, u.g AS ug FROM v JOIN p ON p.c = v.conv_id AND p.d = v.d - 1 JOIN v u ON u.g = p.g AND u.d = p.d),
kids AS (SELECT ug AS g, d - 1 AS d, count(*) AS n FROM up GROUP BY ALL),
below AS (SELECT p.g, p.d, count(*) FILTER (u.leaf) AS n_leaves, sum(u.value) AS saved_tokens FROM p JOIN v u ON u.conv_id = p.c AND u.d >= p.d GROUP BY p.g, p.d)
SELECT v.conv_id, v.d AS depth, parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM v JOIN below ON below.g = v.g AND below.d = v.d LEFT JOIN up ON up.g = v.g AND up.d = v.d LEFT JOIN kids ON kids.g = v.g AND kids.d = v.d
"""
