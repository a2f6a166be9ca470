"""Fuzzy line deduplication.

Lines are normalised (lower case, digits as 0, other ASCII but letters as spaces, one space between words) and get a SimHash of their
words. Two lines whose fingerprints differ in at most three bits agree in one of four blocks of 16 bits, in two of five, in three of
six: lines are joined on one, two or three blocks at a time, compared, and then verified: an edit similarity, 1 - distance / length of
the longer, of at least 0.8. Of each connected group the first occurrence, by id and place, is kept, and the others are removed
from their texts. The number of blocks follows the number of distinct lines, so that a key (16, 25 or 32 bits) has some hundred lines at
most on average and comparisons grow in proportion; the pairs found are the same.

The scan sends digests (128 bits, BLAKE2), not lines. Equal normalised lines are one row from then on. Lines with a near fingerprint go
into a bitmap of fixed size, which is broadcast; only those lines' texts are sent, in a second scan, to the blocks where they are
verified: a bound from below, found for many pairs at once, refuses unlike lines, a bound from their words accepts most like ones, and
the exact distance decides the rest. Within a block, pairs already connected are not verified again, so a large group costs a forest, not all its pairs.
Crowded blocks are split into tiles, whose pairs are compared in tasks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import bitmap, by_key, byte_hashes, in_bitmap, release, row_key, runs, text_parts, votes
from .common import Stash, join_hot, table, with_least
from .components import components

NEAR, SIMILAR = 3, 0.8
_FOLD = bytes(10 if c == 10 else 48 if 48 <= c < 58 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower case, digits as 0, other ASCII but letters and line feeds as spaces."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def normal_line(line: str) -> str:
    """"" for a line without words: such lines are never removed."""
    return b" ".join(folded(line.replace("\n", " ")).split()).decode("utf-8", "surrogatepass")


class Lines:
    """The lines with words of some texts: text, place, normal form, words' hashes and numbers."""

    def __init__(self, texts: list[str | None]):
        parts = [folded(t or "") for t in texts]
        self.raw = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(self.raw, np.uint8)
        space = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(np.concatenate([[True], space[:-1]]) != space)
        starts, ends = edge[::2], edge[1::2]
        self.bounds = raw, starts, ends
        feed = np.flatnonzero(raw == 10)
        line = np.searchsorted(feed, starts)  # of each word
        first, last = runs(line)
        self.line = line[first] if len(line) else line
        self.sizes = last - first
        data = self.raw
        self.normal = [b" ".join(data[b:e].split()) for b, e in zip(np.concatenate([[0], feed[:-1] + 1])[self.line].tolist(), feed[self.line].tolist())]
        counts = np.cumsum([0, *(p.count(b"\n") + 1 for p in parts)])
        self.text = np.searchsorted(counts, self.line, side="right") - 1
        self.place = self.line - counts[self.text]

    def fingerprints(self) -> np.ndarray:
        return votes(byte_hashes(*self.bounds), self.sizes).view(np.int64)

    def digests(self) -> list[bytes]:
        digest = hashlib.blake2b
        return [digest(x, digest_size=16).digest() for x in self.normal]


def distance_at_most(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of a and b is at most most: bit-parallel, on what equal ends leave."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    n, k = n - k, 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return max(len(a), len(b)) <= most
    if max(len(a), len(b)) <= most:
        return True
    # columns of the distance table as vectors of differences, one bit a row
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for j, c in enumerate(b, 1):
        eq = where.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1 | 1) & full
        up = (minus << 1 | ~(diagonal | plus)) & full
        down = plus & diagonal
        if score - (len(b) - j) > most:
            return False
    return score <= most


def distance_bound(a: list[str], b: list[str], ahead: int = 6) -> int:
    """No less than the edit distance of two lines of words: words that differ are replaced up to where both go on alike soon after."""
    m, n, i, j, bound = len(a), len(b), 0, 0, 0
    length = lambda words: sum(map(len, words)) + len(words)
    while i < m and j < n:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        skip = next(((p, s - p) for s in range(1, 2 * ahead) for p in range(max(0, s - ahead), min(s, ahead) + 1) if a[i + p : i + p + 2] == b[j + s - p : j + s - p + 2] != []), None)
        if skip is None:
            break
        p, q = skip
        bound += max(length(a[i : i + p]), length(b[j : j + q]))
        i += p
        j += q
    return bound + max(length(a[i:]), length(b[j:]))


def most_edits(size: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """The most edits between two similar texts of which the longer has this size."""
    return np.floor((1 - least) * size + 1e-9).astype(np.int64)


def similar(a: str, b: str, least: float = SIMILAR) -> bool:
    most = int(most_edits(np.int64(max(len(a), len(b))), least))
    if abs(len(a) - len(b)) > most:
        return False
    return distance_bound(a.split(" "), b.split(" ")) <= most or distance_at_most(a, b, most)


SEGMENT = 64
SEARCHED = 5 / 8  # of a line's segments; the others could only raise the bound, and unlike lines exceed it by these


def distances_from_below(codes: np.ndarray, first: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A number for each pair of texts (i, j); above most only if the edit distance of the two is above most.

    codes: the texts' characters, as numbers below 64 (characters that share one only make the distance look smaller); text x is
    codes[first[x] : first[x] + size[x]]. Text i is cut into segments of 64 characters. If the distance is at most most, each segment
    goes to a stretch of text j that is shifted by no more than (most + difference of the sizes) / 2, and the costs of the segments
    add up to no more than the distance: so the first segments are searched for, each in its window, those of all pairs at once.
    """
    parts = np.ceil(size[i] / SEGMENT * SEARCHED).astype(np.int64)
    pair = np.repeat(np.arange(len(i)), parts)
    begin = SEGMENT * (np.arange(len(pair)) - np.repeat(np.cumsum(parts) - parts, parts))
    length = np.minimum(SEGMENT, size[i][pair] - begin)
    more, limit = (size[j] - size[i])[pair], most[pair]
    start = np.maximum(0, begin + (more - limit) // 2)
    width = np.maximum(0, np.minimum(size[j][pair], begin + length + (more + limit + 1) // 2) - start)
    order = np.argsort(-width, kind="stable")  # segments with wide windows first: those still searched are always the first ones
    pair, length, width = pair[order], length[order], width[order]
    source, at = first[i][pair] + begin[order], first[j][pair] + start[order]
    where = np.zeros((len(pair), 64), np.uint64)
    for bit in range(SEGMENT):
        on = np.flatnonzero(length > bit)
        where[on, codes[source[on] + bit]] |= np.uint64(1 << bit)
    where, row = where.reshape(-1), 64 * np.arange(len(pair))
    one, top = np.uint64(1), (length - 1).astype(np.uint64)
    up, down = np.full(len(pair), ~np.uint64(0)), np.zeros(len(pair), np.uint64)
    score, best = length.copy(), length.copy()
    for c, n in enumerate(np.searchsorted(-width, -np.arange(width.max(initial=0))).tolist()):
        eq = where[row[:n] + codes[at[:n] + c]]
        u, d = up[:n], down[:n]
        diagonal = (((eq & u) + u) ^ u) | eq
        eq |= d
        plus, minus = d | ~(diagonal | u), u & diagonal
        score[:n] += ((plus >> top[:n]) & one).view(np.int64) - ((minus >> top[:n]) & one).view(np.int64)
        plus <<= one
        minus <<= one
        up[:n], down[:n] = minus | ~(eq | plus), plus & eq
        np.minimum(best[:n], score[:n], out=best[:n])
    return np.bincount(pair, weights=best, minlength=len(i)).astype(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_parts(batch, 2):
            x = Lines(texts)
            row = pa.array(x.text)
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(x.place.astype(np.int32)), pa.array(x.digests(), pa.binary()), pa.array(x.fingerprints())], names=["id", "rk", "place", "line", "fp"])
    release()


class Keys:
    """The keys of a fingerprint: for each choice of all blocks but NEAR, its number and the bits of these blocks."""

    def __init__(self, blocks: int):
        cuts = [64 * k // blocks for k in range(blocks + 1)]
        self.chosen = list(combinations([(a, b - a) for a, b in zip(cuts, cuts[1:])], blocks - NEAR))
        self.masks = [sum(((1 << n) - 1) << at for at, n in blocks_) for blocks_ in self.chosen]
        self.width = max(sum(n for _, n in blocks_) for blocks_ in self.chosen)
        self.bits = self.width + (len(self.chosen) - 1).bit_length()  # of a key; what is left of 62 is for the numbers of two tiles

    def column(self) -> str:
        """SQL of the array of keys of column fp."""
        keys = []
        for number, blocks_ in enumerate(self.chosen):
            at, parts = 0, [f"{number << self.width}L"]
            for first, n in blocks_:
                parts.append(f"shiftleft(shiftrightunsigned(fp, {first}) & {(1 << n) - 1}L, {at})")
                at += n
            keys.append(" + ".join(parts))
        return f"array({', '.join(keys)})"

    @staticmethod
    def of(lines: int) -> "Keys":
        return Keys(4 if lines < 1 << 23 else 5 if lines < 1 << 32 else 6)


def _dealt(rows: DataFrame, keys: Keys, tile: int) -> DataFrame:
    """rows (node, fp, ...) by block key, as k, own (the row's place in a pair of tiles) and same (the pair is one tile twice).

    A key with more than tile rows is split into tiles, and each pair of its tiles is a group of its own: so no task holds more
    than two tiles. Keys of 16 bits are few (4 x 65,536), so the table of their sizes is broadcast, and keys of one row go.
    """
    keyed = rows.withColumn("b", F.explode(F.expr(keys.column())))
    sizes = rows.select(F.explode(F.expr(keys.column())).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    tiles = F.ceil(F.col("n") / tile).cast("int").alias("tiles")
    if keys.width == 16:
        out = keyed.join(F.broadcast(sizes.where("n > 1").select("b", tiles)), "b")
    else:
        out = keyed.join(sizes.where(F.col("n") > tile).select("b", tiles), "b", "left").fillna(1, ["tiles"])
    out = out.withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    out = out.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    half = (62 - keys.bits) // 2
    k = F.col("b") + F.shiftleft(F.least("t", "o").cast("long"), keys.bits) + F.shiftleft(F.greatest("t", "o").cast("long"), keys.bits + half)
    return out.select(k.alias("k"), (F.col("t") <= F.col("o")).alias("own"), (F.col("t") == F.col("o")).alias("same"), *rows.columns)


def _near_pairs(fp: np.ndarray, own: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one group within NEAR bits: any two of a tile, or one of either tile."""
    left, right = (np.arange(len(fp)),) * 2 if same else (np.flatnonzero(own), np.flatnonzero(~own))
    step = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(fp[left[at : at + step], None] ^ fp[None, right]) <= NEAR)
        i, j = left[at + i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j


def _pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the table's groups within NEAR bits."""
    k, own, same = (t.column(c).to_numpy() for c in ("k", "own", "same"))
    fp = t.column("fp").to_numpy().view(np.uint64)
    starts, ends = runs(k)
    few = np.repeat(same[starts] & (ends - starts <= 512), ends - starts)
    end = np.repeat(ends, ends - starts)
    at = np.flatnonzero(few)
    for back in range(1, 512):  # small groups, all at once
        at = at[at + back < end[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + back]) <= NEAR]
        yield hit, hit + back
    for s, e in zip(starts, ends):
        if not few[s]:
            for i, j in _near_pairs(fp[s:e], own[s:e], bool(same[s])):
                yield s + i, s + j


def _near_lines(t: pa.Table) -> pa.RecordBatch | None:
    """Lines that have another within NEAR bits in their block."""
    near = np.zeros(t.num_rows, bool)
    for i, j in _pairs(t):
        near[i] = True
        near[j] = True
    if not near.any():
        return None
    nodes, at = np.unique(t.column("node").to_numpy()[near], return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(t.column("fp").to_numpy()[near][at])], names=["node", "fp"])


def _verified(t: pa.Table, keys: Keys) -> pa.RecordBatch | None:
    """Links of a forest of the similar pairs in the table's groups."""
    number = (t.column("k").to_numpy() & ((1 << keys.bits) - 1)) >> keys.width
    fp, node, texts = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_pylist(), t.column("text").to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    first = np.cumsum(size) - size
    codes = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & 63).astype(np.uint8)
    links: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        i, j = (x[np.argsort(size[i], kind="stable")] for x in (i, j))
        for s, e in zip(*runs(np.cumsum(-(-size[i] // SEGMENT)) // 8192)):
            x, y = i[s:e], j[s:e]
            apart = [find(node[a]) != find(node[b]) for a, b in zip(x.tolist(), y.tolist())]
            x, y = x[apart], y[apart]
            limit = most_edits(np.maximum(size[x], size[y]))
            left = distances_from_below(codes, first, size, x, y, limit) <= limit
            for p, q in zip(x[left].tolist(), y[left].tolist()):
                a, b = find(node[p]), find(node[q])
                if a != b and similar(texts[p], texts[q]):
                    root[b] = a
                    links.append((a, b))

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for i, j in _pairs(t):
        differ = fp[i] ^ fp[j]
        stays = np.abs(size[i] - size[j]) <= most_edits(np.maximum(size[i], size[j]))
        for c, mask in enumerate(keys.masks[:-1]):  # a pair that agrees in an earlier choice of blocks is verified there
            stays &= (number[i] <= c) | (differ & np.uint64(mask) != 0)
        held.append((i[stays], j[stays]))
        n += int(stays.sum())
        if n >= 4096:
            verify(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if n:
        verify(*(np.concatenate(x) for x in zip(*held)))
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"]) if links else None


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tile: int = 4096, keys: Keys | None = None) -> DataFrame:
    """All columns of docs (but those named so), its text without the removed lines, and n_lines, n_removed (longs).

    Lines are split at line feeds. Lines without words (nothing but ASCII punctuation and white space) stay, as do null and empty texts (n_lines: 0 and 1; an
    empty text is an empty line). A text all of whose lines are removed becomes empty. Rows repeated, with equal id
    and text, have the same lines kept and removed. Null ids come after all others in the order of occurrences.
    """
    stash = Stash(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("rk"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    seen = stash.put(rows.select("id", "rk", "text").mapInArrow(_hashed, "id long, rk long, place int, line binary, fp long"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "rk", "place")
    one = seen.groupBy("line").agg(F.min("fp").alias("fp"), F.count("*").alias("n"))
    one = stash.put(one.withColumn("node", F.monotonically_increasing_id()))  # numbers that stay, as they are stored
    keys = keys or Keys.of(one.count())
    near = by_key(_dealt(one.select("node", "fp"), keys, tile), _near_lines, "node long, fp long").dropDuplicates(["node"])
    near = stash.put(near.join(one.select("node", "line"), "node"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(near.select(F.xxhash64("line").alias("h")), "h", near.count()))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for _, texts in text_parts(batch, 0):
                x = Lines(texts)
                at = {line: k for k, line in enumerate(x.digests())}
                hashes = np.fromiter((xxhash.xxh64_intdigest(line, 42) for line in at), np.uint64, len(at))
                there = in_bitmap(bits.value, hashes).tolist()
                lines, at = zip(*((line, k) for (line, k), yes in zip(at.items(), there) if yes)) if any(there) else ((), ())
                if lines:
                    normal = [x.normal[k].decode("utf-8", "surrogatepass") for k in at]
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array(normal, pa.string())], names=["line", "text"])
        release()

    texts = rows.select("text").mapInArrow(wanted, "line binary, text string").dropDuplicates(["line"])
    texts = stash.put(texts.join(near, "line").select("node", "fp", "text"))
    links = by_key(_dealt(texts, keys, tile), lambda t: _verified(t, keys), "a long, b long", least_rows=2_000)
    parts = components(links, stash)
    group = one.join(parts, "node", "left").where("n > 1 or component is not null")
    group = stash.put(group.select("line", "n", F.coalesce("component", "node").alias("component")))
    again = stash.put(join_hot(seen.select("id", "rk", "place", "line"), group, "line", "n", seen.count()).select("id", "rk", "place", "component"))
    gone = with_least(again, "component", order, "keeper", again.count()).where(~order.eqNullSafe(F.col("keeper"))).groupBy("id", "rk").agg(F.collect_set("place").alias("gone"))
    gone = gone.select(F.col("id").alias("of_id"), F.col("rk").alias("of_rk"), "gone")
    joined = rows.select("id", "rk", "row").join(gone, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("rk") == F.col("of_rk")), "left")
    old = F.col("row").getField(text_col)
    lines = F.coalesce(F.length(old) - F.length(F.replace(old, F.lit("\n"))) + 1, F.lit(0)).cast("long")
    # split once: the outer transform binds the lines and the places that stay
    cut = F.array(F.struct(F.split(old, "\n").alias("l"), F.array_except(F.sequence(F.lit(0), lines.cast("int") - 1), F.col("gone")).alias("stay")))
    kept = F.transform(cut, lambda x: F.array_join(F.transform(x["stay"], lambda i: F.get(x["l"], i)), "\n"))[0]
    text = F.when(F.col("gone").isNull(), old).otherwise(kept)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    columns = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in names]
    return joined.select(*columns, lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text")
