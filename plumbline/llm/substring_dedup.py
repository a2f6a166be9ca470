"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A factor is a stretch of a document's words that also stands elsewhere. Factors of at least `window` words are what counts, so it
is enough to look for them where an anchor recurs: of the 8-word grams in a window the one with the least hash (the first of
equal ones) is its anchor, and equal windows have equal anchors. The reference is every recurring anchor with the words around
it; it is indexed in blocks, by the anchor's hash, and each document's stretches go to all blocks that hold their anchors.

1. A scan counts anchors (summed per part of a batch, then per task, before the shuffle). Those that recur go into a bitmap of
   fixed size, which is broadcast.
2. A second scan sends, for each anchor in the bitmap, the words whose windows have this anchor to its block. There all
   stretches are the reference: the sorted order of their suffixes (by window) is the index, and a suffix's longest match elsewhere
   is beside it. Each stretch is parsed greedily: the longest match is a factor; the next one starts at the first window
   beyond it that has a match. A factor's words and those of its reference are then compared, byte by byte, once from boundary
   to boundary. Where hashes have lied, the whole block is parsed again with windows told apart by their bytes.
3. Anchors that recur more often than a block holds split their windows by longer anchors: grams of 16 words, then the windows
   themselves, each with bitmaps of its own. Stretches of longer anchors go to blocks like others. A window that by itself recurs
   more often than a block holds is dealt to as many blocks as it fills; its first occurrence is the reference in all of them.
   So every factor is found by parsing a bounded block, at every size.
4. Words in spans are removed.

Words of over 64 bytes travel as digests (SHA-256, marked so that no word looks like one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LONG, bitmap, blocks_of, by_key, byte_hashes, in_bitmap, mixed, release, row_key, word_bounds
from .common import Stash, join_hot, table

GRAM = 8
_M = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hashes
_POSITION = 28  # bits of a position in the sliding minimum


def _rolling(w: np.ndarray, size: int, multiplier: np.uint64 = _M) -> np.ndarray:
    """Hash of each stretch of size successive numbers."""
    n = len(w) - size + 1
    out, at = np.zeros(n, np.uint64), 0
    part, width = w.copy(), 1  # part[i]: of width numbers from i
    left = size
    while left:  # by doubling
        if left & 1:
            out = out * multiplier**np.uint64(width) + part[at : at + n] if at else part[:n].copy()
            at += width
        left >>= 1
        if left:
            part = part[:-width] * multiplier**np.uint64(width) + part[width:]
            width *= 2
    return out


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each stretch of size successive numbers."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :])


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Parsed:
    """Words of some texts: their hashes (joined), the texts' first words, and every window's start and anchor."""

    def __init__(self, texts: list[bytes | None], window: int):
        self.raw, self.begin, self.end, self.n = word_bounds(texts)
        self.hash = byte_hashes(self.raw, self.begin, self.end)
        self.first = np.cumsum(self.n) - self.n
        self.window = window
        self.start = np.zeros(0, np.int64)
        if len(self.hash) < window:
            return
        last = np.repeat(self.first + self.n - window, self.n)[: len(self.hash) - window + 1]  # of each word: the last window of its text
        self.start = np.flatnonzero(np.arange(len(last)) <= last)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the hash of its anchor among grams of size words, and where that is."""
        gram = mixed(_rolling(self.hash, size))
        key = (gram >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(gram), dtype=np.uint64)
        at = (_least(key, self.window - size + 1)[self.start] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        return gram[at], at

    def shown(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with a space after each, words of over LONG bytes as digests, and where each word starts."""
        size = self.end - self.begin
        if (size > LONG).any():
            words = [self.raw[b:e].tobytes() for b, e in zip(self.begin.tolist(), self.end.tolist())]
            words = [w if len(w) <= LONG else b"\t" + hashlib.sha256(w).hexdigest().encode() for w in words]
            out = np.frombuffer(b" ".join(words) + b" ", np.uint8)
            size = np.fromiter(map(len, words), np.int64, len(words))
        else:
            out = self.raw[_spans(self.begin, size + 1)]
            out[np.cumsum(size + 1) - 1] = 32
        return out, np.concatenate([[0], np.cumsum(size + 1)])

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1


def _scan(docs: DataFrame, window: int, give, schema: str) -> DataFrame:
    """give(part of a batch, its texts parsed) for all of docs (id, rk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks_of(batch, 2):
                parsed = Parsed(texts, window)
                if len(parsed.start) and (out := give(part, parsed)) is not None:
                    yield out
        release()

    return docs.mapInArrow(run, schema)


class Level:
    """A length of anchors, the bitmap of those that recur, and of those too frequent for a block (None: there are none)."""

    def __init__(self, size: int, bits: Broadcast, hot: Broadcast | None):
        self.size, self.bits, self.hot = size, bits, hot


def _beyond(p: Parsed, levels: list[Level]) -> np.ndarray:
    """The windows whose anchors are too frequent at all levels."""
    left = np.ones(len(p.start), bool)
    for level in levels:
        if not left.any():
            break
        left &= in_bitmap(level.hot.value, p.anchors(level.size)[0])
    return left


def _count_anchors(levels: list[Level], size: int):
    """Anchors of so many words, and their places, of windows that are beyond levels."""

    def give(part: pa.RecordBatch, p: Parsed) -> pa.RecordBatch | None:
        left = _beyond(p, levels)
        if not left.any():
            return None
        a, at = p.anchors(size)
        anchor, n = np.unique(a[left][np.unique(at[left], return_index=True)[1]].view(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    return give


def _stretches(levels: list[Level]):
    """Of each anchor that recurs and isn't too frequent: row, first word in its text, the words."""

    def give(part: pa.RecordBatch, p: Parsed) -> pa.RecordBatch | None:
        left = np.ones(len(p.start), bool)
        key, at = np.zeros(len(p.start), np.uint64), np.zeros(len(p.start), np.int64)
        hit = np.zeros(len(p.start), bool)
        for k, level in enumerate(levels):
            if not left.any():
                break
            a, place = p.anchors(level.size)
            often = in_bitmap(level.hot.value, a) if level.hot else np.zeros(len(a), bool)
            here = left & ~often & in_bitmap(level.bits.value, a)
            key[here], at[here] = a[here] + np.uint64(k), place[here]
            hit |= here
            left &= often
        if not hit.any():
            return None
        start, at, key = p.start[hit], at[hit], key[hit]
        i = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)]))
        begin, end = start[i], np.append(start[i[1:] - 1], start[-1]) + p.window
        shown, place = p.shown()
        size = place[end] - place[begin] - 1
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(shown[_spans(place[begin], size)].tobytes())])
        text = p.text_of(begin)
        row = pa.array(text)
        return pa.RecordBatch.from_arrays([pa.array(key[i].view(np.int64)), part.column(0).take(row), part.column(1).take(row), pa.array(begin - p.first[text]), words], names=["k", "id", "rk", "first", "words"])

    return give


def _windows(levels: list[Level]):
    """The windows beyond all levels: row, first word in its text, the words."""

    def give(part: pa.RecordBatch, p: Parsed) -> pa.RecordBatch | None:
        left = _beyond(p, levels)
        if not left.any():
            return None
        start = p.start[left]
        shown, place = p.shown()
        data = shown.tobytes()
        words = [data[b:e] for b, e in zip(place[start].tolist(), (place[start + p.window] - 1).tolist())]
        text = p.text_of(start)
        row = pa.array(text)
        return pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(start - p.first[text]), pa.array(words, pa.binary())], names=["id", "rk", "first", "words"])

    return give


def _dealt(windows: DataFrame, stash: Stash, most: int) -> DataFrame:
    """Blocks (k, id, rk, first, words) of windows that recur: of each as many as its occurrences fill, and its first one in all of them."""
    windows = stash.put(windows)
    row = F.struct("id", "rk", "first")
    again = windows.groupBy("words").agg(F.count("*").alias("n"), F.min(row).alias("least")).where("n > 1")
    again = stash.put(again.withColumn("blocks", F.ceil(F.col("n") / most)))
    block = F.pmod(F.xxhash64("id", "rk", "first"), F.col("blocks"))
    key = F.xxhash64("words", "block").alias("k")
    rows = join_hot(windows, again.select("words", "n", "blocks"), "words", "n", windows.count()).withColumn("block", block)
    first = again.select("words", "blocks", "least.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).where(F.col("block") != block)
    return rows.select(key, "id", "rk", "first", "words").unionByName(first.select(key, "id", "rk", "first", "words"))


def longest_matches(x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and place of the longest match elsewhere of each suffix of some stretches; end: where each place's stretch ends."""
    m = len(x)
    place = np.arange(m)
    ranks, width = [x], 1  # ranks[k]: equal where 2^k elements from there are
    while m and width < int((end - place).max()):
        after = np.zeros(m, np.int64)
        on = place + width < end
        after[on] = ranks[-1][place[on] + width] + 1
        ranks.append(np.unique(ranks[-1] * (m + 2) + after, return_inverse=True)[1])
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + common, b + common
        on = (i + (1 << k) <= end[a]) & (j + (1 << k) <= end[b])
        on[on] = ranks[k][i[on]] == ranks[k][j[on]]
        common[on] += 1 << k
    length, where = np.zeros(m, np.int64), np.full(m, -1)
    length[b], where[b] = common, a
    longer = common > length[a]
    length[a[longer]], where[a[longer]] = common[longer], b[longer]
    return length, where


def parse_block(t: pa.Table, window: int, by_bytes: bool = False) -> pa.RecordBatch | None:
    """Factors of a block's stretches (whole groups of one anchor) against each other, as spans of their rows' words."""
    packed = t.column("words").combine_chunks()
    data = b" ".join(packed.to_pylist()) + b" "
    raw = np.frombuffer(data, np.uint8)
    close = np.flatnonzero(raw == 32)
    place = np.concatenate([[0], close + 1])  # of each word
    size = np.diff(np.searchsorted(close, np.cumsum(pc.binary_length(packed).to_numpy().astype(np.int64) + 1) - 1, side="right"), prepend=0)
    n = size - window + 1  # windows of each stretch
    of = np.repeat(np.arange(len(size)), n)
    at = _spans(np.cumsum(size) - size, n)  # the first word of each window
    if by_bytes:
        ids: dict[bytes, int] = {}
        h = np.array([ids.setdefault(data[b:e], len(ids)) for b, e in zip(place[at].tolist(), (place[at + window] - 1).tolist())], np.uint64)
    else:
        h = mixed(_rolling(byte_hashes(raw, place[:-1], close), window))[at]
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(new) - 1
    hit = np.flatnonzero(np.bincount(kind)[kind] > 1)
    if not len(hit):
        return None
    begins = np.concatenate([[True], (of[hit[1:]] != of[hit[:-1]]) | (at[hit[1:]] != at[hit[:-1]] + 1)])
    end = np.append(np.flatnonzero(begins)[1:], len(hit))[np.cumsum(begins) - 1]  # of the run of such windows
    length, where = longest_matches(np.unique(kind[hit], return_inverse=True)[1], end)
    factors = []
    length_of, end_of, p = length.tolist(), end.tolist(), 0
    while p < len(hit):  # greedily; the next factor starts at the first window not inside this one
        factors.append(p)
        p += length_of[p]
    f = np.array(factors)
    begin, other, words = at[hit[f]], at[hit[where[f]]], length[f] + window - 1
    for a, b, c, d in zip(place[begin].tolist(), place[begin + words].tolist(), place[other].tolist(), place[other + words].tolist()):
        if data[a:b] != data[c:d]:
            return parse_block(t, window, by_bytes=True)
    row = of[hit[f]]
    first = t.column("first").to_numpy()[row] + begin - (np.cumsum(size) - size)[row]
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(rows), t.column("rk").combine_chunks().take(rows), pa.array(first), pa.array(first + words)], names=["id", "rk", "begin", "end"])


def spans(docs: DataFrame, *, window: int = 35, most_in_block: int = 32_768) -> DataFrame:
    """id, rk, begin, end (words) of factors of at least window words, of docs (id long, rk long, text); they may overlap.

    most_in_block bounds a group of stretches in one task.
    """
    stash = Stash(docs.sparkSession, "factors")
    sc = docs.sparkSession.sparkContext
    levels: list[Level] = []
    for size in sorted({GRAM, min(2 * GRAM, window), window}):
        anchors = _scan(docs, window, _count_anchors(list(levels), size), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
        anchors = stash.put(anchors.where("n > 1"))
        often = anchors.where(F.col("n") > most_in_block)
        r = anchors.agg(F.count("*").alias("k"), F.count_if(F.col("n") > most_in_block).alias("often")).first()
        hot = sc.broadcast(bitmap(often, "anchor", r["often"])) if r["often"] else None
        levels.append(Level(size, sc.broadcast(bitmap(anchors, "anchor", r["k"])), hot))
        if not hot:
            break
    sent = _scan(docs, window, _stretches(levels), "k long, id long, rk long, first long, words binary")
    if levels[-1].hot:
        sent = sent.unionByName(_dealt(_scan(docs, window, _windows(levels), "id long, rk long, first long, words binary"), stash, most_in_block))
    return by_key(sent, lambda t: parse_block(t, window), "id long, rk long, begin long, end long", least_rows=5_000)


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **options) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_text (its kept words joined by one space).

    Removed is each word covered by a window of so many words whose sequence also starts anywhere else, in the same row or another.
    A null or blank text has no words. Rows repeated are copies of each other, and so lose what is in such windows. Null ids are
    ids like others. Further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("rk"), F.col(text_col).alias("text"))
    cut = spans(rows, window=window, **options).groupBy("id", "rk").agg(F.collect_set(F.struct("begin", "end")).alias("cut"))
    cut = cut.select(F.col("id").alias("i"), F.col("rk").alias("r"), F.col("cut.begin").alias("begin"), F.col("cut.end").alias("end"))
    joined = rows.join(cut, F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")), "left").select("id", "text", "begin", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks_of(batch, 1):
                n, gone, kept = [], [], []
                for text, begin, end in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                    words = text.split() if text else []
                    n.append(len(words))
                    if begin:
                        level = np.zeros(len(words) + 1, np.int64)
                        np.add.at(level, begin, 1)
                        np.add.at(level, end, -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(level)[:-1] == 0)]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d),
windows AS (SELECT s.r, s.i, array_to_string(d.w[s.i : s.i + 34], ' ') AS t FROM starts s JOIN d USING (r)),
again AS (SELECT r, i FROM windows WHERE t IN (SELECT t FROM windows GROUP BY t HAVING count(*) > 1)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT words.r, word, words.i, coalesce(max(CASE WHEN again.i IS NOT NULL THEN 1 END) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
           FROM words LEFT JOIN again ON again.r = words.r AND again.i = words.i),
kept AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
