"""Maximal periodic runs of words: every shift (lag) of a text's word numbers is compared with the text itself.

A run is a stretch of successive words with smallest period q whose length is at least max(least_length, least_exponent * q) and
that no neighbouring word extends. Words q apart are equal on a stretch of (length - q) places, so for each lag up to
n / least_exponent the scan looks for true stretches of at least that many places and takes their ends (run-length coding).

Texts are scanned many at a time: words get numbers that differ between texts (by their whole bytes, not by hashes), texts stand in
one array, longest first, and a lag is one comparison of a prefix of the array with itself, shifted. From lag DENSE on, only every
m-th place is compared, m being the least stretch: a stretch of m places holds one of them. Where one hits and its neighbours
do not rule a stretch out, the whole text is run-length coded at that lag. So a text of n words costs about n log n places.

Layout: a text of few lags is scanned where it lies and nothing is shuffled. A longer one is dealt out as rows of (text, range
of lags), lags_per_task each, to all machines; the runs of a text, fewer than its words, meet again at the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import blocks_of, release, word_bounds
from .common import Stash, table

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
DENSE = 8
RUN = "array<struct<start: long, length: long, period: long>>"
PLAN = "n_words long, runs " + RUN + ", collapsed string"


def numbered_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, starts and ends of words, words in each text, and each word's number: equal words of a text, and only these, share it."""
    raw, starts, ends, n = word_bounds(texts)
    size = ends - starts
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    data = raw[np.cumsum(inside[:-1]).astype(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(data)])
    number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(size) else np.zeros(0, np.int64)
    return raw, starts, ends, n, number + (np.repeat(np.arange(len(n), dtype=np.int64), n) << 32)


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Starts and ends of the true stretches of at least least places."""
    edge = np.flatnonzero(~same)
    edge = np.concatenate([[-1], edge, [len(same)]])
    long = np.flatnonzero(np.diff(edge) > least)
    return [(int(edge[k]) + 1, int(edge[k + 1])) for k in long]


def _factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _smallest(words: np.ndarray, q: int) -> bool:
    """No divisor of the period q is a period too (a shorter period of so long a stretch divides it)."""
    return not any((words[: -(q // p)] == words[q // p :]).all() for p in _factors(q))


def find_runs(words: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text at its lags low to high (inclusive), by start, then period. words, n: of all texts."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in n]
    high = np.minimum(high, n // least_exponent)
    order = np.argsort(-high, kind="stable")
    order = order[high[order] >= 1]
    if not len(order):
        return out
    first = np.cumsum(n) - n
    a = np.concatenate([words[first[k] : first[k] + n[k]] for k in order])
    ends = np.cumsum(n[order])
    starts, tops, lows = ends - n[order], high[order], low[order]
    for q in range(int(lows.min()), int(tops[0]) + 1):
        texts = int(np.searchsorted(-tops, -q, side="right"))  # those that have this lag come first
        end = int(ends[texts - 1])
        least = max(least_length, least_exponent * q) - q
        if end - q < least:
            continue
        if q <= DENSE:
            same = a[: end - q] == a[q:end]
            edge = np.concatenate([[-1], np.flatnonzero(~same), [end - q]])
            hits = edge[:-1][np.diff(edge) > least] + 1
        else:
            hits = np.flatnonzero(a[: end - q : least] == a[q:end:least]) * least
            if len(hits):  # of five places or more around a hit, three with it in a row are equal
                at = np.clip(hits[:, None] + np.arange(-2, 3), 0, end - q - 1)
                near = a[at] == a[at + q]
                near &= at == hits[:, None] + np.arange(-2, 3)
                hits = hits[(near[:, 0] & near[:, 1]) | (near[:, 1] & near[:, 3]) | (near[:, 3] & near[:, 4])]
        if not len(hits):
            continue
        for k in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
            if q < lows[k] or q > tops[k]:
                continue
            text = a[starts[k] : ends[k]]
            for s, e in _stretches(text[:-q] == text[q:], least):
                if _smallest(text[s : e + q], q):
                    out[order[k]].append((s, e - s + q, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that some run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        gone[s + q] += 1
        gone[s + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def _rewritten(texts: list[bytes | None], ids: list[int | None]) -> list[bytes | None]:
    """See planted()."""
    from zlib import crc32

    out = []
    for text, key in zip(texts, ids):
        h = crc32(str(key).encode()) if key is not None else 1
        words = text.split() if text and h % 10 == 0 else []  # bytes.split() splits at the six ASCII spaces
        if words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])
        out.append(text)
    return out


def planted(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """texts, where h = crc32 of the decimal id is divisible by 10 with words from a = (h / 10) % n on repeated with the period
    1 + (n - a) / (3 + (h / 10) % 8); joined by one space. Null ids and texts without words stay as they are."""
    names, at = texts.columns, (texts.columns.index(id_col), texts.columns.index(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in blocks_of(batch, at[1]):
                columns = list(part.columns)
                columns[at[1]] = pa.array(_rewritten(raw, part.column(at[0]).to_pylist()), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return texts.mapInArrow(run, texts.schema)


def _row(part: pa.RecordBatch, lengths: np.ndarray, found: list, flat: list[bytes], keep: int) -> pa.RecordBatch:
    first = np.cumsum(lengths) - lengths
    text = [collapsed(flat[s : s + n], r) for s, n, r in zip(first.tolist(), lengths.tolist(), found)]
    listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
    return pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(lengths.astype(np.int64)), listed, pa.array(text, pa.binary()).cast(pa.string())], names=[*part.schema.names[:keep], "n_words", "runs", "collapsed"])


def _words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = raw.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, lags_per_task: int = 2048) -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (array of start, length, period; by start, then period) and collapsed, the text
    without words that a run contains after its first period, joined by one space.

    Words are what stands between ASCII white space. A null or blank text has no words, no runs and an empty collapsed text. Ids may
    be null or repeated: each row is a text of its own. Other columns, whatever their names, are not read. least_exponent is 2 or more.
    """
    if least_exponent < 2 or (least_exponent - 1) * DENSE < 5:
        raise ValueError("least_exponent must be 2 or more")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lags = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) / least_exponent
    kind = rows.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks_of(batch, 1):
                raw, starts, ends, n, number = numbered_words(texts)
                found = find_runs(number, n, np.ones(len(n), np.int64), n, least_length, least_exponent)
                yield _row(part, n, found, _words(raw, starts, ends), 1)
        release()

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks_of(batch, 1):
                _, _, _, n, number = numbered_words(texts)
                found = find_runs(number, n, part.column(2).to_numpy(), part.column(3).to_numpy(), least_length, least_exponent)
                flat = np.array([(k, *r) for k, rs in enumerate(found) for r in rs], np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(flat[:, 0])), *(pa.array(flat[:, c]) for c in (1, 2, 3))], names=["row", "start", "length", "period"])
        release()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks_of(batch, 1):
                raw, starts, ends, n = word_bounds(texts)
                found = [[(r["start"], r["length"], r["period"]) for r in rs or []] for rs in part.column(2).to_pylist()]
                yield _row(part, n, found, _words(raw, starts, ends), 1)
        release()

    short = rows.where(lags <= lags_per_task).mapInArrow(whole, f"id {kind}, {PLAN}")
    stash = Stash(docs.sparkSession, "lags")
    long = stash.put(rows.where(lags > lags_per_task).select("id", "text", F.monotonically_increasing_id().alias("row"), F.floor(lags).cast("long").alias("lags")))
    low = F.explode(F.sequence(F.lit(1).cast("long"), F.col("lags"), F.lit(lags_per_task).cast("long"))).alias("low")
    dealt = long.select("row", "text", low).withColumn("high", F.col("low") + (lags_per_task - 1))
    found = dealt.repartition(F.col("row"), F.col("low")).mapInArrow(ranged, "row long, start long, length long, period long")
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("r"))
    found = found.select(F.col("row").alias("of"), F.expr("transform(r, x -> struct(x.start as start, x.length as length, x.period as period))").alias("runs"))
    long = long.join(found, F.col("row") == F.col("of"), "left").select("id", "text", "runs").mapInArrow(joined, f"id {kind}, {PLAN}")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are rewritten with a period first."""
    out = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("reduce(runs, cast(null as struct<start: long, length: long, period: long>), (b, r) -> if(b is null or r.length > b.length, r, b))")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
