"""Toxic spans and document scores by a linear-chain conditional random field (CRF) over words.

Tags are TOXIC and CLEAN. A word's features are itself and its first 3 to 8 bytes; the field has a weight for each feature, one for each
pair of successive tags, one for TOXIC at a text's start and a bias. Forward-backward gives each word's marginal probability
of TOXIC; stretches of words above one half are the offending spans, and a document's score is a logistic function of the sum of its
words' squared marginals: close to the number of toxic words, and not raised by many words that are hardly toxic each.

Labels are of documents, so labelled tokens come first: for each feature the documents with it are counted by label, and in a
toxic document those words are tagged TOXIC whose most telling feature (log-likelihood ratio G2 of the counts) has a quarter (within) of what
the document's most telling one has; words of documents without the label are CLEAN.

Layout: counting and each step of the training are Spark jobs over a stored, bounded sample of labelled rows; a step's gradients
are summed by partition, and only vectors as long as the list of features reach the driver. Scoring is a scan of whole texts: no shuffle.
Forward and backward run over all texts of a block at once, as products of 2 x 2 matrices in blocks of steps, exactly.

Bounds of the sample, all parameters: max_docs documents of each label (by a hash of the id), none longer than max_chars, one text an
id; max_features features.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .arrays import blocks_of, byte_hashes, mixed, release
from .common import Stash, table

PREFIXES = range(3, 9)
WIDTH = 1 + len(PREFIXES)  # features of a word
STEPS = 64  # of a block of the scans
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    """features: ascending keys; weights: of these; chain: bias, start, and of tags CLEAN-TOXIC, TOXIC-CLEAN, TOXIC-TOXIC; score: offset and slope.

    known is false where the labels have fewer than two kinds; share is then every text's score.
    """

    known: bool
    share: float
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chain: np.ndarray = field(default_factory=lambda: np.zeros(5))
    score: tuple[float, float] = (0.0, 1.0)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def words_in(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, ASCII letters in lower case; starts and ends of words (ASCII letters and bytes of other letters); words in each text."""
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts).lower() + b"\n", np.uint8)
    inside = _LETTER[raw]
    edge = np.flatnonzero(np.concatenate([[False], inside[:-1]]) != inside)
    starts, ends = edge[::2], edge[1::2]
    first = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return raw, starts, ends, np.diff(np.searchsorted(starts, first))


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the features of each distinct word, a row each (0: it is shorter than that prefix), and the row of each word."""
    hashes = byte_hashes(raw, starts, ends)
    _, first, row = np.unique(hashes, return_index=True, return_inverse=True)
    at, size = starts[first], (ends - starts)[first]
    eight = np.ndarray(len(raw), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))[at]
    out = np.zeros((len(first), WIDTH), np.uint64)
    out[:, 0] = mixed(hashes[first] ^ _GOLDEN) | np.uint64(1)
    for k, length in enumerate(PREFIXES, 1):
        part = eight if length == 8 else eight & np.uint64((1 << (8 * length)) - 1)
        out[:, k] = np.where(size > length, mixed(part + np.uint64(length * int(_GOLDEN) % (1 << 64))) | np.uint64(1), 0)
    return out, row


def found(features: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of keys among ascending features; len(features) where there is none such."""
    if not len(features):
        return np.zeros(keys.shape, np.int32)
    at = np.minimum(np.searchsorted(features, keys), len(features) - 1)
    return np.where(features[at] == keys, at, len(features)).astype(np.int32)


def _along(m: np.ndarray) -> np.ndarray:
    """v_t = v_(t-1) m_t, scaled to a sum of 1, from v_0 = (1, 1); m: 4 rows (m00, m01, m10, m11) of one number a step."""
    n = m.shape[1]
    blocks = max(1, -(-n // STEPS))
    padded = np.zeros((4, blocks * STEPS))
    padded[[0, 3]] = 1
    padded[:, :n] = m
    step = np.ascontiguousarray(padded.reshape(4, blocks, STEPS).transpose(2, 0, 1))
    p = np.zeros((4, blocks))
    p[[0, 3]] = 1
    for a, b, c, d in step:
        p = np.stack([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
        p /= p.max(axis=0)
    start, x, y = np.empty((2, blocks)), 0.5, 0.5
    for k, (a, b, c, d) in enumerate(p.T.tolist()):
        start[0, k], start[1, k] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    out = np.empty((STEPS, 2, blocks))
    v = start
    for k, (a, b, c, d) in enumerate(step):
        v = np.stack([v[0] * a + v[1] * c, v[0] * b + v[1] * d])
        v /= v.sum(axis=0)
        out[k] = v
    return out.transpose(1, 2, 0).reshape(2, -1)[:, :n]


def marginals(emission: np.ndarray, n: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of TOXIC of each word, and the expected numbers of (start TOXIC, CLEAN-TOXIC, TOXIC-CLEAN, TOXIC-TOXIC); n: words of each text."""
    size = len(emission)
    if not size:
        return np.zeros(0), np.zeros(4)
    w = np.exp(np.clip(emission + chain[0], -30, 30))
    start, ct, tc, tt = np.exp(np.clip(chain[1:], -30, 30))
    first = np.zeros(size, bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    one = np.ones(size)
    m = np.stack([one, ct * w, np.full(size, tc), tt * w])
    m[:, first] = np.stack([one, start * w, one, start * w])[:, first]
    forward = _along(m)
    back = np.stack([one, np.full(size, tc), ct * w, tt * w])  # transposed
    back[:, first] = 1
    backward = np.full((2, size), 0.5)
    backward[:, :-1] = _along(back[:, :0:-1])[:, ::-1]
    p = forward[1] * backward[1]
    p /= p + forward[0] * backward[0]
    inner = np.flatnonzero(~first)
    f, b, x = forward[:, inner - 1], backward[:, inner], w[inner]
    pair = np.stack([f[0] * b[0], f[0] * ct * x * b[1], f[1] * tc * b[0], f[1] * tt * x * b[1]])
    pair /= pair.sum(axis=0)
    return p, np.array([p[first].sum(), *pair[1:].sum(axis=1)])


def _labelled(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str, text_col: str, label_col: str, max_docs: int, max_chars: int) -> tuple[DataFrame | None, dict[int, int]]:
    """text, toxic (0 or 1) of the sample, and the numbers of learnable ids by label."""
    one = labels.where(F.col(id_col).isNotNull() & learnable & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(sizes) < 2:
        return None, sizes
    limit = F.when(F.col("toxic") == 1, int(min(1.0, max_docs / sizes[1]) * (1 << 30))).otherwise(int(min(1.0, max_docs / sizes[0]) * (1 << 30)))
    ids = one.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) < limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    sample = rows.join(F.broadcast(ids), "id")  # about 2 * max_docs ids
    return sample.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature: how many toxic and other texts of the batch have it."""
    for batch in batches:
        for part, texts in blocks_of(batch, 0):
            raw, starts, ends, n = words_in(texts)
            keys, row = distinct_words(raw, starts, ends)
            of = np.repeat(np.arange(len(n)), n)
            once = np.unique(of * np.int64(len(keys)) + row)
            text, at = once // max(len(keys), 1), once % max(len(keys), 1)
            pairs = np.unique(np.stack([np.repeat(text, WIDTH).astype(np.uint64), keys[at].reshape(-1)], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
            pairs = pairs[pairs[:, 1] > 0]
            key, at = np.unique(pairs[:, 1], return_inverse=True)
            toxic = part.column(1).to_numpy()[pairs[:, 0].astype(np.int64)]
            t = np.bincount(at, toxic, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(t), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64) - t)], names=["key", "toxic", "clean"])
    release()


def _tagger(features: np.ndarray, telling: np.ndarray, within: float):
    """Blocks of the sample: n, row of each word, numbers of the features of each row, tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.append(telling, 0.0)
        for batch in batches:
            for part, texts in blocks_of(batch, 0):
                raw, starts, ends, n = words_in(texts)
                keys, row = distinct_words(raw, starts, ends)
                numbers = found(features, keys)
                value = worth[numbers].max(axis=1)[row] if len(row) else np.zeros(0)
                toxic = np.repeat(part.column(1).to_numpy() == 1, n)
                best = np.zeros(len(n))
                np.maximum.at(best, np.repeat(np.arange(len(n)), n), value)
                tags = toxic & (value > 0) & (value >= within * np.repeat(best, n))
                whole = [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (n, row, numbers.reshape(-1), tags.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(whole, names=["n", "row", "numbers", "tags"])
        release()

    return run


_BLOCK = "n array<int>, row array<int>, numbers array<int>, tags array<int>"


def _gradients(weights: np.ndarray, chain: np.ndarray):
    """Of a partition's blocks: the gradient of the log-likelihood of their tags (features, then chain), one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(weights)
        total, some = np.zeros(size + 6), False
        padded = np.append(weights, 0.0)
        for batch in batches:
            for k in range(batch.num_rows):
                n, row, numbers, tags = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
                numbers = numbers.reshape(-1, WIDTH)
                some = True
                p, expected = marginals(padded[numbers].sum(axis=1)[row], n, chain)
                gap = np.bincount(row, tags - p, len(numbers))
                total[: size + 1] += np.bincount(numbers.reshape(-1), np.repeat(gap, WIDTH), size + 1)
                first = np.zeros(len(row), bool)
                first[(np.cumsum(n) - n)[n > 0]] = True
                inner = np.flatnonzero(~first)
                a, b = tags[inner - 1], tags[inner]
                seen = np.array([tags[first].sum(), ((a == 0) & (b == 1)).sum(), ((a == 1) & (b == 0)).sum(), ((a == 1) & (b == 1)).sum()])
                total[size + 1 :] += [(tags - p).sum(), *(seen - expected)]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.delete(total, size).tolist()], pa.list_(pa.float64()))], names=["gradient"])
        release()

    return run


def _trained(blocks: DataFrame, size: int, steps: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and chain, by steps of Adam on all of the sample; prior: precision of the weights' Gaussian prior."""
    x = np.zeros(size + 5)
    x[size] = -5.0  # most words are clean
    first, second = np.zeros(size + 5), np.zeros(size + 5)
    for step in range(1, steps + 1):
        parts = blocks.mapInArrow(_gradients(x[:size], x[size:]), "gradient array<double>").toArrow()  # a vector for each partition of the sample
        g = sum((v.values.to_numpy() for v in parts.column(0)), np.zeros(size + 5))
        g -= prior * x
        first, second = 0.8 * first + 0.2 * g, 0.95 * second + 0.05 * g * g
        rate = 0.6 * (1 - (step - 1) / steps) + 0.02
        x += rate * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-8)
    return x[:size], x[size:]


def fit(docs: DataFrame, labels: DataFrame, *, learnable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 3000, max_chars: int = 100_000, max_features: int = 20_000, steps: int = 40, prior: float = 0.05, within: float = 0.25) -> Model:
    """Learns from labels (id_col, label_col: 0 or 1) for whose rows learnable holds, and the texts of their ids.

    Labels of null ids and other labels than 0 and 1 are left out; an id with both is toxic. See the module for the sample's bounds.
    """
    stash = Stash(docs.sparkSession, "toxic")
    may = F.coalesce(learnable, F.lit(False)) if learnable is not None else F.lit(True)
    sample, sizes = _labelled(docs, labels, may, id_col, text_col, label_col, max_docs, max_chars)
    total = sum(sizes.values())
    none = Model(False, sizes.get(1, 0) / total if total else 0.0)
    if sample is None:
        return none
    sample = stash.put(sample.repartition(8))
    drawn = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(drawn) < 2:
        return none
    nt, nc = drawn[1], drawn[0]
    counts = sample.mapInArrow(_counted, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a + b >= 3")
    each = lambda x, of: F.col(x) * F.log(F.greatest(F.col(x), F.lit(0.5)) / ((F.col("a") + F.col("b")) * (of / (nt + nc))))
    rest = lambda x, n: (n - F.col(x)) * F.log(F.greatest(n - F.col(x), F.lit(0.5)) / ((nt + nc - F.col("a") - F.col("b") + F.lit(1e-9)) * (n / (nt + nc))))
    g2 = 2 * (each("a", nt) + each("b", nc) + rest("a", nt) + rest("b", nc))
    odds = ((F.col("a") + 0.5) / (nt + 1)) / ((F.col("b") + 0.5) / (nc + 1))
    best = counts.select("key", g2.alias("g2"), odds.alias("odds")).orderBy(F.desc("g2"), "key").limit(max_features).toArrow()
    key = best.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    odds_, g2_ = best.column("odds").to_numpy()[order], best.column("g2").to_numpy()[order]
    features, telling = key[order], np.where((odds_ >= 4) & (g2_ >= 4), g2_, 0.0)
    blocks = stash.put(sample.mapInArrow(_tagger(features, telling, within), _BLOCK))
    weights, chain = _trained(blocks, len(features), steps, prior)
    model = Model(True, nt / (nt + nc), features, weights, chain)
    seen = tagged(sample, model, keep=["toxic"]).select("toxic", "evidence").toArrow()  # two numbers for each document of the sample
    toxic = seen.column("toxic").to_numpy()
    model.score = _logistic(np.log(seen.column("evidence").to_numpy() + 0.02), toxic, np.where(toxic == 1, sizes[1] / nt, sizes[0] / nc))
    stash.clear()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Offset and slope (not negative) of a logistic function, by Newton's steps under a weak prior."""
    a, b = 0.0, 1.0
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        v = weight * p * (1 - p)
        g = np.array([(weight * (y - p)).sum() - 0.01 * a, (weight * (y - p) * x).sum() - 0.1 * (b - 1)])
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], max(0.0, b + step[1])
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("probability", DoubleType())]))
ADDED = ("score", "evidence", "spans")


def _spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: np.ndarray, sizes: list[int], p: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """Stretches of successive words above one half in each text, in characters."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in n]
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return out
    of = np.searchsorted(np.cumsum(n), hit, side="right")
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (np.diff(of) > 0)
    lows = np.flatnonzero(new)
    tops = np.append(lows[1:], len(hit)) - 1
    begins = np.cumsum([0, *(s + 1 for s in sizes)])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
    most = np.maximum.reduceat(p[hit], lows)
    for lo, hi, q in zip(lows.tolist(), tops.tolist(), most.tolist()):
        k = int(of[lo])
        base = chars[begins[k]]
        out[k].append((int(chars[starts[hit[lo]]] - base), int(chars[ends[hit[hi]]] - base), q))
    return out


def tagged(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all but those named like ADDED) with score (0 to 1), evidence (about the number of toxic words) and spans (start, end
    in characters, highest probability) of each row's whole text.

    Null and blank texts have no words: evidence is 0, the score that of a text without toxic words. Under a model that knows
    fewer than two labels every score is its share of toxic labels. Repeated rows get equal results.
    """
    lower = {a.lower() for a in ADDED}
    keep = keep or [c for c in docs.columns if c.lower() not in lower]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*source.schema.fields[:-1], StructField("score", DoubleType()), StructField("evidence", DoubleType()), StructField("spans", SPANS)])
    listed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = np.append(m.weights, 0.0)
        for batch in batches:
            for part, texts in blocks_of(batch, batch.num_columns - 1):
                evidence, score, spans = np.zeros(len(texts)), np.full(len(texts), m.share), [[]] * len(texts)
                if m.known:
                    raw, starts, ends, n = words_in(texts)
                    keys, row = distinct_words(raw, starts, ends)
                    p, _ = marginals(weights[found(m.features, keys)].sum(axis=1)[row], n, m.chain)
                    before = np.concatenate([[0.0], np.cumsum(p * p)])
                    last = np.cumsum(n)
                    evidence = np.maximum(before[last] - before[last - n], 0.0)
                    score = 1 / (1 + np.exp(-np.clip(m.score[0] + m.score[1] * np.log(evidence + 0.02), -30, 30)))
                    spans = _spans(raw, starts, ends, n, [len(t or b"") for t in texts], p)
                spans = pa.array([[{"start": s, "end": e, "probability": q} for s, e, q in x] for x in spans], listed)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array(evidence), spans], names=[*keep, *ADDED])
        release()

    return source.mapInArrow(run, schema)


def held_out() -> Column:
    """A null id is never learnt from, so it counts as held out of nothing: false."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learnable=~held_out())
    out = tagged(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "spans")
