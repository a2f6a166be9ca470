"""Language identification by prediction by partial matching (PPM).

For each language, a tree of byte contexts up to three bytes long holds the counts of what follows each context. A
byte's code length is found at the longest context seen in training; a byte not seen there costs an escape (its
probability: distinct followers / (followers + distinct followers)) and is coded at the next shorter context among
the bytes not excluded, down to a uniform code. The statistics are frozen: scoring changes nothing. A text's language
is the one whose tree gives the shortest code for all its bytes.

All 256 bytes keep their identity. The trees are kept as sorted tables: code lengths of what was seen after a context, in each
language, and each context's cost of going on to the next shorter one. What no language has seen there costs the sum of both, so
the tables grow with what was seen, not with the contexts or languages possible; a batch of whole texts is scored by lookups.

Training counts symbols where the text lies: executors count, the counts are summed by key, and only they (not texts)
reach the driver. The classifier is fitted on a bounded sample: about max_docs_per_lang labelled documents of each
language, chosen by a hash of id and text (so copies of a text are drawn one by one), none longer than max_chars.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .arrays import release
from .common import table

ORDER = 3
BITS = 9  # a symbol in a code: 0 before a text, or a byte + 1
UNIFORM_BITS = 8.0  # a byte in a uniform code
_BYTES = np.arange(1, 257, dtype=np.uint16)
UNDETERMINED = "und"
ADDED = ("lang_pred", "score", "bits_per_byte")


@cache
def letter_in():
    """Finds a letter (Unicode's L categories; number characters are none)."""
    import regex

    return regex.compile(r"\p{L}").search


@dataclass
class Model:
    """langs, and per language the (code, count) arrays of ORDER + 1 successive symbols."""

    langs: list[str]
    counts: list[tuple[np.ndarray, np.ndarray]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells models apart in workers that outlive one


def _spread(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each byte of the joined texts, the code of its ORDER predecessors and itself; symbol 0 before a text."""
    s = _BYTES[raw].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    code = s.copy()
    for back in range(1, ORDER + 1):
        prev = np.zeros_like(s)
        prev[back:] = s[:-back] if back < len(s) else 0
        for k in range(back):  # positions nearer than back to their text's start have nothing there
            at = starts[lengths > k] + k
            prev[at] = 0
        code |= prev << np.int64(BITS * back)
    return code


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def _found(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of some numbers is in ascending keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, of), max(len(keys) - 1, 0))
    return at, keys[at] == of if len(keys) else np.zeros(len(of), bool)


class Trees:
    """Code lengths of all bytes after all contexts, in each language: PPM with exclusion. counts: as those of a Model."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = len(counts)
        self.codes: list[np.ndarray] = []  # by order: context and byte, ascending
        self.bits: list[np.ndarray] = []  # of these, in each language
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []  # bits from a context to the next shorter one; 0 where a language has not seen it
        for order in range(ORDER + 1):
            cut = [c & ((1 << BITS * (order + 1)) - 1) for c, _ in counts]
            codes = np.unique(np.concatenate([*cut, np.zeros(0, np.int64)]))
            contexts, of = np.unique(codes >> BITS, return_inverse=True)
            lower = self._look(codes, order - 1)
            bits, escape = np.empty(lower.shape), np.zeros((len(contexts), self.langs))
            for k, (_, n) in enumerate(counts):
                c = np.bincount(np.searchsorted(codes, cut[k]), n, len(codes))
                seen = c > 0
                total, kinds = np.bincount(of, c, len(contexts)), np.bincount(of, seen, len(contexts))
                room = 1 - np.bincount(of, np.where(seen, np.exp2(-lower[:, k].astype(np.float64)), 0), len(contexts))
                kinds[kinds == 256] = 0  # nowhere to escape to
                out = np.divide(kinds, total + kinds, out=np.ones(len(contexts)), where=total > 0)
                some = (total > 0) & (kinds > 0)
                escape[some, k] = np.log2(np.maximum(room[some], 1e-12)) - np.log2(out[some])
                bits[:, k] = escape[of, k] + lower[:, k]
                bits[seen, k] = np.log2((total + kinds)[of[seen]]) - np.log2(c[seen])
            self.codes.append(codes)
            self.bits.append(bits.astype(np.float32))
            self.contexts.append(contexts)
            self.escape.append(escape.astype(np.float32))

    def _look(self, codes: np.ndarray, order: int) -> np.ndarray:
        if order < 0:
            return np.full((len(codes), self.langs), UNIFORM_BITS, np.float32)
        codes = codes & ((1 << BITS * (order + 1)) - 1)
        at, there = _found(self.codes[order], codes)
        out = self.bits[order][at] if len(self.codes[order]) else np.zeros((len(codes), self.langs), np.float32)
        if not there.all():
            rest = codes[~there]
            less = self._look(rest, order - 1)
            at, known = _found(self.contexts[order], rest >> BITS)
            less[known] += self.escape[order][at[known]]
            out[~there] = less
        return out

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code, a column for each language."""
        return self._look(codes, ORDER)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", learnable: Column | None = None, max_docs_per_lang: int = 4000, max_chars: int = 100_000, id_col: str = "doc_id") -> Model:
    """Learns from rows with a text and a language for which learnable holds.

    max_docs_per_lang bounds the sample: where a language has more rows, those with the smallest hashes of id (if docs has id_col) and text
    are taken, about so many; rows equal in both come together. Longer texts than max_chars are not learnt from. Without any such row the
    model knows no language.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= max_chars))
    key = [F.col(id_col)] if id_col in docs.columns else []
    if learnable is not None:
        rows = rows.where(F.coalesce(learnable, F.lit(False)))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(*key, F.col(text_col), F.lit(17)), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, max_docs_per_lang / sizes[k]) * (1 << 30)))])
    sample = rows.where(F.col("h") < limit[F.col("lang")]).select("lang", "text")

    def contexts_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for k in sorted(set(lang)):
                raw, lengths = _joined(batch.column(1).take(pa.array(np.flatnonzero(lang == k))).to_pylist())
                codes, n = np.unique(_spread(raw, lengths), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    counted = sample.mapInArrow(contexts_in, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()  # a row for each context seen in the sample
    lang, code, n = np.array(counted.column("lang").to_pylist(), object), counted.column("code").to_numpy(), counted.column("n").to_numpy().astype(np.float32)
    by = {k: (code[lang == k], n[lang == k]) for k in langs}
    return Model(langs, [by.get(k, (np.zeros(0, np.int64), np.zeros(0, np.float32))) for k in langs])


_trees: dict[str, Trees] = {}  # of this Python worker: a model is unfolded once


def unfolded(model: Model) -> Trees:
    if model.key not in _trees:
        _trees.clear()
        _trees[model.key] = Trees(model.counts)
    return _trees[model.key]


def score_texts(texts: list[str | None], model: Model, trees: Trees) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits a byte of each text."""
    n = len(texts)
    lang, score, rate = [UNDETERMINED] * n, [0.0] * n, [0.0] * n
    if not model.langs:
        return lang, score, rate
    block: list[int] = []
    size = 0

    def flush() -> None:
        raw, lengths = _joined([texts[i] for i in block])
        code = _spread(raw, lengths)
        starts = np.cumsum(lengths) - lengths
        per = np.add.reduceat(trees.lengths(code), starts, axis=0, dtype=np.float64)
        best = per.argmin(axis=1)
        for i, b, each, length in zip(block, best, per, lengths):
            gap = (each - each[b]) / length  # bits a byte that other languages' trees need beyond the best
            lang[i], rate[i] = model.langs[b], each[b] / length
            score[i] = float(1 / np.exp2(-gap * 16).sum())  # posterior for a text of 16 such bytes
        block.clear()

    letter = letter_in()
    for i, t in enumerate(texts):
        if t and letter(t):
            block.append(i)
            size += len(t)
            if size > 500_000:
                flush()
                size = 0
    if block:
        flush()
    return lang, score, rate


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all but those named so, in any case) with lang_pred, score (0 to 1) and bits_per_byte of each row's whole text.

    A null text, one without letters, and any text under a model that knows no language get "und", score 0. Equal
    code lengths go to the language first by code point. Repeated rows get equal results.
    """
    keep = keep or [c for c in docs.columns if c.lower() not in ADDED]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*source.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = unfolded(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lang, score, rate = score_texts(part.column(part.num_columns - 1).to_pylist(), shared.value, trees)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*keep, "lang_pred", "score", "bits_per_byte"])
        release()

    return source.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable=~held_out())
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
