"""Packing by hierarchical tiers of context size.

Documents are tokenised, an end id is added, and each is routed: whole windows of the longest tier go straight to
sequences of their own; the rest of it goes to the shortest tier that holds it. Then every tier is packed, the longest first: its
largest rest opens a window of the tier's size, and the gap is filled from the shorter tiers, largest fitting rest first; only where none
fits is one cut to fill the gap exactly, and what is left of it is routed anew. So windows of every tier are full. What cannot fill a
window waits for more documents; at the end of a task it is cut to windows of the tiers that it still fills, and less than the
shortest tier is padded to the longest. So each task pads one sequence at most.

Step groups hold sequences of one tier and of equal token count. The last two of a tier in a task share what they have
evenly, so that none is short by more than half.

All this happens while the table is scanned: no shuffle, and at most the rests of one batch in memory. Sequence ids
hold the number of the partition, so they are unique, and equal when a lost task runs again.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import release, text_parts
from .common import table, tokenizer_path
from .units import PRE_TOKEN, find_units, starts_with_space

TIERS = (1024, 512, 256, 128, 64)
END_ID = 0
OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def byte_ranks(tokenizer_json: str) -> dict[bytes, int] | None:
    """Ids of a byte-level BPE's pieces by their bytes, if ids are in the order of merges and nothing else is configured; else None."""
    t = json.loads(tokenizer_json)
    model, before = t["model"], t["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and t["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # bytes that print stand for themselves in such files, the others, in order, for code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    ranks = {bytes(byte_of[c] for c in piece): n for piece, n in model["vocab"].items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    singles = sum(len(p) == 1 for p in ranks)
    in_order = all(model["vocab"].get(a + b) == singles + k for k, (a, b) in enumerate(merges))
    return ranks if singles == 256 and in_order and len(ranks) == 256 + len(merges) else None


def added_ids(tokenizer_json: str) -> dict[str, int] | None:
    """The ids of added tokens, which are cut out of a text before all else; None if some take white space or word ends along."""
    added = json.loads(tokenizer_json)["added_tokens"]
    if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in added):
        return None
    return {x["content"]: x["id"] for x in added}


class WholeIds:
    """Ids of whole texts by the tokenizer file's own library, as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_str(tokenizer_json).encode

    def of(self, texts: list[str | None]) -> list[bytes]:
        return [np.array(self.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if t else b"" for t in texts]


class UnitIds(dict):
    """unit: its ids as little-endian unsigned 32-bit numbers; for byte-level BPE whose ranks are in the order of merges.

    Texts are cut at added tokens' spellings (the leftmost, and of those the longest), the stretches between to units. Units are
    tokenised once, many joined in one call where they stay apart by themselves, by the rank-based library.
    """

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int], most: int):
        import tiktoken

        self.most = most
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, n in ranks.items():
            self.bytes_of[n] = len(piece)
        self.added = {x: n.to_bytes(4, "little") for x, n in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.update(self.added)

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return find_units(text)
        out: list[str] = []
        for k, stretch in enumerate(self.cut.split(text)):
            out += [stretch] if k % 2 else find_units(stretch)
        return out

    def learn(self, units: set[str]) -> None:
        if len(self) > self.most:
            self.clear()
            self.update(self.added)
        new = [u for u in units if u not in self]
        joinable = [u for u in new if starts_with_space(u) and not u.isspace()]
        if joinable:
            ids = np.array(self.fast("".join(joinable)), "<u4")
            ends = np.cumsum(np.fromiter((len(u.encode("utf-8")) for u in joinable), np.int64, len(joinable)))
            cut = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            raw, start = ids.tobytes(), 0
            for u, end in zip(joinable, (4 * cut).tolist()):
                self[u] = raw[start:end]
                start = end
        for u in new:
            if u not in self:
                self[u] = np.array(self.fast(u), "<u4").tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        units = [self.units(t) for t in texts]
        self.learn(set(chain.from_iterable(units)))
        return [b"".join(map(self.__getitem__, own)) for own in units]


class Packer:
    """Routes documents' rests to tiers and packs each tier. emit gets a sequence: [(document, start, length), ...], tier."""

    def __init__(self, emit, tiers: tuple[int, ...] = TIERS):
        self.emit, self.tiers, self.rising = emit, tiers, tiers[::-1]
        self.rests: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending
        self.left = 0  # tokens of all rests

    def add(self, doc: int, n: int) -> None:
        size = self.tiers[0]
        whole = n - n % size
        for start in range(0, whole, size):
            self.emit([(doc, start, size)], size)
        if n > whole:
            self.left += n - whole
            self.route(n - whole, doc, whole)

    def route(self, n: int, doc: int, start: int) -> None:
        insort(self.rests[self.rising[bisect_left(self.rising, n)]], (n, doc, start))

    def fill(self, window: list[tuple[int, int, int]], gap: int) -> None:
        """Fills gap tokens of window; as many are left, at least."""
        self.left -= gap
        while gap:
            k = bisect_left(self.rising, gap)
            for tier in self.rising[k::-1]:  # the largest rest that fits
                rests = self.rests[tier]
                if at := bisect_right(rests, (gap, float("inf"), 0)):
                    n, doc, start = rests.pop(at - 1)
                    break
            else:  # all are longer: the shortest is cut
                longer = next(self.rests[t] for t in self.rising[k:] if self.rests[t])
                whole, doc, start = longer.pop(0)
                n = gap
                self.route(whole - gap, doc, start + gap)
            window.append((doc, start, n))
            gap -= n

    def pack(self) -> None:
        """Packs the tiers, as far as there is enough to fill their windows."""
        for tier in self.tiers:
            while self.rests[tier] and self.left >= tier:
                n, doc, start = self.rests[tier].pop()
                self.left -= n
                window = [(doc, start, n)]
                self.fill(window, tier - n)
                self.emit(window, tier)

    def close(self) -> None:
        self.pack()
        for tier in (*self.tiers, 0):
            while self.left >= max(tier, 1):
                window: list[tuple[int, int, int]] = []
                self.fill(window, tier or self.left)
                self.emit(window, tier or self.tiers[0])


def pack(docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536, with_ids: bool = False, max_units: int = 250_000) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group[, ids].

    tokenizer_json: the text of a tokenizer's file. Ids are those of its own library without special tokens added: spellings
    of added tokens inside a text give those tokens' ids. A null text counts as empty, a document of the end id alone.
    Repeated rows are packed as often as they come. tiers: descending powers of two. with_ids: the piece's ids as a
    binary of little-endian unsigned 32-bit numbers. A task holds the ids of one batch, and of the documents
    whose rests (less than one window together) still wait for more.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers: descending powers of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, byte_ranks(tokenizer_json), added_ids(tokenizer_json)))
    names = [id_col, *(x.split()[0] for x in OUT.split(", ")), *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, ranks, added = shared.value
        ids_of = WholeIds(file) if ranks is None or added is None else UnitIds(ranks, added, max_units)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, tuple[object, bytes]] = {}  # documents by running number
        rows: list[list] = [[] for _ in names]
        waiting: dict[int, list[list[tuple]]] = {t: [] for t in tiers}  # sequences of a tier that have no step group yet
        n_seq = n_group = n_doc = 0

        def emit(pieces: list[tuple[int, int, int]], tier: int) -> None:
            nonlocal n_seq
            offset, sequence = 0, []
            for doc, start, length in pieces:
                key, ids = held[doc]
                part = ids[4 * start : 4 * (start + length)]
                sequence.append((key, start, length, zlib.crc32(part), len(ids) // 4, base + n_seq, offset, tier, part if with_ids else None))
                offset += length
            n_seq += 1
            waiting[tier].append(sequence)
            per_group = max(1, step_tokens // tier)
            if len(waiting[tier]) == 2 * per_group:
                give(tier, per_group)

        def give(tier: int, n: int) -> None:
            """The tier's first n waiting sequences as a step group."""
            nonlocal n_group
            for sequence in waiting[tier][:n]:
                for *piece, ids in sequence:
                    for out, x in zip(rows, (*piece, base + n_group, ids)):
                        out.append(x)
            del waiting[tier][:n]
            n_group += 1

        packer = Packer(emit, tiers)

        def flush() -> pa.RecordBatch:
            kinds = [key_type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(x, kind) for x, kind in zip(rows, kinds)]
            for x in rows:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        key_type = None
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part, texts in text_parts(batch, 1):
                for key, ids in zip(part.column(0).to_pylist(), ids_of.of(texts)):
                    held[n_doc] = (key, ids + end)
                    packer.add(n_doc, len(ids) // 4 + 1)
                    n_doc += 1
                packer.pack()
                held = {doc: held[doc] for rests in packer.rests.values() for _, doc, _ in rests}
                if rows[0]:
                    yield flush()
        packer.close()
        for tier, sequences in waiting.items():
            groups = -(-len(sequences) // max(1, step_tokens // tier))
            while groups:
                give(tier, -(-len(sequences) // groups))
                groups -= 1
        if rows[0]:
            yield flush()
        del ids_of, held
        release()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {OUT}" + ", ids binary" * with_ids)


def load_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    with open(tokenizer_path(name), encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), load_tokenizer())
