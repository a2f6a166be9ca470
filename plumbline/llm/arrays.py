"""NumPy helpers of the operators that work on batches: runs of equal keys, bit votes, bitmaps, shingle hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)  # bit k of a byte: lane k


def by_key(df: DataFrame, call: Callable[[pa.Table], pa.RecordBatch | None], schema: str, key: str = "k", least_rows: int = 20_000) -> DataFrame:
    """Applies call to tables of whole groups of equal key, each table of many groups, sorted by key.

    A table holds as many groups as come to least_rows rows, or one larger group: callers keep groups bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1]))  # where the last group begins
            if held and n >= least_rows and cut == 0 and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[0]:
                if (out := call(pa.Table.from_batches(held))) is not None:
                    yield out
                held, n = [], 0
            if n + cut >= least_rows and cut:
                held.append(batch.slice(0, cut))
                if (out := call(pa.Table.from_batches(held))) is not None:
                    yield out
                held, n = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            n += batch.num_rows
        if held and (out := call(pa.Table.from_batches(held))) is not None:
            yield out
        del held
        release()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(keys))


def votes(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SimHash of each group of successive hashes (unsigned 64-bit): bits set in over half of them; 0 of none."""
    out = np.zeros(len(lengths), np.uint64)
    some = np.flatnonzero(lengths > 0)
    if not len(some):
        return out
    n = lengths[some]
    parts = -(-n // 255)  # a lane of 8 bits counts up to 255
    first = np.repeat(np.cumsum(n) - n, parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], first + 255 * nth, axis=0)
    counts = lanes.view(np.uint8).reshape(len(lanes), 64).astype(np.int64)
    counts = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0)
    out[some] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed bits of unsigned 64-bit numbers (fixed values: splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MOST_BITS = 1 << 27


def bitmap(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """Bits of which those numbered column & (size - 1) are set; 16 bits a key, 16 MB at most, whatever n is.

    So it may be broadcast. A set bit only says that its key may be there: with more keys more bits are set, and no key is lost.
    """
    size = 1 << max(10, min(MOST_BITS.bit_length() - 1, (max(1, n) * 16 - 1).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(size - 1))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
LONG = 64  # bytes from which a stretch is hashed by itself


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes: eight bytes at a time, mixed with all before them; long stretches by XXH3."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    eight = np.ndarray(len(raw), "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    on = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[on], size[on]
    while len(on):
        x = eight[at]
        part = left < 8
        x[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        out[on] = mixed(out[on] ^ x)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    if len(long := np.flatnonzero(size > LONG)):
        import xxhash

        data = raw.data
        for k in long.tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def row_hashes(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of short stretches of numbers, each mixed with all before it."""
    out = mixed(sizes.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    for k in range(int(sizes.max(initial=0))):
        on = sizes > k
        out[on] = mixed(out[on] ^ x[starts[on] + k])
    return out


def word_bounds(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, the starts and ends of their words (between ASCII white space), and each text's number of words."""
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
    space = _SPACES[raw]
    edge = np.flatnonzero(np.concatenate([[True], space[:-1]]) != space)
    starts, ends = edge[::2], edge[1::2]
    first = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return raw, starts, ends, np.diff(np.searchsorted(starts, first))


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, joined, and each text's number of words."""
    raw, starts, ends, n = word_bounds(texts)
    return byte_hashes(raw, starts, ends), n


def text_parts(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of about most bytes of text, and their texts."""
    for part, _ in blocks_of(batch, column, most, with_bytes=False):
        yield part, part.column(column).to_pylist()


def blocks_of(batch: pa.RecordBatch, text: int, most: int = 1_000_000, with_bytes: bool = True) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch of about most bytes of text, and their texts as bytes."""
    column = batch.column(text).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for s, e in zip(*runs(np.cumsum(sizes) // most)):
        yield batch.slice(s, e - s), column.slice(s, e - s).to_pylist() if with_bytes else []


def release() -> None:
    """Gives back what a finished task's arrays and caches have left in this worker's allocators, for the tasks that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def row_key(text: Column) -> Column:
    """With a row's id, what tells rows apart that have the same id: rows equal in both are treated alike."""
    return F.coalesce(F.xxhash64(text), F.lit(0))
