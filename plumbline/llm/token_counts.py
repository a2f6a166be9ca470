"""Token counts by trie-shared dynamic programming.

Every document's text is split into pre-tokens. The distinct ones of a part of a task's rows, whatever their length, are inserted
into a trie of bytes, level by level, while several still go on; where few are left, each goes on alone from the state of its node. A trie node stands for a prefix, and holds the unigram forward score of that prefix: the least cost of any
segmentation into vocabulary pieces, found from the scores of the nodes above it where a piece begins. Prefixes that pre-tokens
share are therefore scored once. The node where a pre-token ends (its terminal) gives the number of pieces, which is kept.

The scores are frozen and nothing is trained: a piece costs ln(rank + 1) in fixed point, where rank is its place
in a public vocabulary (a Zipf law). Single bytes, which the vocabulary lists first whatever their frequency, cost
as much as its last piece, so that each byte string has a segmentation. Equal costs go to fewer pieces.

Nothing is shuffled or broadcast but the vocabulary file (a parameter, about 1 MB), whose own trie a worker builds once. A task holds one part's trie and the counts of
at most max_units stretches between white space; when they are more, they are forgotten, which repeats work and changes no result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import release, text_parts
from .common import table, tokenizer_path
from .units import PRE_TOKEN, find_units, starts_with_space

SCALE = 1 << 12  # fixed point of a cost
COUNT_BITS = 24  # in the vocabulary, and on levels above LEVELS, a score is cost << COUNT_BITS | pieces
LEVELS = 1 << 20  # from there on a score may not fit into 64 bits
FEW = 8  # pre-tokens that go on one by one


def piece_costs(vocabulary: bytes) -> dict[bytes, int]:
    """Cost and piece count (1) in one integer, by piece; vocabulary: lines of a base64 piece and its rank."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    last = len(ranks) + 1
    costs = {p: (round(SCALE * math.log(last if len(p) == 1 else r + 1)) << COUNT_BITS) + 1 for p, r in ranks.items()}
    for b in range(256):  # a byte the vocabulary lacks is an unknown piece, dearer than any known one
        costs.setdefault(bytes([b]), (round(SCALE * 2 * math.log(last + 1)) << COUNT_BITS) + 1)
    return costs


class Pieces:
    """The vocabulary's own trie: next[node, byte] (-1: none) and each node's cost (where a piece ends)."""

    NONE = np.int64(1) << np.int64(61)

    def __init__(self, costs: dict[bytes, int]):
        child: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        n = 1
        for piece, cost in costs.items():
            node = 0
            for byte in piece:
                nxt = child.get((node, byte))
                if nxt is None:
                    nxt = child[node, byte] = n
                    n += 1
                node = nxt
            ends[node] = cost
        self.next = np.full((n, 256), -1, np.int32)
        for (node, byte), nxt in child.items():
            self.next[node, byte] = nxt
        self.cost = np.full(n, self.NONE, np.int64)
        self.cost[list(ends)] = list(ends.values())

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces in the cheapest segmentation of each of some distinct words, not empty."""
        order = sorted(range(len(words)), key=words.__getitem__)
        sizes = np.fromiter(map(len, words), np.int64, len(words))[order]
        letters = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        first = np.cumsum(sizes) - sizes
        found = np.zeros(len(words), np.int64)
        alive, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # words in order, and their nodes of the level above
        score = np.zeros(1, np.int64)  # of the nodes of the level above
        # what may still become a piece: its node above, the score where it began, its place in the vocabulary's trie
        at, began, place = (np.zeros(0, np.int64) for _ in range(3))
        level = 0
        while len(alive) > (FEW if level else 0) and level < LEVELS:
            byte = letters[first[alive] + level]
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])])
            above, letter = node[new], byte[new]
            node = np.cumsum(new) - 1
            n = np.bincount(at, minlength=len(score))
            start = np.cumsum(n) - n
            n = n[above]
            of = np.repeat(np.arange(len(above)), n)
            k = np.repeat(start[above] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            began = np.concatenate([began[k], score[above]])  # those of the node above, and pieces that begin here
            place = np.concatenate([self.next[place[k], letter[of]], self.next[0, letter]]).astype(np.int64)
            at = np.concatenate([of, np.arange(len(above))])
            stays = place >= 0
            by_node = np.argsort(at[stays], kind="stable")
            at, began, place = (x[stays][by_node] for x in (at, began, place))
            score = np.minimum.reduceat(began + self.cost[place], np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])))
            level += 1
            ended = sizes[alive] == level
            found[alive[ended]] = score[node[ended]] & ((1 << COUNT_BITS) - 1)
            alive, node = alive[~ended], node[~ended]
        for w, v in zip(alive.tolist(), node.tolist()):
            own = slice(*np.searchsorted(at, [v, v + 1]))
            found[w] = self._on(letters[first[w] + level : first[w] + sizes[w]].tobytes(), int(score[v]), began[own].tolist(), place[own].tolist())
        out = np.empty(len(words), np.int64)
        out[order] = found
        return out

    def _on(self, rest: bytes, score: int, began: list[int], place: list[int]) -> int:
        """Pieces up to the end of rest, from the state of the node before it. Scores are wider here: cost << 64 | pieces."""
        wide = lambda x: x >> COUNT_BITS << 64 | x & ((1 << COUNT_BITS) - 1)
        go, cost, score = self.next.item, self.cost.item, wide(score)
        active = list(zip(map(wide, began), place))
        for byte in rest:
            active.append((score, 0))
            active = [(s, nxt) for s, nxt in ((s, go(v, byte)) for s, v in active) if nxt >= 0]
            score = min(s + wide(cost(v)) for s, v in active)
        return score & ((1 << 64) - 1)


_pieces: dict[bytes, Pieces] = {}  # of this Python worker: a vocabulary's trie is built once


def pieces_of(vocabulary: bytes) -> Pieces:
    key = hashlib.sha256(vocabulary).digest()
    if key not in _pieces:
        _pieces.clear()
        _pieces[key] = Pieces(piece_costs(vocabulary))
    return _pieces[key]


class UnitCounts(dict):
    """unit: pre-tokens << 32 | tokens."""

    def __init__(self, pieces: Pieces, most: int):
        import regex

        self.split, self.pieces, self.most = regex.compile(PRE_TOKEN).findall, pieces, most

    def learn(self, units: set[str]) -> None:
        if len(self) > self.most:
            self.clear()
        new = [u for u in units if u not in self]
        joinable = [u for u in new if starts_with_space(u) and not u.isspace()]
        alone = [u for u in new if not starts_with_space(u) or u.isspace()]
        words = self.split("".join(joinable))
        ends = np.cumsum(np.fromiter(map(len, joinable), np.int64, len(joinable)))
        per = np.diff(np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), ends, side="right"), prepend=0)
        for u in alone:
            words += (more := self.split(u))
            per = np.append(per, len(more))
        distinct = list(set(words))
        of = dict(zip(distinct, self.pieces.count([w.encode("utf-8", "surrogatepass") for w in distinct]).tolist())) if distinct else {}
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(of.__getitem__, words), np.int64, len(words)))])
        end = np.cumsum(per)
        tokens = total[end] - total[end - per]
        self.update(zip(chain(joinable, alone), ((per << 32) + tokens).tolist()))


def token_counts(docs: DataFrame, vocabulary: bytes, *, id_col: str = "doc_id", text_col: str = "text", max_units: int = 250_000) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_pretokens, n_tokens (longs).

    A null or empty text has 0 of each. Repeated rows and null ids are counted as they stand; other columns are not
    read. vocabulary: the bytes of a rank file. max_units bounds a task's memory, not its results.
    """
    id_type = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = UnitCounts(pieces_of(shared.value), max_units)
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                units = [find_units(t) if t else [] for t in texts]
                counts.learn(set(chain.from_iterable(units)))
                n = [sum(map(counts.__getitem__, u)) for u in units]
                sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in (t or "" for t in texts)]
                columns = sizes, [x >> 32 for x in n], [x & 0xFFFFFFFF for x in n]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in columns)], names=[id_col, "n_bytes", "n_pretokens", "n_tokens"])
        del counts
        release()

    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {id_type.simpleString()}, n_bytes long, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    return token_counts(table(spark, sf_dir, "documents"), vocabulary)
