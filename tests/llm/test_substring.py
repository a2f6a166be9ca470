"""Substring dedup: spans against brute force, factors, and words whose weak hashes would collide."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, corpus, words

from plumbline.llm import arrays, substring_dedup


def brute_spans(rows, window):
    starts = Counter(tuple(words(r[1])[s : s + window]) for r in rows for s in range(len(words(r[1])) - window + 1))
    for r in rows:
        w = words(r[1])
        gone = set()
        for s in range(len(w) - window + 1):
            if starts[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        yield r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def odd_rows():
    r = random.Random(4)
    text = lambda n, of="abcdefgh": " ".join("".join(r.choice(of) for _ in range(3)) for _ in range(n))
    shared, a = text(34), thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    out = [f"{shared} {a}", f"{shared} {b}", f"{a} {text(34)}", "x y " * 400, "x  y\t" * 300 + "z", "z " + "x\ny " * 60]
    whole = f"{'q' * 500} {text(50)} {'r' * 70} {text(20)}"
    out += [whole, whole + " end", "begin " + whole.replace("  ", " "), " ".join(whole.split()[:40]), " ".join(whole.split()[30:])]
    out += [text(300, "ab") for _ in range(10)]
    ring = text(35).split()
    out += [" ".join(ring * 4), " ".join((ring[7:] + ring[:7]) * 3)]
    return [(1000 + i, t, *(None,) * 9) for i, t in enumerate(out)]


@pytest.mark.parametrize("most", [32_768, 40, 3, 2])  # few: anchors are split by longer ones, then windows are dealt to several blocks
def test_substring_dedup(spark, most):
    rows = corpus() + odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    wanted = Counter(brute_spans(rows, 35))
    assert sum(n for _, _, n, _ in wanted) > 100
    out = substring_dedup.substring_dedup(docs, most_in_block=most).collect()
    assert Counter(map(tuple, out)) == wanted
    assert {r.doc_id: r.n_removed for r in out if r.doc_id in (1000, 1001, 1002)} == {1000: 0, 1001: 0, 1002: 0}


@pytest.mark.parametrize("lies", [False, True])
def test_blocks_compare_words(monkeypatch, lies):
    """Where hashes of words lie, the block is parsed again by bytes."""
    if lies:
        monkeypatch.setattr(substring_dedup, "byte_hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    r = random.Random(2)
    text = [" ".join(r.choice(["aa", "bb", "cc"]) for _ in range(60)) for _ in range(6)]
    stretches = [*text, text[0], " ".join(text[1].split()[:40] + ["dd"] * 20), " ".join(["dd"] * 15 + text[2].split()[10:55])]
    t = pa.table({"k": pa.array([5] * 9), "id": pa.array(range(9)), "rk": pa.array([0] * 9), "first": pa.array([100] * 9), "words": pa.array([s.encode() for s in stretches])})
    out = substring_dedup.parse_block(t, 35).to_pylist()
    covered = {k: {p for x in out if x["id"] == k for p in range(x["begin"] - 100, x["end"] - 100)} for k in range(9)}
    wanted = {i: n for i, _, n, _ in brute_spans(list(enumerate(stretches)), 35)}
    assert {k: len(v) for k, v in covered.items()} == wanted
    assert {(x["begin"], x["end"]) for x in out if x["id"] == 0} == {(100, 160)}  # one factor, the longest
    assert len(out) == 6


def test_longest_matches():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = r.integers(1, 9, 12)
        x, ends = r.integers(0, 3, sizes.sum()), np.repeat(np.cumsum(sizes), sizes)
        length, where = substring_dedup.longest_matches(x, ends)

        def common(a, b):
            n = 0
            while a + n < ends[a] and b + n < ends[b] and x[a + n] == x[b + n]:
                n += 1
            return n

        for a in range(len(x)):
            assert length[a] == max(common(a, b) for b in range(len(x)) if b != a) and (not length[a] or common(a, where[a]) == length[a])


def test_hashes_of_thue_morse_words_differ():
    for n in (64, 128, 1024, 2048, 4096):
        a = thue_morse(n)
        h, _ = arrays.words_of([f"{a} {a.translate(str.maketrans('ab', 'ba'))} {a}".encode()])
        assert h[0] == h[2] != h[1]


def test_blocks_are_bounded(spark, monkeypatch):
    """Many copies of one window: each block holds what it may, and all of them are found."""
    sizes = []

    def seen(df, *args, **options):
        sizes.append(df.groupBy("k").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0])
        return arrays.by_key(df, *args, **options)

    monkeypatch.setattr(substring_dedup, "by_key", seen)
    r = random.Random(5)
    notice = " ".join(f"w{k}" for k in range(40))
    rows = [(i, f"{r.random()} {notice} {r.random()}") for i in range(600)] + [(600, f"{r.random()} " * 50), (None, notice), (None, notice)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most_in_block=50).collect()
    assert all(x.n_removed == 40 for x in out if x.doc_id != 600) and len(out) == 603
    assert {x.n_removed for x in out if x.doc_id == 600} == {50}  # one word, 50 times: its windows repeat within the text
    assert sizes[0] <= 100
