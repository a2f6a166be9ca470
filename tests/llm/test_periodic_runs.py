"""Periodic runs against a plain search of all stretches, and odd rows."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from plumbline.llm.periodic_runs import collapsed, find_runs, numbered_words, periodic_runs, query

DATA = "/root/testdata/sf0.001"


def plain_runs(w, least=6, exponent=4):
    out = set()
    n = len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                s = w[i : j + q]
                if not any(all(s[k] == s[k + p] for k in range(len(s) - p)) for p in range(1, q)):
                    out.add((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = []
    while len(w) < rng.randint(0, 120):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        w += unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))]
    return w


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 6), (3, 9)])
def test_all_lags(exponent, least):
    rng = random.Random(exponent)
    lists = [random_words(rng) for _ in range(150)] + [[], ["a"], ["a"] * 300, ["a", "b"] * 90]
    _, _, _, n, number = numbered_words([" ".join(w).encode() for w in lists])
    if exponent == 2:
        least = 6
    found = find_runs(number, n, np.ones(len(n), np.int64), n, least, exponent)
    assert found == [plain_runs(w, least, exponent) for w in lists]
    # in ranges of lags
    parts = [find_runs(number, n, np.full(len(n), low), np.full(len(n), low + 4), least, exponent) for low in range(1, 160, 5)]
    assert [sorted((r for p in parts for r in p[k]), key=lambda r: (r[0], r[2])) for k in range(len(n))] == found


def plain_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = plain_runs(w)
    gone = {i for s, length, q in r for i in range(s + q, s + length)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in r).encode()
    return (doc_id, len(r), *best, best[1] * 1000 // best[2] if r else None, digest(listed), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in query(spark, DATA).select(columns).collect())
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len(r["text"] or "") < 3000]
    ids = {r["doc_id"] for r in rows}
    assert len(rows) > 100 and [r for r in got if r[0] in ids] == sorted(plain_row(*r) for r in rows)


def test_odd_rows_and_ranges_of_lags(spark):
    long = " ".join(["x", "y", "z"] * 400 + [str(k) for k in range(200)] + ["u"] * 50)
    rows = [(1, None, "t"), (1, "", "t"), (None, " \t\n", "t"), (2, "a a a a a a", "t"), (2, "a a a a a a", "t"), (None, long, "t"), (3, "é\u00a0é " * 7, "t"), (4, "w " * 30_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    for lags in (2048, 16):
        got = {(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs(df, lags_per_task=lags).collect()}
        assert got == {
            (1, 0, (), ""), (None, 0, (), ""), (2, 6, ((0, 6, 1),), "a"), (3, 7, ((0, 7, 1),), "é\u00a0é"), (4, 30_000, ((0, 30_000, 1),), "w"),
            (None, 1450, ((0, 1200, 3), (1400, 50, 1)), "x y z " + " ".join(str(k) for k in range(200)) + " u"),
        }
    assert periodic_runs(df).count() == len(rows)
    assert periodic_runs(df.limit(0)).count() == 0
    assert collapsed([], []) == b""
