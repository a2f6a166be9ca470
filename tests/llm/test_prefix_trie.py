"""The trie against a plain one, colliding fingerprints, conversations over many ranges, odd rows."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ranges
from plumbline.llm.common import Stash
from plumbline.llm.prefix_trie import as_turns, numbered, prefix_trie, query, rebuilt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    by = {c: [x[1:] for x in sorted(t)] for c, t in by.items()}
    if rebuild:
        h = {c: crc32(str(c).encode()) % 4 for c in by}
        by = {c: by.get(c - c % 20, [])[: h[c]] + t[h[c] :] for c, t in by.items()}
    nodes = defaultdict(list)
    for c, t in by.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    total, leaves = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        total[k] = own + sum(total[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
    ends = {k: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(by[c]) == len(k)))).encode()).hexdigest() for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], total[k], ends[k]) for k, m in nodes.items())


def of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def some_rows(seed, convs=60, deep=7):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, deep)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "d e f"])))
    return [*rows, *rows[:9], (None, 1, "user", "nobody's"), (10**12, 0, "user", "far"), (7 * 10**9, None, None, None)]


@pytest.mark.parametrize("keep", [64, 3])
def test_plain_trie_even_if_fingerprints_collide(spark, keep):
    rows = some_rows(5)
    stash = Stash(spark, "trie-test")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("g", F.lit(1)).withColumn("depth", F.lit("clash"))
    turns = numbered(as_turns(df), stash)
    assert of(prefix_trie(turns.select("conv").distinct(), turns, stash, keep=keep)) == plain(rows, rebuild=False)
    assert of(prefix_trie(*rebuilt(turns, stash), stash, keep=keep)) == plain(rows)


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, k, "user", f"t {k % 3}") for k in range(700)] + [(2, k, "user", f"t {k % 3}") for k in range(650)] + [(3, 0, "user", "other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        stash = Stash(spark, "trie-test")
        turns = numbered(as_turns(df), stash)
        assert [r["depth"] for r in turns.where("conv = 1").orderBy("depth").collect()] == list(range(1, 701))
        assert of(prefix_trie(turns.select("conv").distinct(), turns, stash)) == plain(rows, rebuild=False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_powers():
    e = np.array([0, 1, 5, 1000, 10**9])
    assert [int(x) for x in ranges.powers(ranges.ODD, e)] == [pow(ranges.ODD, int(k), 1 << 64) for k in e]
    assert ranges.ODD * ranges.INVERSE % (1 << 64) == 1


def test_empty(spark):
    stash = Stash(spark, "trie-test")
    turns = numbered(as_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), stash)
    assert prefix_trie(*rebuilt(turns, stash), stash).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(query(spark, "/root/testdata/sf0.01")) == plain(rows)
