"""The random field against all taggings of short texts, its gradient against differences, learning, odd rows, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity as T


def score_of(tags, e, chain):
    bias, start, ct, tc, tt = chain
    s = sum((x + bias) * y for x, y in zip(e, tags)) + start * tags[0]
    return s + sum({(0, 0): 0.0, (0, 1): ct, (1, 0): tc, (1, 1): tt}[p] for p in zip(tags, tags[1:]))


def all_taggings(e, chain):
    every = [(t, np.exp(score_of(t, e, chain))) for t in itertools.product((0, 1), repeat=len(e))]
    z = sum(w for _, w in every)
    p = np.array([sum(w for t, w in every if t[k]) / z for k in range(len(e))])
    pairs = [sum(w * t[0] for t, w in every)] + [sum(w * sum(p == q for p in zip(t, t[1:])) for t, w in every) for q in ((0, 1), (1, 0), (1, 1))]
    return p, np.array(pairs) / z, np.log(z)


def test_marginals():
    rng = np.random.default_rng(3)
    n = np.array([3, 0, 1, 9, 2, 0, 10])
    chain = rng.normal(size=5)
    e = rng.normal(scale=3, size=n.sum())
    p, pairs = T.marginals(e, n, chain)
    at, want_p, want = 0, [], np.zeros(4)
    for k in n:
        if k:
            x, y, _ = all_taggings(e[at : at + k], chain)
            want_p.append(x)
            want += y
        at += k
    assert np.allclose(p, np.concatenate(want_p)) and np.allclose(pairs, want)


def test_marginals_do_not_depend_on_blocks():
    rng = np.random.default_rng(4)
    chain, e = rng.normal(size=5), rng.normal(scale=4, size=1000)
    n = np.array([1, 63, 64, 65, 500, 307])
    whole, _ = T.marginals(e, n, chain)
    first = np.cumsum(n) - n
    assert np.allclose(whole, np.concatenate([T.marginals(e[s : s + k], np.array([k]), chain)[0] for s, k in zip(first, n)]))


def test_gradient():
    """Of features and chain, against differences of the log-likelihood."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    size, rows = 6, 4
    numbers = rng.integers(0, size + 1, (rows, T.WIDTH))
    n, row, tags = np.array([4, 3]), rng.integers(0, rows, 7), rng.integers(0, 2, 7)
    x = rng.normal(size=size + 5)
    batch = pa.RecordBatch.from_arrays([pa.array([v.reshape(-1).tolist()], pa.list_(pa.int32())) for v in (n, row, numbers, tags)], names=["n", "row", "numbers", "tags"])
    got = next(T._gradients(x[:size], x[size:])(iter([batch]))).column(0)[0].values.to_numpy()

    def likelihood(x):
        e = np.append(x[:size], 0)[numbers].sum(axis=1)[row]
        return sum(score_of(tags[s:t].tolist(), e[s:t], x[size:]) - all_taggings(e[s:t], x[size:])[2] for s, t in ((0, 4), (4, 7)))

    step = 1e-5 * np.eye(size + 5)
    assert np.allclose(got, [(likelihood(x + d) - likelihood(x - d)) / 2e-5 for d in step], atol=1e-5)


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["grumpf", "ÄRGXa", "ÄRGXund", "zork"]
    docs, labels = [], []
    for k in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = k % 7 == 0
        for _ in range(2 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    labels += [(None, 1), (1, None), (2, 9), (7, 1)]
    model = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), learnable=~T.held_out())
    return model, words


def test_finds_spans_and_stems(spark, learnt):
    model, words = learnt
    clean = " ".join(words[:40])
    long = " ".join(words * 60)
    rows = [(1, clean), (2, f"é {clean} Grumpf, zork {clean}"), (3, f"{clean} ÄRGXneu {clean}"), (4, None), (5, ""), (None, " \n"), (6, long), (7, long + " zork zork"), (2, f"é {clean} Grumpf, zork {clean}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("clash")).withColumn("spans", F.lit(0))
    out = T.tagged(df, model).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "score", "evidence", "spans"}
    toxic = {(r["doc_id"], tuple(r["text"][s["start"] : s["end"]] for s in r["spans"])) for r in out if r["score"] >= 0.5}
    assert toxic == {(2, ("Grumpf, zork",)), (3, ("ÄRGXneu",)), (7, ("zork zork",))}
    assert len({r["score"] for r in out if not (r["text"] or "").strip()}) == 1


def test_labels_without_two_kinds(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows, share in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(None, 1), (2, None)], 0.0)):
        model = T.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert not model.known and [r["score"] for r in T.tagged(docs, model).collect()] == [share, share]
    assert T.tagged(docs.limit(0), T.Model(False, 0.0)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = T.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.count_if(F.expr("predicted = 1 and toxic = 1")).alias("hit"), F.count_if(F.expr("toxic = 1")).alias("all"), F.count_if(F.expr("predicted = 1 and toxic = 0")).alias("wrong")).first()
    assert r["right"] >= 0.98 and r["hit"] >= 0.9 * r["all"] and r["wrong"] <= 0.01 * 825
