"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string"


def text(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_equal_and_null_ids_keep_other_texts(spark):
    r = random.Random(8)
    texts = [text(r, 40) for _ in range(6)]
    rows = [(None, t, "a") for t in texts[:3]] + [(None, texts[0], "a"), (4, texts[3], "a"), (4, texts[4], "b"), (4, texts[4], "b"), (9, texts[3], "c"), (None, texts[5], "d"), (2, texts[5], "d")]
    out = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert out.columns == ["doc_id", "text", "source"]
    assert sorted(map(str, ((x.doc_id, x.text) for x in out.collect()))) == sorted(map(str, [(None, t) for t in texts[:3]] + [(4, texts[3]), (4, texts[4]), (2, texts[5])]))


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_of_shingle_similarity(spark):
    r = random.Random(3)
    texts = []
    for n in (100, 60, 44, 45, 46, 100, 20, 6, 3) * 4:
        base = text(r, n).split()
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3):  # about 0.9, 0.8 and less
            copy = list(base)
            for _ in range(changes):
                copy[r.randrange(n)] = "CHANGED"
            texts.append(" ".join(copy))
        texts += [" ".join(base + ["end"]), " ".join([base[0].upper(), *base[1:]])]
    texts += ["", " \n"]
    sets = [shingles(t) for t in texts]
    near = lambda a, b: not a and not b or 5 * len(a & b) >= 4 * len(a | b)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and near(sets[i], sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    out = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(x.doc_id for x in out.collect()) == sorted(set(group))


def brute(texts, t=0.8):
    sets = [shingles(x) for x in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}


def template(r, pages, own, shared):
    base = text(r, shared)
    return [base + " " + text(r, own) for _ in range(pages)]


def candidates(spark, texts):
    """Pairs by rare shingles, of all texts as one crowd."""
    import numpy as np

    from plumbline.llm import shingle_dedup
    from plumbline.llm.common import Stash

    shingle, size, _ = shingle_dedup.shingle_sets([t.encode() for t in texts])
    ends = np.cumsum(size)
    rows = [(i, shingle[e - n : e].view(np.int64).tolist(), i) for i, (n, e) in enumerate(zip(size.tolist(), ends.tolist()))]
    out = shingle_dedup.by_rare_shingles(spark.createDataFrame(rows, "node long, set array<long>, c long"), Stash(spark, "near-test"))
    return {(x.a, x.b) for x in out.collect()}


def test_rare_shingles_lose_no_pair_at_any_similarity(spark):
    r = random.Random(12)
    texts = template(r, 60, 100, 150)
    for k in range(80):  # copies of pages and of each other, with 1 to 8 words changed, cut or added
        words = r.choice(texts).split()
        for _ in range(r.randint(1, 8)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 2)] = [text(r, 1)] * r.randint(0, 2)
        texts.append(" ".join(words))
    found = candidates(spark, texts)
    for t in (0.8, 0.9, 0.95):
        want = brute(texts, t)
        assert want and want <= found
    assert len(found) < 5 * len(brute(texts))


def test_pages_of_one_template_cost_in_proportion(spark):
    """Similar to 0.5, so unlike: twice as many are not four times the pairs."""
    r = random.Random(5)
    for shared, own in ((100, 50), (170, 30)):  # 0.5 and 0.74
        texts = template(r, 300, own, shared)
        assert not brute(texts[:40])
        few, many = candidates(spark, texts[:150]), candidates(spark, texts)
        assert len(few) <= 150 and len(many) <= 300


def test_near_copies_among_pages_of_one_template(spark):
    r = random.Random(6)
    texts = template(r, 120, 50, 100)
    texts += [" ".join([*t.split()[:149], "changed"]) for t in texts[:30]]
    out = corpus_pipeline.dedup_documents(spark, spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], SCHEMA).repartition(3), "")
    assert sorted(x.doc_id for x in out.collect()) == list(range(120))
