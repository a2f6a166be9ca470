"""Packing: ids against the tokenizer's own library, an exact round trip, full windows of every tier, even step groups."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.common import tokenizer_path

SPECIAL = "<|endoftext|>"


def texts():
    r = random.Random(12)
    words = ["the", "of", "Über", "naïve", "日本語", "don't", "12,5", "x y", "\n\n", "\t", "…", "🙂"]
    out = [" ".join(r.choice(words) for _ in range(int(r.lognormvariate(5, 1.3)))) for _ in range(150)]
    out += [f"say {SPECIAL} now", SPECIAL, f"{SPECIAL}{SPECIAL}", f"{SPECIAL} a", f"a {SPECIAL}", f"a  {SPECIAL}  b", f"x{SPECIAL}y", "<|endoftext", f"{SPECIAL[:-1]} {SPECIAL}|>", f"\n{SPECIAL}\n" * 40]
    return out + [None, "", "   ", "\n", "long" * 9000, " ".join(words) * 3000]


def checked(out, ids):
    """Pieces give every document's ids back, each once, in sequences without gaps; the padding."""
    own, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        own[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append(r)
    assert own.keys() == ids.keys()
    for k, pieces in own.items():
        pieces.sort()
        assert [p[0] for p in pieces] == np.cumsum([0, *(len(p[1]) // 4 for p in pieces[:-1])]).tolist()
        assert b"".join(p[1] for p in pieces) == ids[k].tobytes() and {p[2] for p in pieces} == {len(ids[k])}
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces[:-1])]).tolist()
        n = sum(r["length"] for r in pieces)
        assert n <= 1024 and len({(r["tier"], r["step_group"]) for r in pieces}) == 1
        if n != pieces[0]["tier"]:
            assert pieces[0]["tier"] == 1024
            padding += 1024 - n
    return sequences, padding


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_round_trip(spark, name):
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    rows = list(enumerate(texts()))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    docs = spark.createDataFrame([(*x, 1, "y", 2) for x in rows], "doc_id long, text string, start int, ids string, tier int").repartition(3)
    for units in (250_000, 1):
        _, padding = checked(packing.pack(docs, packing.load_tokenizer(name), with_ids=True, max_units=units).collect(), ids)
        assert padding <= 3 * 1024


def test_ids_of_a_special_tokens_spelling():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = f.read()
    found = packing.UnitIds(packing.byte_ranks(file), packing.added_ids(file), 100).of([f"say {SPECIAL} now"])
    assert np.frombuffer(found[0], "<u4").tolist() == [16706, 220, 50256, 783]


def test_every_tier_is_packed(spark):
    """Rests of one tier alone fill that tier's windows; mixed with longer ones they fill the longer windows' gaps first."""
    out = []
    packer = packing.Packer(lambda pieces, tier: out.append((tier, pieces)))
    for k, n in enumerate([60] * 40 + [100] * 40 + [200] * 40 + [400] * 40):
        packer.add(k, n)
    packer.pack()
    assert max(tier for tier, _ in out) == 512
    assert all(sum(p[2] for p in pieces) == tier for tier, pieces in out)
    for lengths, tier in (([60] * 40, 64), ([100] * 40, 128), ([200] * 40, 256), ([400] * 40, 512), ([900] * 40, 1024)):
        out.clear()
        packer = packing.Packer(lambda pieces, tier: out.append((tier, pieces)))
        for k, n in enumerate(lengths):
            packer.add(k, n)
        packer.pack()
        assert {t for t, _ in out} >= {tier} and max(t for t, _ in out) == tier and all(sum(p[2] for p in pieces) == t for t, pieces in out)
    out.clear()
    packer = packing.Packer(lambda pieces, tier: out.append((tier, pieces)))
    for k, n in enumerate([1000, 700, 24, 300, 24]):
        packer.add(k, n)
    packer.pack()
    assert [(tier, [p[2] for p in pieces]) for tier, pieces in out] == [(1024, [1000, 24]), (1024, [700, 300, 24])]


def test_step_groups_are_even(spark):
    docs = spark.createDataFrame([(k, "word " * (k * 37 % 1400)) for k in range(900)], "doc_id long, text string").coalesce(1)
    out = packing.pack(docs, packing.load_tokenizer(), step_tokens=8192, with_ids=True).collect()
    groups = defaultdict(set)
    for r in out:
        groups[r["tier"], r["step_group"]].add(r["sequence_id"])
    by_tier = defaultdict(list)
    for (tier, _), sequences in groups.items():
        by_tier[tier].append(len(sequences))
    assert len({g for _, g in groups}) == len(groups)
    for tier, sizes in by_tier.items():
        most = 8192 // tier
        assert max(sizes) <= most and sum(n < most for n in sizes) <= 2 and (len(sizes) == 1 or min(sizes) >= most // 2)
