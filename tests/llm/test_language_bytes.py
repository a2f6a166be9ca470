"""Language ID keeps all bytes: against a plain coder over 256 bytes, and rare scripts beside common ones."""

import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from plumbline.llm import language_id


def counted(text):
    raw = np.frombuffer(text, np.uint8)
    codes, n = np.unique(language_id._spread(raw, np.array([len(raw)])), return_counts=True)
    return codes, n.astype(np.float32)


def plain(text):
    padded = [-1, -1, -1, *text]
    counts = [defaultdict(Counter) for _ in range(4)]
    for i in range(3, len(padded)):
        for order in range(4):
            counts[order][tuple(padded[i - order : i])][padded[i]] += 1

    @cache
    def p(context, s):
        if context is None:
            return 1 / 256
        c, shorter = counts[len(context)].get(context), context[1:] if context else None
        if not c:
            return p(shorter, s)
        total, kinds = sum(c.values()), len(c)
        if s in c:
            return c[s] / (total + kinds)
        return kinds / (total + kinds) * p(shorter, s) / sum(p(shorter, x) for x in range(256) if x not in c)

    return p


def test_code_lengths_over_all_bytes():
    texts = ("abracadabra abracadabra".encode(), "สวัสดี ภาษาไทย".encode())
    trees, coders = language_id.Trees([counted(t) for t in texts]), [plain(t) for t in texts]
    b = language_id.BITS
    for context in ((-1, -1, -1), tuple(b"bra"), tuple(texts[1][3:6]), (0, 255, 7)):
        for s in (*b"ab", texts[1][0], 0, 200, 255):
            code = (context[0] + 1) << 3 * b | (context[1] + 1) << 2 * b | (context[2] + 1) << b | s + 1
            assert trees.lengths(np.array([code]))[0].tolist() == pytest.approx([-np.log2(p(context, s)) for p in coders], rel=1e-4)


def test_rare_scripts_beside_common_ones(spark):
    r = random.Random(6)
    latin = "".join(chr(c) for c in range(33, 127)) + "äöüß"
    rows = [(" ".join("".join(r.choice(latin) for _ in range(7)) for _ in range(80)), "xx") for _ in range(150)]
    scripts = {"th": range(0x0E01, 0x0E2F), "lo": range(0x0E81, 0x0EAF), "ka": range(0x10D0, 0x10F1)}
    new = {k: [" ".join("".join(chr(r.choice(list(span))) for _ in range(4)) for _ in range(12)) for _ in range(8)] for k, span in scripts.items()}
    rows += [(t, k) for k, texts in new.items() for t in texts[:3]]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    unseen = [(t, k) for k, texts in new.items() for t in texts[3:]]
    out = language_id.predict(spark.createDataFrame(unseen, "text string, wanted string"), model).collect()
    assert all(x.lang_pred == x.wanted for x in out)


def test_probabilities_sum_to_one():
    texts = ("abracadabra abracadabra".encode(), "สวัสดี ภาษาไทย".encode(), bytes(range(256)) * 3)
    trees = language_id.Trees([counted(t) for t in texts])
    b = language_id.BITS
    for context in ((-1, -1, -1), tuple(b"bra"), tuple(texts[1][3:6]), (0, 255, 7), (4, 5, 6)):
        codes = np.array([(context[0] + 1) << 3 * b | (context[1] + 1) << 2 * b | (context[2] + 1) << b | s + 1 for s in range(256)])
        assert np.allclose(np.exp2(-trees.lengths(codes).astype(np.float64)).sum(axis=0), 1, atol=1e-4)


def test_number_characters_are_no_letters(spark):
    model = language_id.fit(spark.createDataFrame([("some words", "en"), ("quelques mots", "fr")], "text string, lang string"))
    texts = ["½ ²", "Ⅷ", "١٢٣", "_", "12 + 3", "", None, "中", "ª", "a1"]
    out = [x.lang_pred for x in language_id.predict(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), model).collect()]
    assert [x == "und" for x in out] == [True] * 7 + [False] * 3
