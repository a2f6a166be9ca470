"""Each corpus operator against brute force on a small table with nulls, blanks, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, exact_dedup, language_id, line_dedup, mixing, packing, simhash, substring_dedup, token_counts, url_filter
from plumbline.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, k int, id string, h long, start int, row string"


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["Über", "naïve", "日本語", "x\u00a0y", "don't", "12,5"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, shared = text(60), text(34)
    texts = [text(r.randint(1, 120)) for _ in range(40)]
    texts += [t.replace(" ", "\n", 2) for t in texts[:5]] + texts[:6] + [texts[0]] * 3
    texts += [f"{text(20)} {passage} {text(9)}" for _ in range(4)] + [f"{shared} {text(3)}" for _ in range(3)]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[10:16]]
    texts += [None, "", "   ", "\t\n", "one", "one two three", "a " * 90, "long" * 900, text(6000), "line one of this text\nline two of this text\n\n...\nline one of this text"]
    rows = [(i, t, "en", [None, "b", "a", "Ä"][i % 4], len(t or ""), "x", 1, "y", 3, 4, "z") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[1], None, None, 1, "x", 1, "y", 3, 4, "z"), (7, "same id, other text", "en", "a", 2, "x", 1, "y", 3, 4, "z")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def test_token_counts(docs, rows):
    import regex

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    costs = token_counts.piece_costs(vocabulary)
    split = regex.compile(token_counts.PRE_TOKEN).findall

    def least(w):
        best = [0]
        for end in range(1, len(w) + 1):
            best.append(min(best[s] + costs[w[s:end]] for s in range(max(0, end - 130), end) if w[s:end] in costs))
        return best[-1] & ((1 << token_counts.COUNT_BITS) - 1)

    out = Counter((r.doc_id, r.n_bytes, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, vocabulary).collect())
    wanted = Counter((r[0], len((r[1] or "").encode()), len(split(r[1] or "")), sum(least(w.encode()) for w in split(r[1] or ""))) for r in rows)
    assert out == wanted
    assert Counter((r.doc_id, r.n_bytes, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, vocabulary, max_units=1).collect()) == wanted


def test_token_counts_of_long_pre_tokens():
    """Many of over 64 bytes at once, shared prefixes, and scores that need more than 64 bits."""
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    costs, pieces = token_counts.piece_costs(vocabulary), token_counts.pieces_of(vocabulary)
    longest = max(map(len, costs))

    def least(w):
        best = [0]
        for end in range(1, len(w) + 1):
            best.append(min(best[s] + costs[w[s:end]] for s in range(max(0, end - longest), end) if w[s:end] in costs))
        return best[-1] & ((1 << token_counts.COUNT_BITS) - 1)

    r = random.Random(1)
    cjk = "".join(chr(r.randrange(0x4E00, 0x4F00)) for _ in range(500))
    tried = [cjk.encode(), cjk[:300].encode(), *(("".join(chr(r.randrange(0x4E00, 0x4E20)) for _ in range(r.randrange(20, 60)))).encode() for _ in range(60))]
    tried += [("the" * k).encode() for k in range(1, 60)] + [b"internationalization" * 9]
    tried = list(dict.fromkeys(tried))
    assert pieces.count(tried).tolist() == [least(w) for w in tried]
    a = pieces.count([b"ab" * 4000])[0]
    levels, token_counts.LEVELS = token_counts.LEVELS, 16
    try:
        assert pieces.count(tried).tolist() == [least(w) for w in tried] and pieces.count([b"ab" * 4000])[0] == a
    finally:
        token_counts.LEVELS = levels
    assert pieces.count([]).tolist() == []


def test_mixing(docs, rows):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if weight[s] * level >= 3 * size[s]} | full
        if more == full:
            break
        full = more
    target = {s: 3 * size[s] if s in full else weight[s] * level for s in order}
    out = mixing.plan(docs, with_row=True).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == len(words(r["row"]["text"])) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == size[r["row"]["source"]] and r["target"] == pytest.approx(target[r["row"]["source"]])
        assert r["taken"] == sum(c["words"] for c in r["copies"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["row"]["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.plan(docs.repartition(5), with_row=True).collect()
    assert Counter((r["doc_id"], r["taken"], tuple(r["positions"])) for r in out) == Counter((r["doc_id"], r["taken"], tuple(r["positions"])) for r in again)


def test_mix_returns_whole_rows_in_order(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert all(r["text"] and r["text"].split() for r in out.collect())


def fingerprint(t, n):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in ids:
        groups[find(i)].append(i)
    return {i: g for g in groups.values() for i in g}


def test_simhash(docs, rows):
    fps = [fingerprint(r[1], 4) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    groups = component_of(range(len(rows)), links)
    least = lambda g: min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
    wanted = Counter((rows[i][0], f"{fps[i]:016x}", least(groups[i])) for i in range(len(rows)))
    out = simhash.near_groups(simhash.fingerprints(docs)).select("doc_id", simhash.hex_fp(F.col("fp")), "component_id").collect()
    assert Counter(map(tuple, out)) == wanted


def test_simhash_finds_all_near_pairs(spark):
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(60)]
    for base in fps[:30]:
        for n in (1, 2, 3, 4, 5):
            x = base
            for b in r.sample(range(64), n):
                x ^= 1 << b
            fps.append(x)
    # near copies of near copies, in tiles of two
    signed = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    wanted = component_of(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()} == {i: min(g) for i, g in wanted.items()}
    from plumbline.llm.common import Stash
    from plumbline.llm.components import components

    stash = Stash(spark, "test")
    of = {f: i for i, f in signed}
    for options in ({"home_tile": 1, "tile": 2}, {"fine": True}, {"fine": True, "home_tile": 1, "tile": 2}):
        found = components(simhash.links(df.select("fp"), stash, **options), stash).collect()
        assert len(found) == sum(len(g) > 1 for g in wanted.values())
        assert all(of[r.component] in wanted[of[r.node]] for r in found)


def test_every_anchor_is_near():
    a = simhash.Anchors()
    w = np.random.default_rng(1).integers(0, 1 << 23, 500)
    assert (a.syndrome(a.home(w)) == 0).all() and (np.bitwise_count(a.home(w) ^ w) <= 3).all()
    for away, n in ((4, 8855), (5, 33649)):  # all words of that weight, dealt to 2,048 syndromes
        row, other = a.others(w, away)
        assert (a.syndrome(other) == 0).all() and (np.bitwise_count(other ^ w[row]) == away).all() and (a.coset[away] >= 0).sum() == n


def test_line_dedup(docs, rows):
    keyed = [(r[0] is None, r[0] or 0, line_key(r[1]), r[1]) for r in rows]
    seen = defaultdict(list)
    for none, i, key, t in sorted(set(keyed), key=lambda x: x[:3]):
        for place, line in enumerate(t.split("\n") if t is not None else ()):
            if n := line_dedup.normal_line(line):
                seen[n].append((none, i, key, place))
    names = list(seen)
    fp = line_dedup.Lines(names).fingerprints().view(np.uint64)
    links = [(a, b) for a in range(len(names)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3 and line_dedup.similar(names[a], names[b])]
    gone = defaultdict(set)
    for g in {tuple(g) for g in component_of(range(len(names)), links).values()}:
        for none, i, key, place in sorted(x for n in g for x in seen[names[n]])[1:]:
            gone[none, i, key].add(place)
    wanted = Counter()
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        out = gone.get((r[0] is None, r[0] or 0, line_key(r[1])), set())
        wanted[r[0], None if r[1] is None else "\n".join(x for p, x in enumerate(lines) if p not in out), len(lines), len(out)] += 1
    for tile, blocks in ((4096, 4), (1, 4), (4096, 5), (1, 6)):
        got = line_dedup.line_dedup(docs, tile=tile, keys=line_dedup.Keys(blocks))
        assert got.columns == [*docs.columns, "n_lines", "n_removed"]
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == wanted


def test_line_keys_hold_all_near_pairs():
    r = random.Random(7)
    for blocks in (4, 5, 6):
        keys = line_dedup.Keys(blocks)
        assert keys.width + 2 * 10 + keys.bits - keys.width <= 62 and sum(m.bit_count() for m in keys.masks) > 0
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for x in r.sample(range(64), r.randint(0, 3)):
                b ^= 1 << x
            assert any((a ^ b) & m == 0 for m in keys.masks)


def test_line_dedup_keeps_other_columns_and_ends(spark):
    """Columns with the names of its own, and a document of many repeated lines."""
    row = lambda i, t: (i, t, "keep me", 5, "x", 7, "y", 8, 9)
    rows = [row(1, "same line here\n" * 200_000), row(2, "other line\nsame line here"), row(3, "")]
    names = "doc_id long, text string, __id string, rk int, `row` string, gone int, N_Lines string, line int, `with.dot` int"
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, names)).collect()}
    assert out[1].text == "same line here\n" and (out[1].n_lines, out[1].n_removed) == (200_001, 199_999)
    assert out[2].text == "other line" and all((r["__id"], r.rk, r.row, r.gone, r.line, r["with.dot"]) == ("keep me", 5, "x", 7, 8, 9) for r in out.values())


def line_key(t):
    return 0 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))


def test_edit_distance():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j, d in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
            p = q
        return p[-1]

    r = random.Random(3)
    for _ in range(400):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 20)))
        b = "".join(c if r.random() < 0.8 else r.choice("abc") for c in a) + r.choice(["", "a", "bb"])
        m = r.randint(0, 12)
        x, y = (" ".join(s[k : k + 2] for k in range(0, len(s), 2)) for s in (a, b))
        assert line_dedup.distance_bound(x.split(" "), y.split(" ")) >= distance(x, y)
        assert line_dedup.distance_at_most(a, b, m) == (distance(a, b) <= m)

    texts = []  # pairs of several segments, from equal to unlike, some with characters that share a number
    for _ in range(120):
        a = "".join(r.choice("ab cd0pé日") for _ in range(r.randint(1, 300)))
        kind = r.random()
        b = "".join("" if (x := r.random()) < kind / 6 else c + r.choice("ab") if x < kind / 3 else r.choice("abcd") if x < kind / 2 else c for c in a) or "a"
        b = b[r.randint(0, len(b) // 4) :] + b[: r.randint(0, 9)] if r.random() < 0.3 else b
        texts += [a, b]
    size = np.array([len(x) for x in texts])
    codes = (np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) & 63).astype(np.uint8)
    i, j = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    exact = np.array([distance(texts[x], texts[y]) for x, y in zip(i, j)])
    for part in (0.05, 0.2, 0.5):
        most = (part * np.maximum(size[i], size[j])).astype(int)
        bound = line_dedup.distances_from_below(codes, np.cumsum(size) - size, size, i, j, most)
        assert all(exact[bound > most] > most[bound > most])
        assert part == 0.5 or (bound > most).sum() > 10


def test_language_id_held_out(spark):
    r = random.Random(4)
    syllables = {"en": ["the", "ing", "sh", "er"], "de": ["sch", "ein", "ung", "ß"], "fr": ["eau", "que", "é", "oi"]}
    rows = [(i, " ".join("".join(r.choice(syllables[k]) for _ in range(3)) for _ in range(30)), k) for i in range(120) for k in [["en", "de", "fr"][i % 3]]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 34 ...", "fr"), (903, rows[0][1], None), (904, rows[1][1], "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, learnable=~language_id.held_out())
    out = {x.doc_id: x for x in language_id.predict(df, model).collect()}
    assert all(out[i].lang_pred == k for i, t, k in rows[:120]) and all(0 <= x.score <= 1 for x in out.values())
    assert [out[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "en", "de"]
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 or df.where(language_id.held_out()).where(f"doc_id = {i}").count() for i in (0, 5))


def test_exact_dedup(docs, rows):
    import re

    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, normal):
        groups[t].append(r[0])
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    wanted = Counter((r[0], keep[t], len(groups[t]), r[0] == keep[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, normal))
    for shard in (100_000, 2):
        out = exact_dedup.exact_dedup(docs, F.col("doc_id") % 2 == 0, shard_digests=shard).drop("known").collect()
        assert Counter(map(tuple, out)) == wanted


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    w = np.frombuffer(r.bytes(32 * n), "<u8").reshape(-1, 4)
    for levels in (24, 1):
        h = exact_dedup.PerfectHash(w, levels=levels)
        assert sorted(h.slots(w)) == list(range(n))
        assert (h.slots(np.frombuffer(r.bytes(3200), "<u8").reshape(-1, 4)) < n).all()


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/1", "https://example.org", "https://a.example.org/en/12?x#y", "http://x.org/", "http://notexample.org/es/", "http://a.com/de/1", "http://a.com/fr/1", "http://b.net/en/5", "http://org/?q=/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.outcomes_of(labels)).collect()}
    assert out[0] == out[1] == out[2] == ("", "", None, "allow") and out[3] == ("", "", None, "allow")
    assert out[4] == ("example.org", "/es/1", "example.org/es/", "block") and out[5] == ("example.org", "", None, "allow")
    assert out[6] == ("a.example.org", "/en/12", "example.org/en/1", "block") and out[7] == ("x.org", "/", "org/", "allow")
    assert out[8] == ("notexample.org", "/es/", "org/", "allow") and out[9][2:] == ("com/de/", "block") and out[10][2:] == ("com/fr/", "allow")
    assert out[11] == ("b.net", "/en/5", None, "allow") and out[12] == ("org", "/", "org/", "allow")
    assert out[13] == ("b:", "//c/d", None, "allow")


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://bad.x.net/en/{i}") for i in range(40)] + [(100 + i, f"http://good.y.net/en/{100 + i}") for i in range(40)] + [(200, "http://new.x.net/en/999")]
    labels = [(i, 0, 1) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)] + [(5, None, None), (6, 0, 1), (None, 0, 1)]
    out = {r.page_id: r for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string"), url_filter.outcomes_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert out[0].verdict == "block" and out[100].verdict == "allow" and out[100].bad_mean < out[200].bad_mean < out[0].bad_mean


def test_host_names(spark):
    hosts = ["a.b.co.uk", "b.co.uk:8080", "co.uk", "taco.uk", "u:p@x.b.com", "b.com.", "b.com.:80", "localhost", "", "x.y.z.org", ".", "a..b", "10.0.0.1", "77.8.0.1:80", "[::1]:8080", "[::ffff:1.2.3.4]", "1.2.3", "v1.2.3.4.com"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", F.regexp_replace("host", url_filter.BESIDE_NAME, "").alias("name"))
    out = {r.host: (r.d, r.s) for r in rows.select("host", F.regexp_extract("name", url_filter.DOMAIN, 1).alias("d"), F.regexp_extract("name", url_filter.SUFFIX, 1).alias("s")).collect()}
    assert out == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "taco.uk": ("taco.uk", "uk"), "u:p@x.b.com": ("b.com", "com"), "b.com.": ("b.com", "com"),
        "b.com.:80": ("b.com", "com"), "localhost": ("localhost", "localhost"), "": ("", ""), "x.y.z.org": ("z.org", "org"), ".": ("", ""), "a..b": (".b", "b"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "77.8.0.1:80": ("77.8.0.1", "77.8.0.1"), "[::1]:8080": ("[::1]", "[::1]"), "[::ffff:1.2.3.4]": ("[::ffff:1.2.3.4]", "[::ffff:1.2.3.4]"),
        "1.2.3": ("2.3", "3"), "v1.2.3.4.com": ("4.com", "com"),
    }


def vectors():
    r = np.random.default_rng(9)
    base = r.standard_normal((40, 16))
    out = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for k in range(60):
        out.append((100 + k, (base[k % 10] + 0.12 * r.standard_normal(16)).tolist(), (k % 10) % 3))
    out += [(200, out[0][1], 0), (201, out[0][1], 1), (202, [2 * x for x in out[0][1]], 0), (203, None, 0), (204, [0.0] * 16, 0), (205, [1.0, None] + [0.0] * 14, 0), (206, [float("nan")] * 16, 0), (207, [float("inf")] + [1.0] * 15, 0), (208, out[1][1], None), (209, [1.0, 2.0], 0), (210, [], 0), (0, out[0][1], 0)]
    return out


def test_embeddings(spark):
    rows = vectors()

    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if x[2] is not None and x[2] == y[2] and fine(x[1]) and fine(y[1]) and len(x[1]) == len(y[1]):
                p, q = np.array(x[1]), np.array(y[1])
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    groups = component_of(range(len(rows)), [(a, b) for a, s in links.items() for b in s])
    wanted = Counter((rows[i][0], len(links[i]), min(rows[j][0] for j in groups[i]), rows[i][0] == min(rows[j][0] for j in groups[i])) for i in range(len(rows)))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, n int")
    for tile, bits in ((8192, 63), (5, 63), (5, 1)):  # one bit: labels, lengths and pairs of tiles meet under one hash
        assert Counter(map(tuple, embedding_dedup.embedding_dedup(df, tile=tile, hash_bits=bits).collect())) == wanted


@pytest.mark.parametrize("d", [16, 63, 64, 300])
def test_estimates_are_unbiased_and_bounded(d):
    r = np.random.default_rng(3)
    x = r.standard_normal((150, d))
    x = np.concatenate([x, x + 0.35 * r.standard_normal((150, d))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = x @ x.T
    error = []
    for seed in range(20):
        c = embedding_dedup.Codes(x, embedding_dedup.rotation(d, seed), seed)
        signs, rounded = embedding_dedup.Codes.read(c.packed(), d)
        assert (signs == np.where(c.positive, 1, -1)).all() and (rounded == c.rounded).all()
        assert c.packed().shape[1] == -(-d // 8) + (d + 1) // 2
        e = embedding_dedup.estimates(signs, c.factor, rounded, c.low, c.step) - true
        near = true >= 0.93
        bound = np.broadcast_to(embedding_dedup.errors(c.factor, float(c.step.max()), d, 0.93, 4.0)[:, None], true.shape)
        assert (true + e >= 0.93 - bound)[near].mean() > 0.999
        error.append(e[~np.eye(len(x), dtype=bool)])
    assert abs(np.mean(error)) < 0.002


def test_few_vectors_are_fetched():
    """Of unlike vectors, the bound leaves few."""
    r = np.random.default_rng(5)
    x = r.standard_normal((4000, 64))
    x[1] = x[0] + 0.1 * r.standard_normal(64)
    c = embedding_dedup.Codes(x / np.linalg.norm(x, axis=1)[:, None], embedding_dedup.rotation(64))
    side = (c.packed(), c.factor.astype(np.float32), c.low.astype(np.float32), c.step.astype(np.float32), 64)
    a, b = embedding_dedup.candidates(side, side, 0.93, 6, True)
    assert (a | b)[:2].all() and (a | b).sum() < 100


def test_operators_take_empty_tables(spark, empty):
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert token_counts.token_counts(empty, f.read()).count() == 0
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert simhash.near_groups(simhash.fingerprints(empty)).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    model = language_id.fit(empty)
    assert language_id.predict(empty, model).count() == 0
    assert packing.pack(empty, packing.load_tokenizer()).count() == 0
    assert exact_dedup.exact_dedup(empty, F.lit(True)).count() == 0
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, bad int")).count() == 0
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_a_model_without_languages(spark, docs):
    model = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"und"}


def test_sources_of_no_size(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "x y", "b")], "doc_id long, text string, source string")
    assert {r.doc_id: (r.size, r.taken) for r in mixing.plan(df).collect()} == {1: (0, 0), 2: (0, 0), 3: (2, 2)}



def test_many_rows_of_one_id_or_none_are_spread_over_buckets(spark):
    rows = [(None, f"a b {k}", "s") for k in range(300)] + [(7, f"c {k}", "s") for k in range(300)] + [(7, "same", "s")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    h = df.select(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(7)).alias("h")).distinct().count()
    assert h == 601
    out = mixing.plan(df).collect()
    assert len(out) == len(rows) and sum(r["taken"] for r in out) == sum(r["size"] for r in out)


def test_copies_of_a_text_are_drawn_one_by_one(spark):
    rows = [(k, "der und die " * 3, "de") for k in range(2000)] + [(k + 5000, f"the of {k} and", "en") for k in range(50)] + [(9000, "x" * 500, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, max_docs_per_lang=100, max_chars=400)
    seen = {k: float(n[(c & 511) == ord("e") + 1].sum()) for k, (c, n) in zip(model.langs, model.counts)}
    assert model.langs == ["de", "en"] and 3 * 50 < seen["de"] / 2 < 3 * 200  # two e in each of three parts of a drawn copy: about 100 copies
    assert all((c & 511 != ord("x") + 1).all() for c, _ in model.counts)
    assert {r.lang_pred for r in language_id.predict(df.where("lang = 'de'"), model).collect()} == {"de"}


def test_language_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, "the word", "a", "b", "c"), (2, None, None, None, None)], "doc_id long, text string, Score string, Lang_Pred string, other string")
    out = language_id.predict(df, language_id.fit(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))))
    assert out.columns == ["doc_id", "text", "other", "lang_pred", "score", "bits_per_byte"] and [r.lang_pred for r in out.collect()] == ["und", "und"]
