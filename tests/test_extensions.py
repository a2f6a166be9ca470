"""Settings, facts, needs, answers, templates, levels, read-only fields, baselines, lockfiles, tracked text on odd input."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import provenance as P
from plumbline.operators import contracts, extensions, graph, records, settings
from plumbline.sources import files as S


def test_settings(spark):
    own = "name string, key string, value string"
    links = "name string, base string, position int"
    s = spark.createDataFrame([("base", "a.x", "1"), ("base", "b", "1"), ("mid", "a", "off"), ("top", "a.y", "2"), ("late", "b", "3"), (None, "k", "v"), ("base", None, "v"), ("base", "n", None), ("other", "a", "1"), ("other", "a.z", "2"), ("base", "b", "1")], own)
    i = spark.createDataFrame([("mid", "base", 0), ("top", "mid", 0), ("top", "late", 1), ("top", "gone", None), (None, "base", 0), ("bare", "base", 0)], links)
    got = {(r.name, r.key): (r.value, r.origin) for r in settings.effective(s, i).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "top"} == {"a.y": ("2", "top"), "b": ("3", "late"), "n": (None, "base")}
    assert {k[1]: v for k, v in got.items() if k[0] == "mid"} == {"a": ("off", "mid"), "b": ("1", "base"), "n": (None, "base")}
    assert {k[1] for k in got if k[0] == "bare"} == {"a.x", "b", "n"} and {k[1] for k in got if k[0] == "other"} == {"a.z"}
    assert [tuple(r) for r in settings.without_base(s, i).collect()] == [("top", "config.missing-include", "gone")]
    with pytest.raises(graph.CycleError):
        settings.effective(s, i.union(spark.createDataFrame([("base", "mid", 3)], links)))
    assert settings.effective(spark.createDataFrame([], own), spark.createDataFrame([], links)).count() == 0


def test_settings_against_plain_merge(spark):
    """Includes in a lattice, held against dictionaries merged one after the other."""
    n = 24
    own = {f"c{i}": {f"k{j}": f"{i}.{j}" for j in range(6) if (i * 7 + j * 3) % 4 == 0} for i in range(n)}
    base = {f"c{i}": [f"c{(i - 1) // 2}", f"c{(i - 1) // 3}"] if i > 2 else [] for i in range(n)}

    def plain(c):
        return S.load_config(c, lambda x: {**own[x], "includes": list(base[x])})

    s = spark.createDataFrame([(c, k, v) for c, m in own.items() for k, v in m.items()], "name string, key string, value string")
    i = spark.createDataFrame([(c, b, at) for c, bs in base.items() for at, b in enumerate(bs)], "name string, base string, position int")
    got = {}
    for r in settings.effective(s, i).collect():
        got.setdefault(r.name, {})[r.key] = r.value
    assert got == {c: m for c in own if (m := plain(c))}


def test_levels(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("a",)], "name string")
    needs = "consumer string, producer string"
    got = graph.levels(nodes, spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("c", "a"), (None, "a"), ("gone", "a"), ("d", None)], needs))
    assert {r.name: r.level for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 0} and got.count() == 4
    with pytest.raises(graph.CycleError):
        graph.levels(nodes, spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "d")], needs))
    with pytest.raises(ValueError, match="not there"):
        graph.levels(nodes, spark.createDataFrame([("b", "nowhere")], needs))
    assert graph.levels(nodes.limit(0), spark.createDataFrame([], needs)).count() == 0


def test_facts_and_needs(spark):
    f = spark.createDataFrame([("p", "n", 1), ("p", "n", 1), ("p", "m", 1), ("p", "m", None), ("q", "n", None), ("q", "n", None), (None, "n", 2), (None, None, 2)], "plugin string, name string, value long")
    standing, conflicts = extensions.publish(f)
    assert {tuple(r) for r in standing.collect()} == {("p", "n", 1), ("q", "n", None), (None, "n", 2), (None, None, 2)}
    assert [tuple(r) for r in conflicts.collect()] == [("p", "plugin.fact-conflict", "m")]
    needs = spark.createDataFrame([("r", "n"), ("r", "m"), ("r", "m"), (None, "z"), ("r", None)], "plugin string, name string")
    assert {(r.path, r.message) for r in extensions.unmet(needs, standing).collect()} == {("r", "m"), (None, "z")}
    assert extensions.unmet(needs, standing.limit(0)).count() == 3


def test_answers_and_templates(spark):
    calls = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    answers = spark.createDataFrame([(1, 5, "x"), (1, 2, None), (1, 5, "w"), (None, 0, "z"), (3, 0, "y")], "id long, position int, type string")
    assert sorted(map(tuple, extensions.first_answer(calls, answers, "id").collect()), key=repr) == sorted([(1, "w", 5), (2, None, None), (2, None, None), (None, None, None)], key=repr)
    sites = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), (None, "z"), ("a", "x")], "macro string, arg string")
    templates = spark.createDataFrame([("a", "{}={}"), ("a", "{}={}"), ("a", None), (None, "{}")], "macro string, template string")
    assert [r.member for r in extensions.expand(sites, templates).collect()] == ["x=x", "x=x"]


def test_readonly(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1), (None, "x", 1), (4, "d", 1)], "id long, `a.b` string, n int")
    later = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "y", 2), (5, "e", 1)], "id long, `a.b` string, n int")
    marked = records.readonly(df, "a.b", "none")
    assert [tuple(r) for r in records.overwritten(marked, later, "id").collect()] == [(2, "a.b", None, "b")]
    assert records.overwritten(df, later, "id").count() == 0 and records.overwritten(marked, later.drop("a.b"), "id").count() == 0
    assert {(r.id, r.field) for r in records.overwritten(records.readonly(df), later, "id").collect()} == {(1, "n"), (2, "a.b"), (2, "n")}


def test_baselines(spark, tmp_path):
    texts = {"array": '[{"path": "a", "line": 1, "rule": "r"}, {"path": "b"}]', "object": '{"diagnostics": [{"path": "c", "line": 3}]}', "none": "{}", "empty": "[]", "broken": '{"diagnostics": [', "bare": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {tuple(r) for r in S.read_baselines(spark, str(tmp_path)).collect()}
    assert got - {("bare.json", "bare.json", None, "baseline.parse-error")} == {("array.json", "a", 1, "r"), ("array.json", "b", None, None), ("object.json", "c", 3, None), ("broken.json", "broken.json", None, "baseline.parse-error")}


def test_policy_columns_agree_with_the_calls(spark):
    p = S.Policy(["/data", "/other/x"], ["a.example", "b.example"])
    paths = ["/data", "/data/x", "/data/../etc", "/database", "/other/x/y", "/other", "/", "", "/data/./../data//z", "/../data/x", None]
    urls = ["https://a.example", "https://A.example/x", "https://a.example:8080/x", "https://a.example@evil.example/", "https://a.example:pw@evil.example/", "http://a.example/", "https://x.a.example/", "https://evila.example/", "https://b.example?x", "ahttps://a.example/", "https:///", "", None]
    got = spark.createDataFrame([(x,) for x in paths], "x string").select("x", p.reads(F.col("x")).alias("y")).collect()
    assert all(r.y == (r.x is not None and r.x.startswith("/") and p.may_read(r.x)) for r in got)
    got = spark.createDataFrame([(x,) for x in urls], "x string").select("x", p.opens(F.col("x")).alias("y"), p.opens(F.col("x"), subdomains=True).alias("z")).collect()
    assert [r.x for r in got if r.y] == urls[:3] + ["https://b.example?x"] and all(r.y == (r.x is not None and p.may_open(r.x)) for r in got)
    assert [r.x for r in got if r.z and not r.y] == ["https://x.a.example/"]


def test_locked(spark):
    text = "GEM\n  specs:\n    a (1.0)\n      b (>= 1)\n    c-d (2.1.x)\n"
    rows = spark.createDataFrame([(text,), ("gems:\n- name: e\n  version: 3\n",), ("",), (None,)], "t string").select(S.locked(F.col("t")).alias("x")).collect()
    assert [r.x if r.x is None else [tuple(y) for y in r.x] for r in rows] == [[("a", "1.0"), ("c-d", "2.1.x")], [("e", "3")], [], None]
    assert S.locked_versions(text) == {"a": "1.0", "c-d": "2.1.x"}


def test_render(spark):
    old = spark.createDataFrame([("a", "untyped"), ("b", "String")], "m string, type string")
    new = spark.createDataFrame([("a", "Integer", "new_method"), ("b", "Other", "x"), ("c", "Float", "new_method"), ("d", "untyped", "new_method")], "m string, type string, kind string")
    lines = lambda *a, **k: sorted(r.line for r in contracts.render(old, new, "m", *a, **k).collect())
    assert lines() == ["def a: () -> Integer", "def c: () -> Float"] and lines("print", ("c",)) == ["def c: () -> Float"]
    assert lines("diff") == ["+ def a: () -> Integer", "+ def c: () -> Float", "- def a: () -> untyped"] and len(lines("write")) == 4
    with pytest.raises(ValueError):
        contracts.render(old, new, "m", "show")


def test_tracked_text(spark):
    df = spark.createDataFrame([("x ", True, 2), ("y", False, -1), (None, True, None)], "t string, k boolean, n int")
    t = P.Text(F.col("t"), F.col("k"))
    row = lambda x: [tuple(r) for r in df.select(x.value, x.flag).collect()]
    assert row(t.repeated(F.col("n"))) == [("x x ", True), (None, False), (None, False)]
    assert row(t.stripped("right").padded(3, ".", "left")) == [("x..", True), ("y..", False), (None, False)]
    assert row(P.joined([t, P.literal("b")], "-")) == [("x -b", True), ("y-b", False), (None, False)] and row(P.joined([])) == [("", True)] * 3
    assert row(P.formatted("%s%d", t, 4))[:2] == [("x 4", True), ("y4", False)] and row(t.chopped())[:2] == [("x", True), ("", False)]
