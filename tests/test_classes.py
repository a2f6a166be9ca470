"""Hierarchy labels, relational division, branches that meet, positions, repeated texts, generations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import division, envjoin, hierarchy, profile
from plumbline.operators.graph import CycleError
from plumbline.operators.ordering import positioned
from plumbline.streaming.stateful import Generations

EDGE = "child string, parent string"


def tree(n, seed):
    r = random.Random(seed)
    return {f"c{k}": f"c{r.randrange(k)}" if k and r.random() < 0.95 else None for k in range(n)}


def above(parents, c):
    while c is not None:
        yield c
        c = parents.get(c)


def test_all_relations(spark):
    parents = tree(40, 1) | {f"leaf{k}": "c0" for k in range(60)}  # c0 is a hot parent
    names = [*parents, "stranger"]
    labels = hierarchy.labelled(spark.createDataFrame([*parents.items(), ("c5", parents["c5"])], EDGE))
    pairs = [(x, y) for x in names for y in names[:45]] + [(None, "c0"), ("c0", None), (None, None), ("stranger", "nobody")]
    out = hierarchy.related(spark.createDataFrame(pairs, "x string, y string"), labels)

    def want(x, y):
        if x is not None and x == y:
            return "equal"
        if x not in parents or y not in parents:
            return "unknown"
        return "subclass" if y in above(parents, x) else "superclass" if x in above(parents, y) else "disjoint"

    assert sorted(map(str, out.collect())) == sorted(f"Row(x={x!r}, y={y!r}, relation={want(x, y)!r})" for x, y in pairs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    sizes = {r.cls: r.hi - r.lo + 1 for r in labels.collect()}
    assert sizes == {c: sum(c in above(parents, x) for x in parents) for c in parents}
    owned = [("c0", "m", "i"), ("c3", "m", "i"), ("c3", "m", "s"), ("leaf1", "m", "i")]
    asked = [(c, "m", k) for c in names for k in ("i", "s")]
    found = hierarchy.looked_up(spark.createDataFrame(asked, "cls string, name string, kind string"), spark.createDataFrame(owned, "owner string, name string, kind string"), labels)
    assert {(r.cls, r.kind): r.owner for r in found.collect()} == {(c, k): next((a for a in (above(parents, c) if c in parents else ()) if (a, "m", k) in owned), None) for c, _, k in asked}


def test_hierarchies_that_are_none(spark):
    with pytest.raises(CycleError):
        hierarchy.labelled(spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None)], EDGE))
    with pytest.raises(ValueError):
        hierarchy.labelled(spark.createDataFrame([("a", "b"), ("a", "c")], EDGE))
    assert hierarchy.labelled(spark.createDataFrame([(None, "b"), (None, None)], EDGE).where("child is not null")).count() == 0


def test_class_tests_narrow(spark):
    rows = spark.createDataFrame([("equal",), ("subclass",), ("superclass",), ("disjoint",), ("unknown",)], "r string")
    r, x, y = F.col("r"), F.lit("x"), F.lit("y")
    out = rows.select("r", *[hierarchy.narrowed(r, x, y, exact=e, holds=h).alias(f"{e}{h}") for e in (False, True) for h in (True, False)], hierarchy.accepts(r).alias("a")).collect()
    assert [tuple(v) for v in out] == [
        ("equal", "x", None, "x", None, 2), ("subclass", "x", None, None, "x", 2), ("superclass", "y", "x", None, "x", 0), ("disjoint", None, "x", None, "x", 0), ("unknown", "x", "x", None, "x", 1),
    ]


def test_division(spark):
    r = random.Random(2)
    members = [(r.choice([1, 2, 3, 4, None]), r.choice(["A", "B", "C", None])) for _ in range(12)] + [(5, None), (6, "A"), (6, None), (6, "A")]
    registry = [(r.choice(["A", "B", "C", None, "D"]), r.choice(["m", "n", "o", None])) for _ in range(9)] + [("A", "only")]
    m, g = spark.createDataFrame(members, "receiver int, cls string"), spark.createDataFrame(registry, "cls string, name string")
    want = set()
    for x in {a for a, _ in members}:
        classes = {c for a, c in members if a == x}
        for name in {n for c, n in registry if c in classes}:
            k = sum((c, name) in registry for c in classes)
            want.add((x, name, k, len(classes), k == len(classes)))
    assert {tuple(v) for v in division.divided(m, g).collect()} == want
    on_nil = {n for c, n in registry if c is None}
    wrong = set()
    for x in {a for a, c in members if c is None}:
        rest = {c for a, c in members if a == x and c is not None}
        wrong |= {(x, n) for n in {n for c, n in registry if c in rest} - on_nil if all((c, n) in registry for c in rest)}
    assert wrong and {tuple(v) for v in division.nil_receivers(m, g).collect()} == wrong
    assert division.divided(m.limit(0), g).count() == 0


def test_division_counts_names_once_for_each_set_of_classes(spark):
    m = spark.range(2000).select(F.col("id").alias("receiver"), F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("A"), F.lit("B"), F.lit(None))).otherwise(F.array(F.lit("A"), F.lit(None)))).alias("cls"))
    g = spark.createDataFrame([(c, n) for n in range(20) for c in ("A", "B")] + [("B", 20), (None, 0)], "cls string, name int")
    receivers, found = division._divided(m, g)
    assert receivers.count() == 2000 and found.count() == 21 + 20
    assert division.divided(m, g).count() == 1000 * 21 + 1000 * 20
    wrong = division.nil_receivers(m, g)
    assert wrong.count() == wrong.distinct().count() == 2000 * 19 and wrong.where("name in (0, 20)").isEmpty()


@pytest.mark.parametrize("n", [3, 4])
def test_branches_meet_in_any_order(spark, n):
    branches = [[("local", "a", "1"), ("ivar", "@a", "1")], [("local", "a", "2"), ("local", "b", "1")], [("local", "a", "1"), ("ivar", "@b", "3"), ("ivar", "@a", "2")], []][:n]
    got = set()
    for order in itertools.permutations(range(n)):
        rows = [(b, *x) for b, k in enumerate(order) for x in branches[k]]
        out = envjoin.join_branches(spark.createDataFrame(rows, "branch int, kind string, name string, value string"), n)
        got.add(frozenset((r.kind, r.name, tuple(r.domain)) for r in out.collect()))
        if len(got) > 1 or len(order) == 4 and order[0] == 1:
            break
    nil = ("nil",) * (n == 4)
    assert got == {frozenset({("local", "a", ("1", "2", *nil)), ("local", "b", ("1", "nil"))})}


def test_positions(spark):
    values = list(range(500)) + [7] * 3
    random.Random(3).shuffle(values)
    out = positioned(spark.createDataFrame([(v, str(v)) for v in values], "v int, s string").repartition(5), "v", "s").collect()
    assert sorted(r.position for r in out) == list(range(len(values)))
    assert [r.v for r in sorted(out, key=lambda r: r.position)] == sorted(values)


def test_repeated_texts_of_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "c"), (None, "c"), (3, None), (4, None), (5, "once"), (1, "a")]
    out = profile.repeated(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {tuple(r) for r in out.select("text", "n", "first_id").collect()} == {("a", 3, 1), ("c", 2, None), (None, 2, 3)} and out.count() == 3


def test_generations(spark, tmp_path):
    g = Generations(spark, str(tmp_path / "contract"))
    for n in range(11):
        g.put(spark.createDataFrame([("click", n)], "event_type string, most int"), n)
    g.put(spark.createDataFrame([("view", 5)], "event_type string, most int"), 10)  # a generation written again replaces itself
    assert [tuple(r) for r in g.latest().collect()] == [("view", 5, 10)]
