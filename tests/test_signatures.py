"""Layers, envelopes, arity and parameters against small cases and brute force; the type scan."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import hierarchy as H
from plumbline.operators import scan as N
from plumbline.operators import signatures as G

SCHEMA = "cls string, member string, kind string, required int, optional int, rest boolean, required_keywords int, trailing int, untyped boolean"


def overload(cls, member, required=0, optional=0, rest=False, keywords=0, trailing=0, untyped=False, kind="instance"):
    return (cls, member, kind, required, optional, rest, keywords, trailing, untyped)


FIRST = [overload("Child", "a", 1, 1), overload("Child", "a", 1, 1), overload("Base", "b", 2, rest=True), overload("Base", "b", 1), overload(None, "a", 9), overload("Base", None, 9)]
SECOND = [overload("Child", "a", 5), overload("Base", "a", 3), overload("Base", "c", 1, keywords=1), overload("Base", "c", 2), overload("Base", "d", untyped=True), overload("Base", "e", trailing=1), overload("Base", "f", 1, 2), ("Base", "g", "instance", *(None,) * 6)]


@pytest.fixture(scope="module")
def signatures(spark):
    return G.layered(*(spark.createDataFrame(rows, SCHEMA) for rows in (FIRST, SECOND)))


def test_layers_and_envelopes(signatures):
    got = {(r.cls, r.member): (r.layer, r.overloads, r.void, r.least, r.most) for r in G.envelope(signatures, *G.KEY, "layer").collect()}
    assert got == {
        ("Child", "a"): (0, 1, False, 1, 2), ("Base", "b"): (0, 2, False, 1, None), ("Base", "a"): (1, 1, False, 3, 3), ("Base", "c"): (1, 2, True, None, None),
        ("Base", "d"): (1, 1, True, None, None), ("Base", "e"): (1, 1, True, None, None), ("Base", "f"): (1, 1, False, 1, 3), ("Base", "g"): (1, 1, False, 0, 0),
    }


def test_wrong_arity_is_found_up_the_hierarchy(spark, signatures):
    labels = H.labelled(spark.createDataFrame([("Child", "Base"), ("Other", "Base")], "child string, parent string"))
    asked = [(c, m, n, p) for c in ("Child", "Other", "Base", "Nobody", None) for m in ("a", "b", "c", "d", "e", "f", "z", None) for n in range(6) for p in (True, False, None)]
    calls = spark.createDataFrame(asked, "cls string, member string, given int, plain boolean").withColumn("kind", F.lit("instance"))
    limits = {("Child", "a"): (1, 2), ("Base", "a"): (3, 3), ("Base", "b"): (1, 99), ("Base", "f"): (1, 3)}
    want = set()
    for c, m, n, p in asked:
        owner = c if (c, m) in limits else "Base" if c in ("Child", "Other", "Base") and ("Base", m) in limits else None
        if owner and p and not limits[owner, m][0] <= n <= limits[owner, m][1]:
            want.add((c, m, n, owner))
    out = G.wrong_arity(calls, signatures, labels).collect()
    assert {(r.cls, r.member, r.given, r.owner) for r in out} == want and len(out) == len(want)
    assert {r.message for r in out if (r.cls, r.member, r.given) in {("Base", "b", 0), ("Child", "a", 3)}} == {"given 0, expected 1..", "given 3, expected 1..2"}
    assert G.wrong_arity(calls.limit(0), signatures, labels).count() == 0


def test_no_cross_join(spark, signatures):
    labels = H.labelled(spark.createDataFrame([("Child", "Base")], "child string, parent string"))
    calls = spark.createDataFrame([("Child", "a", "instance", 1, True)], "cls string, member string, kind string, given int, plain boolean")
    plan = G.wrong_arity(calls, signatures, labels)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_parameters(spark):
    slots = spark.createDataFrame([(1, "required", 0, "x"), (1, "optional", 0, "y"), (1, "rest", None, "more"), (1, "keyword", None, "k"), (1, "rest_keyword", None, "opts"), (1, "block", None, "blk"), (1, "required", 1, None), (2, "required", 0, "x"), (2, "rest", None, "more")], "m int, slot string, position long, name string")
    declared = spark.createDataFrame(
        [(1, "required", 0, "other", "String"), (1, "required", 0, None, "Integer"), (1, "required", 0, "x", "String"), (1, "optional", 0, "y", "Float"), (1, "rest", None, None, "Integer"), (1, "keyword", None, "k", "Symbol"), (1, "keyword", None, "x", "Date"), (1, "rest_keyword", None, None, None), (1, "required", 1, None, "bool")],
        "m int, slot string, position long, name string, type string",
    )
    overrides = spark.createDataFrame([(2, "more", "non-empty-array[Integer]"), (1, "y", "positive-int"), (1, "y", "zero"), (1, None, "never")], "m int, name string, type string")
    got = {(r.m, r.slot, r.position, r.name): r.type for r in G.bound(slots, declared, overrides, ["m"]).collect()}
    assert got == {
        (1, "required", 0, "x"): "Integer|String", (1, "optional", 0, "y"): "positive-int", (1, "rest", None, "more"): "Array[Integer]", (1, "keyword", None, "k"): "Symbol", (1, "rest_keyword", None, "opts"): "Hash[Symbol, untyped]",
        (1, "block", None, "blk"): "untyped", (1, "required", 1, None): "bool", (2, "required", 0, "x"): "untyped", (2, "rest", None, "more"): "non-empty-array[Integer]",
    }


def test_envelope_of_many_overloads(spark):
    r = random.Random(7)
    rows = [overload("C", f"m{r.randrange(20)}", r.randrange(4), r.randrange(3), r.random() < 0.02, int(r.random() < 0.01)) for _ in range(2000)]
    got = {x.member: (x.void, x.least, x.most) for x in G.envelope(spark.createDataFrame(rows, SCHEMA), "member").collect()}
    for m in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == m]
        void, rest = any(x[6] for x in own), any(x[5] for x in own)
        assert got[m] == (void, None if void else min(x[3] for x in own), None if void or rest else max(x[3] + x[4] for x in own))


def test_type_scan(spark):
    df = spark.createDataFrame([(1, "a", b"x", 1.5), (-1, "A", None, None), (None, None, b"", 0.0), (3, "", b"y", 1.0)], "n int, `s.t` string, raw binary, x double")
    out = N.type_scan({"t": df, "none": df.limit(0)}, {"Integer": ["positive-int"], "String": ["lowercase-string", "numeric-string"]})
    got = {(r.tbl, r.col): (r.visited, r.unrecognised) for r in out.collect()}
    assert got[("t", "n")] == (3, 1) and got[("t", "raw")] == (3, 3) and got[("t", "x")] == (3, 0) and got[("none", "n")] == (0, 0)
    assert got[("t", "s.t")][0] == 3 and got[("t", "s.t")][1] >= 1
    assert {r.cls for r in N.by_class(out).collect()} == {"Integer", "String", "Binary"}
    total = sum(u for _, u in got.values()) / sum(v for v, _ in got.values())
    assert [N.exit_status(out, t) for t in (None, total, total - 0.01, 0.0, 1.0)] == [0, 0, 1, 1, 0]
    assert N.exit_status(out, None, df) == 1 and N.exit_status(out, None, df.limit(0)) == 0
    assert N.exit_status(out.limit(0), 0.0) == 0
    with pytest.raises(ValueError):
        N.type_scan({"t": df}, {"Integer": ["no such thing"]})
