"""Shapes of nested records against plain counts, and contracts of all kinds."""

import json
from collections import Counter

from plumbline.operators import shapes as H

ROWS = [
    ("a", {"k": 1, "in": {"x": "s", "deep": {"y": 1.5, "z": None}}}), ("a", {"k": "text", "in": {"x": True}}), ("a", {"list": [1, "two", [3], {"k": 4}]}), ("b", {}), ("b", [1, 2]), ("b", 7), (None, {"k": None}),
]


def plain(v, path="$"):
    kinds = {dict: "Hash", list: "Array", bool: "Boolean", int: "Integer", float: "Float", str: "String", type(None): "NilClass"}
    yield path, kinds[type(v)]
    for p, x in [(f"{path}.{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"{path}[]", x) for x in v] if isinstance(v, list) else []:
        yield from plain(x, p)


def frame(spark, rows):
    return spark.createDataFrame([(b, json.dumps(v)) for b, v in rows] + [("b", None), ("b", "{no json"), ("c", None)], "by string, t string")


def test_counts_at_every_path(spark):
    want = Counter((b, p, c) for b, v in ROWS for p, c in plain(v))
    got = {(r.by, r.path, r.cls): r.n for r in H.shape_of(frame(spark, ROWS), "t", "by").collect()}
    assert got == dict(want)
    parts = H.merged(*(H.shape_of(frame(spark, ROWS[k::2]), "t", "by") for k in range(2)))
    assert {(r.by, r.path, r.cls): r.n for r in parts.collect()} == got
    assert H.shape_of(frame(spark, []), "t", "by").count() == 0


def found(spark, contract, rows=ROWS[:3]):
    return {(r.path, r.finding): r.n for r in H.findings(H.shape_of(frame(spark, rows), "t", "by"), contract).collect()}


def test_contracts(spark):
    every = {"$": ["Hash"], "$.k": ["Integer"], "$.in": ["Hash"], "$.in.x": ["String", "Boolean"], "$.list": ["Array"]}
    assert found(spark, H.Record(every, optional=frozenset({"$.list"}))) == {("$.k", "class"): 1, ("$.k", "missing"): 1, ("$.in", "missing"): 1, ("$.in.deep", "extra"): 1}
    loose = H.Record({**every, "$.k": ["Integer", "String"]}, optional=frozenset({"$.list", "$.k", "$.in"}), open=frozenset({"$.in"}))
    assert found(spark, loose) == {}
    assert found(spark, H.Record({"$": ["Hash"]}, open=frozenset({"$"})), ROWS) == {("$", "class"): 2}
    assert found(spark, H.Record({"$": ["Array", "Hash", "Integer"], "$.k": ["NilClass"]}), ROWS[3:]) == {("$.k", "missing"): 1}
