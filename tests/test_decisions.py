"""Projections, payloads of containers, members' contracts, complements, constant conditions and carriers on odd input."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import accept, contracts, graph, narrow, refine, rules


def test_projections(spark):
    df = spark.createDataFrame([("-5", "aB"), ("7", "ab"), ("x", ""), (None, None)], "n string, t string")
    got = {(r.column, r.method): (r.n, r.broken) for r in refine.unprojected(df, {"n": "decimal-int-string", "t": "lowercase-string"}).collect()}
    assert got == {("n", "downcase"): (2, 0), ("n", "upcase"): (2, 0), ("n", "to_i"): (2, 1), ("n", "to_int"): (2, 1), ("t", "downcase"): (2, 0), ("t", "upcase"): (2, 0)}
    assert len(refine.PROJECTIONS) == 16 and refine.unprojected(df.limit(0), {"t": "lowercase-string"}).first().n == 0
    with pytest.raises(ValueError):
        refine.unprojected(df, {"t": "non-empty-string"})


def test_payloads(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 5, None)], "x int")
    hits = lambda p: [r.x for r in df.where(F.coalesce(refine.compile_payload(p)(F.col("x")), F.lit(False))).collect()]
    assert hits("value_of[Array[positive-int]]") == [1, 5] and hits("key_of[Tuple[nil, nil]]") == [0, 1] and hits("Array[nil | 5][3]") == [5, None]
    for bad in ("key_of[positive-int]", "value_of[Hash[positive-int]]", 'Array[nil]["k"]', "key_of[Tuple[]]", "value_of", "Hash[nil][1]"):
        assert refine.compile_payload(bad) is None


def test_members(spark):
    above = graph.closure(spark.createDataFrame([("Integer", "Numeric"), ("Tuple", "Array")], "child string, parent string"))
    o, t = "m string, type string, complex boolean, computed boolean", "m string, type string"
    seen = [("tight", "Integer", None, False), ("tight", "Integer", False, None), ("same", "Integer", False, False), ("wide", "Numeric", False, False), ("other", "Strange", False, False), ("union", "Integer", False, False), ("shape", "Tuple", False, False), ("const", "Integer", False, True), ("new", "X", False, False), ("none", None, False, False), ("mixed", "Integer", False, False), ("mixed", "untyped", False, False), ("hard", "Integer", True, False), (None, "Integer", False, False)]
    said = [("tight", "Numeric"), ("same", "Integer"), ("wide", "Integer"), ("other", "Numeric"), ("union", "Numeric"), ("union", "NilClass"), ("shape", "Array"), ("const", "Numeric"), ("mixed", "Numeric"), ("hard", "Numeric"), ("new", None), ("gone", "X"), (None, "Integer"), ("same", "Integer")]
    got = {r.m: r.verdict for r in contracts.classify_members(spark.createDataFrame(seen, o), spark.createDataFrame(said, t), above, "m").collect()}
    assert got == {"tight": "tighter-return", "same": "equivalent", "wide": "equivalent", "other": "equivalent", "union": "equivalent", "shape": "equivalent", "const": "equivalent", "new": "new-method", "none": "skipped.untyped-return", "mixed": "skipped.untyped-return", "hard": "skipped.complex-shape"}
    assert contracts.classify_members(spark.createDataFrame([], o), spark.createDataFrame(said, t), above, "m").count() == 0


def test_complement(spark):
    df = spark.createDataFrame([([("S", None), ("I", "1"), None],), ([("S", ""), ("S", "")],), ([("S", "x")],), ([],), (None,)], "m array<struct<cls:string,value:string>>")
    got = [r.x if r.x is None else [tuple(y) for y in r.x] for r in df.select(narrow.complement_of_difference(F.col("m"), "S", F.lit("")).alias("x")).collect()]
    assert got == [[("I", "1"), ("S", "")], [("S", "")], [("S", "x")], [], None]


def test_constant_conditions(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "x int, y int")
    x, y = F.col("x"), F.col("y")
    asked = [("x", "compare", x > 0, ""), ("y", "compare", y > 0, ""), ("z", "compare", x > 1, ""), ("nil", "nil", y.isNull(), ""), ("loop", "compare", x > 0, "loop")]
    assert {(r.message, r.polarity, r.severity) for r in rules.constant_conditions(df, asked).collect()} == {("x", "truthy", "warning"), ("y", "falsey", "warning")}
    assert rules.constant_conditions(df.limit(0), asked).count() == 0 and rules.constant_conditions(df, []).count() == 0
    assert rules.constant_conditions(df, asked, "lenient").first().severity == "info"


def test_carriers(spark):
    c = "struct<kind:string,cls:string,args:array<string>>"
    n = lambda cls, *args: ("nominal", cls, list(args))
    cases = [(n("Array", "Integer"), n("Array", "Numeric"), "no"), (n("Array", "Numeric", "Numeric"), n("Array", "Integer"), "maybe"), (n("Array", "Numeric", "Integer"), n("Array", "String"), "no"), (n("Array", None), n("Array", "Integer"), "maybe"), (("nominal", "Mystery", None), ("nominal", "Mystery", None), "yes"), (n("Mystery"), n("Integer"), "maybe"), (None, n("Integer"), "maybe"), (("bot", None, None), ("bot", None, None), "yes"), (("nominal", None, None), n("Integer"), "maybe")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], f"i int, d {c}, g {c}, want string")
    v = accept.verdict(accept.carriers_accept(F.col("d"), F.col("g"), {"Integer": ("Numeric",), "String": (), "Array": ()}))
    assert [(r.i, r.want) for r in df.orderBy("i").collect()] == [(r.i, r.got) for r in df.select("i", v.alias("got")).orderBy("i").collect()]
