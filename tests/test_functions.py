"""Operators on edges that the tables don't have: nulls, zero, empty, infinite, negative, ill-formed."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import collections_ as C
from plumbline.functions import numeric as M
from plumbline.functions import text as T
from plumbline.operators import envjoin as E
from plumbline.operators import graph as G
from plumbline.operators import intervals as I
from plumbline.operators import narrow as N
from plumbline.operators import refine as R
from plumbline.operators import rules as U
from plumbline.operators.narrow import Domain, Test
from plumbline.plans import lattice as L
from plumbline.sources import files as S


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize("a,b", [(7, 2), (-7, 2), (7, -2), (-7, -2), (6, -3), (0, 5), (-(2**62) - 1, 3)])
def test_floor_division(spark, a, b):
    x, y = F.lit(a).cast("long"), F.lit(b).cast("long")
    assert one(spark, M.floor_div(x, y), M.floor_mod(x, y)) == (a // b, a % b)


def test_division_by_zero_is_null(spark):
    x, z = F.lit(1).cast("long"), F.lit(0).cast("long")
    assert one(spark, M.floor_div(x, z), M.floor_mod(x, z)) == (None, None)


@pytest.mark.parametrize("n", [0, 1, -1, 255, 256, -256, -257, 2**62])
def test_bit_length(spark, n):
    assert one(spark, M.bit_length(F.lit(n).cast("long")))[0] == (n if n >= 0 else -n - 1).bit_length()


def test_mask_closure():
    assert M.mask_closure([1, 2]) == [0, 1, 2, 3]
    assert M.mask_closure([1, 2, 4, 8, 16]) == (0, 31)
    assert M.mask_closure(list(range(7))) is None


@pytest.mark.parametrize("text,stripped", [("\t a \n", "a"), ("\x00x\x00", "x"), ("", ""), (" \r\n", "")])
def test_strip(spark, text, stripped):
    assert one(spark, T.strip(F.lit(text)))[0] == stripped


def test_split_drops_trailing_empties(spark):
    assert one(spark, T.split_on(F.lit("a,b,,"), ","), T.split_on(F.lit(",a"), ","), T.split_on(F.lit(""), ",")) == (["a", "b"], ["", "a"], [])


def test_padding_and_partition(spark):
    x = F.lit("abc")
    assert one(spark, T.pad(x, 6, "12", "left"), T.pad(x, 6, "12", "right"), T.pad(x, 2, ".", "center")) == ("abc121", "121abc", "abc")
    assert tuple(one(spark, T.partition(F.lit("a.b.c"), "."))[0]) == ("a", ".", "b.c")
    assert tuple(one(spark, T.partition(F.lit("a.b.c"), ".", last=True))[0]) == ("a.b", ".", "c")
    assert tuple(one(spark, T.partition(F.lit("abc"), ".", last=True))[0]) == ("", "", "abc")


@pytest.mark.parametrize("path,base,directory,ext", [("/a/b.rb", "b.rb", "/a", ".rb"), ("b", "b", ".", ""), ("/", "/", "/", ""), ("/a/", "a", "/", ""), (".profile", ".profile", ".", ""), ("a/b.tar.gz", "b.tar.gz", "a", ".gz")])
def test_paths(spark, path, base, directory, ext):
    c = F.lit(path)
    assert one(spark, T.basename(c), T.dirname(c), T.extname(c)) == (base, directory, ext)


def test_arrays_with_nulls_and_nothing(spark):
    empty = F.array().cast("array<bigint>")
    some = F.array(F.lit(1).cast("long"), F.lit(None).cast("long"))
    assert one(spark, C.first(empty), C.last(empty), C.at(some, -3), C.total(empty)) == (None, None, None, 0)
    assert one(spark, C.any_(some, lambda x: x > 5), C.all_(empty, lambda x: x > 5), C.none_(some, lambda x: x > 0)) == (False, True, False)
    assert one(spark, C.take_while(empty, lambda x: x > 0), C.drop_while(some, lambda x: x > 0), C.each_cons(empty, 2), C.each_slice(empty, 2)) == ([], [None], [], [])
    assert one(spark, C.times(F.lit(0)), C.upto(F.lit(2).cast("long"), F.lit(1).cast("long")), C.slice_(some, 3, 1), C.slice_(some, 2, 1)) == ([], [], None, [])


def test_records(spark):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1))
    assert one(spark, C.record_invert(m))[0] is None
    assert one(spark, C.record_merge(m, F.create_map(F.lit("b"), F.lit(2), F.lit("c"), F.lit(3))))[0] == {"a": 1, "b": 2, "c": 3}


@pytest.mark.parametrize("name,value,holds", [("decimal-int-string", "12\n", False), ("decimal-int-string", "-12", True), ("numeric-string", "1.", False), ("octal-int-string", "08", False), ("hex-int-string", "0xFg", False), ("hex-int-string", "-0XfF", True), ("lowercase-string", "ß", True)])
def test_refinements(spark, name, value, holds):
    assert one(spark, R.NAMES[name](F.lit(value)))[0] is holds


def test_complement_keeps_null(spark):
    assert one(spark, R.complement("numeric-string")(F.lit(None).cast("string")))[0] is None


@pytest.mark.parametrize("text", ["int<1", "a |", "[x]", "int<1,,2>", "é"])
def test_bad_payloads(text):
    assert R.parse(text) is None


def test_resolvers_come_first(spark):
    f = R.compile_payload("even-int", (lambda n: (lambda c: c % 2 == 0) if n.name == "even-int" else None,))
    assert one(spark, f(F.lit(4)), f(F.lit(3))) == (True, False)
    assert R.compile_payload("nothing-known") is None


def test_captures():
    assert R.capture_refinement(r"\d+") == "decimal-int-string"
    assert R.capture_refinement(r"\d*") is None and R.capture_refinement(r"[a-z]{0,3}") is None and R.capture_refinement(r"[a-z]{3,1}") is None
    assert R.capture_refinement(r"\h{2}") == "hex-int-string"


def bounds(spark, i):
    return one(spark, i.lo, i.hi)


def iv(lo, hi):
    return I.Interval(F.lit(lo).cast("long"), F.lit(hi).cast("long"))


def test_unbounded_products(spark):
    assert bounds(spark, I.multiply(iv(0, None), iv(-3, -1))) == (None, 0)
    assert bounds(spark, I.multiply(iv(None, None), iv(0, 0))) == (0, 0)
    assert bounds(spark, I.multiply(iv(2, None), iv(3, None))) == (6, None)


def test_division_over_zero_has_no_answer(spark):
    ok, q = I.divide(iv(1, 5), iv(-1, 1))
    assert one(spark, ok, q.lo) == (False, None)


def test_halves_and_absolute(spark):
    assert one(spark, I.halves(iv(None, 3)), I.halves(iv(None, None)))[1] == []
    assert bounds(spark, I.absolute(iv(-5, None))) == (0, None)


@pytest.mark.parametrize("op", list(N.OPPOSITE))
def test_narrowing_is_sound(op):
    d = Domain(-4, 6)
    for v in range(-6, 9):
        truthy, falsey = N.narrow(d, Test(op, v))
        for x in range(-4, 7):
            side = truthy if N._COMPARE[op](x, v) else falsey
            assert not side.empty and (side.lo is None or x >= side.lo) and (side.hi is None or x <= side.hi)


def test_nil_stays_on_the_falsey_edge():
    truthy, falsey = N.narrow(Domain(1, 5, nil=True), Test("<", 3))
    assert not truthy.nil and falsey.nil
    assert N.narrow(Domain(1, 5, nil=True), Test("nil"))[0].describe() == "nil"


def test_union_is_normal():
    assert L.union(L.Constant(2), L.Constant(1), L.Constant(2)) == L.Union((L.Constant(1), L.Constant(2)))
    assert L.erase(L.Union((L.Dynamic(), L.Nominal("Integer")))) == "untyped"


def test_cycles_and_missing_producers():
    with pytest.raises(G.CycleError):
        G.topological(["a", "b"], {"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError):
        G.topological(["a"], {"a": ["z"]})


def test_null_rules_are_never_suppressed(spark):
    assert one(spark, U.suppressed(F.lit(None).cast("string"), F.array(F.lit("all"))), U.suppressed(F.lit("flow.x"), F.array(F.lit("flow")))) == (False, True)


def test_diff_keeps_repeats_and_equates_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, rule string")
    b = spark.createDataFrame([(2, "x"), (3, None)], "k int, rule string")
    assert sorted(map(tuple, U.diff(a, b, ["k", "rule"]).collect())) == [("fixed", 3, None), ("new", 1, None), ("new", 1, None)]


def test_tier_conflicts(spark):
    rows = [("f", "builtin", None, 0, 0, 10), ("f", "plugin", "p", 0, 20, 30), ("f", "other", None, 0, 5, 50)]
    df = spark.createDataFrame(rows, "call string, provider string, plugin string, idx int, lo long, hi long")
    assert tuple(E.merge_tiers(df).first()) == ("f", 5, 10, 1, "builtin")


def test_config_cycle_is_an_error():
    with pytest.raises(ValueError):
        S.load_config("a", {"a": {"includes": "b"}, "b": {"includes": "a"}}.__getitem__)


@pytest.mark.parametrize("glob,path,holds", [("**/*.rb", "a/b/c.rb", True), ("**/*.rb", "c.rb", True), ("*.rb", "a/c.rb", False), ("{a,b}/?.x", "b/1.x", True), ("a/**", "a/b/c", True)])
def test_globs(spark, glob, path, holds):
    assert one(spark, F.lit(path).rlike(S.glob_pattern(glob)))[0] is holds
