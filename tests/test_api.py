"""The user's calls, plugins and plan-level evaluation on odd input."""

import pytest
from pyspark.sql import functions as F

from plumbline import api
from plumbline.functions import unicode as U
from plumbline.operators.narrow import Test
from plumbline.operators.rules import isolated
from plumbline.plans import acceptance as A
from plumbline.plans import expressions as X
from plumbline.plans import lattice as L
from plumbline.plugins import Manifest, Registry
from plumbline.sources import files as S


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "a", None), (2, "", 5), (30, None, -1)], "n int, s string, m int")


def test_type_of(df):
    r = api.type_of(df, "n + 1").first()
    assert (r.cls, r.lo, r.hi, r.literals) == ("Integer", 2, 31, "2|3|31")


def test_assert_domain(df):
    assert api.assert_domain(df, "n", "positive-int") is df
    assert api.assert_domain(df, "m", "int<-1, 5>") is df  # nulls are no values
    with pytest.raises(api.DomainError):
        api.assert_domain(df, "s", "non-empty-string")
    with pytest.raises(ValueError):
        api.assert_domain(df, "s", "no-such-name")


def test_contracts_in_metadata(df):
    d = api.declared(df, n="int<1, 9>", m="int<0, 9> | nil")
    assert [r.n for r in d.where(api.contract_filter(d)).collect()] == [1, 2]


def test_narrowed_edges_cover_all_rows(df):
    yes, no = api.narrowed(df, "m", Test(">", 0))
    assert (yes.count(), no.count()) == (1, 2)


def test_infer_and_diff(spark, df):
    found = {r.col: r for r in api.infer_contract(df, "t").collect()}
    assert found["n"].n_null == 0 and found["s"].literals == "|a" and found["m"].lo == -1
    have = spark.createDataFrame([("n", "Integer", 1, 30), ("m", "Integer", -9, 9)], "col string, cls string, lo long, hi long")
    assert {r.col: r.verdict for r in api.infer_contract(df, "t", have).collect()} == {"n": "equivalent", "m": "tighter", "s": "new"}
    a = spark.createDataFrame([("p", 1, "r")], "path string, line int, rule string")
    assert api.diff(a, a).count() == 0


def test_empty_table(spark):
    r = api.infer_contract(spark.createDataFrame([], "n int, s string"), "t").collect()
    assert [(x.n, x.lo, x.literals) for x in r] == [(0, None, None), (0, None, None)]


def test_explain():
    assert len(api.explain()) == 13 and [r for r, _, _ in api.explain("dump.type")] == ["dump.type"] and api.explain("nothing") == []


@pytest.mark.parametrize("text,after", [("", ""), ("az", "ba"), ("Zz", "AAa"), ("a9", "b0"), ("zZ9", "aaA0"), ("1.9", "2.0"), ("-9", "-10"), ("a-9", "a-10"), ("<<koala>>", "<<koalb>>"), ("***", "**+")])
def test_successors(text, after):
    assert U.successor(text) == after


def test_normal_forms(spark):
    r = spark.range(1).select(U.unicode_normalize(F.lit("é")).alias("c"), U.unicode_normalize(F.lit(None).cast("string")).alias("n")).first()
    assert (r.c, r.n) == ("é", None)


def test_folding_leaves_raising_pairs_out():
    two, zero_one = L.union(L.Constant(4), L.Constant(6)), L.union(L.Constant(0), L.Constant(2))
    assert L.describe(X.fold("/", two, zero_one)) == "2 | 3"
    assert X.fold("/", two, L.Constant(0)) is None
    assert X.fold("+", L.union(*map(L.Constant, range(7))), L.union(*map(L.Constant, range(5)))) is None  # 35 pairs


def test_type_functions_end():
    grow = {"f": lambda x: L.App("f", (L.Nominal("Array", (x,)),), L.Nominal("Object"))}
    assert X.reduce_app(L.App("f", (L.Top(),), L.Top()), grow, fuel=5) == L.Nominal("Object")


@pytest.mark.parametrize("t", [L.Nominal("Integer"), L.Constant(1), L.IntegerRange(0, None), L.Tuple((L.Constant(1),)), L.union(L.Constant(1), L.Constant("a")), L.Shape((L.Field("a", L.Top()),))])
def test_acceptance_is_reflexive_and_bounded(t):
    assert A.accepts(t, t) == A.accepts(L.Top(), t) == A.accepts(t, L.Bot()) == A.YES and A.accepts(L.Bot(), t) == A.NO


def test_plugins():
    r = Registry()
    r.add(Manifest("a"), return_type=lambda c: None)
    with pytest.raises(ValueError):
        r.add(Manifest("a"))
    assert r.return_type("x") is None and r.expand("none", "x") == [] and r.facts.read("a", "b") is None


def test_isolation(spark, df):
    assert isolated("p", lambda d: d.select("missing"), df).first().rule == "plugin-runtime-error"
    assert isolated("p", lambda d: d, df).collect() == df.collect()
    late = isolated("p", lambda d: d.selectExpr("raise_error('late') AS x"), df).first()
    assert late.path == "p" and late.rule == "plugin-runtime-error"


def test_files(spark, tmp_path):
    (tmp_path / "a.rb").write_text("x")
    (tmp_path / "b.rb").write_text("bad")
    files = spark.read.format("binaryFile").load(str(tmp_path))

    def analyse(path, content):
        if content == b"bad":
            raise RuntimeError
        return [(1, content.decode())]

    out = {r.path.rsplit("/", 1)[1]: (r.line, r.message) for r in S.analyse_files(files, analyse).collect()}
    assert out == {"a.rb": (1, "x"), "b.rb": (0, "internal-error: RuntimeError")}


def test_contracts_stay_below_their_root(spark):
    d = spark.createDataFrame([("a", "b")], "member string, type string")
    with pytest.raises(ValueError):
        S.write_contracts(d, d, "member", "/elsewhere/x", "/root-of-contracts")
