"""Plan-level analysis of small programs, evaluated on the driver, against expected types. They read no table, so they are cases for tests and no queries."""

from __future__ import annotations

from ..operators.narrow import Test
from ..plans import expressions as X
from ..plans import lattice as L

CASES = {}
EXPECTED = {}


def case(name, sql):
    def add(f):
        CASES[name], EXPECTED[name] = f, sql
        return f

    return add


def _rows(spark, pairs):
    return spark.createDataFrame([(k, L.describe(v) if not isinstance(v, (str, bool)) else str(v).lower() if isinstance(v, bool) else v) for k, v in pairs], "subject string, type string")


def _values(pairs: dict[str, str]) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in pairs.items()) + ") t(subject, type)"


def lit(v):
    return ("literal", v)


@case("plan_literals", _values({"integer": "1", "float": "1.5", "string": '"a"', "true": "true", "false": "false", "nil": "nil", "array": '[1, "a"]', "hash": "{ a: 1, b: [2] }", "interpolated": '"x1"', "unknown": "Dynamic[top]", "range": "Range[int<1, 3>]"}))
def plan_literals(spark, d):
    nodes = {"integer": lit(1), "float": lit(1.5), "string": lit("a"), "true": lit(True), "false": lit(False), "nil": lit(None), "array": ("array", lit(1), lit("a")), "hash": ("hash", ("a", lit(1)), ("b", ("array", lit(2)))), "interpolated": ("interpolate", lit("x"), lit(1)), "unknown": ("read", "nowhere"), "range": ("range", lit(1), lit(3))}
    return _rows(spark, [(k, X.type_of(n, {})) for k, n in nodes.items()])


@case("plan_calls", _values({"fold": "7", "floor": "-4", "union": "2 | 3", "widened": "int<2, 20>", "interval": "int<4, 8>", "size": "2", "first": "1", "last": "nil", "shape": '"x"', "missing": "nil", "class": "singleton(Integer)", "new": "Foo", "string size": "non-negative-int", "non-empty size": "positive-int", "zero": "Dynamic[top]"}))
def plan_calls(spark, d):
    env = {"r": L.IntegerRange(1, 5), "u": L.union(L.Constant(1), L.Constant(2)), "w": L.union(*map(L.Constant, range(1, 11))), "v": L.union(*map(L.Constant, (1, 10, 5))), "s": L.Nominal("String"), "e": L.Difference(L.Nominal("String"), L.Constant("")), "c": L.Singleton("Foo")}
    call = lambda r, op, *a: ("call", r, op, *a)
    nodes = {
        "fold": call(lit(3), "+", lit(4)), "floor": call(lit(-7), "/", lit(2)), "union": call(("read", "u"), "+", lit(1)), "widened": call(("read", "w"), "+", ("read", "v")), "interval": call(("read", "r"), "+", ("literal", 3)), "size": call(("array", lit(1), lit(2)), "size"),
        "first": call(("array", lit(1)), "first"), "last": call(("array",), "last"), "shape": call(("hash", ("a", lit("x"))), "[]", lit("a")), "missing": call(("hash", ("a", lit("x"))), "[]", lit("b")), "class": call(lit(1), "class"), "new": call(("read", "c"), "new"),
        "string size": call(("read", "s"), "size"), "non-empty size": call(("read", "e"), "size"), "zero": call(lit(1), "/", lit(0)),
    }
    return _rows(spark, [(k, X.type_of(n, env)) for k, n in nodes.items()])


@case("plan_flow", _values({"if type": "1 | 2", "x after if": "1 | nil", "narrowed": "int<1, 4>", "elided": "1", "a": "1", "rest": "[2, 3]", "z": "4", "short a": "1", "short z": "nil", "and": "2", "or": "1", "write": "5"}))
def plan_flow(spark, d):
    env = {"n": L.IntegerRange(1, 9)}
    t, after = X.evaluate(("if", "n", Test("<", 5), ("write", "x", lit(1)), lit(2)), env)
    narrowed, _ = X.evaluate(("if", "n", Test("<", 5), ("read", "n"), ("read", "n")), {"n": L.IntegerRange(1, 4)})
    elided, _ = X.evaluate(("if", "n", Test(">", 0), lit(1), lit(2)), env)
    _, m = X.evaluate(("multi", ("a", "*rest", "z"), ("array", lit(1), lit(2), lit(3), lit(4))), {})
    _, short = X.evaluate(("multi", ("a", "z"), ("array", lit(1))), {})
    _, w = X.evaluate(("statements", ("write", "y", lit(4)), ("write", "y", ("call", ("read", "y"), "+", lit(1)))), {})
    return _rows(spark, [("if type", t), ("x after if", after["x"]), ("narrowed", narrowed), ("elided", elided), ("a", m["a"]), ("rest", m["rest"]), ("z", m["z"]), ("short a", short["a"]), ("short z", short["z"]), ("and", X.type_of(("and", lit(1), lit(2)), {})), ("or", X.type_of(("or", lit(1), lit(2)), {})), ("write", w["y"])])


@case("plan_literal_strings", _values({"concat": "true", "concat unknown": "false", "repeat": "true", "repeat negative": "false", "join": "true", "format": "true", "strip": "true", "ljust": "true", "interpolate": "true", "interpolate unknown": "false", "upcase": "false"}))
def plan_literal_strings(spark, d):
    env = {"s": L.Nominal("String"), "k": L.Refined(L.Nominal("String"), "literal")}
    call = lambda r, op, *a: ("call", r, op, *a)
    nodes = {"concat": call(lit("a"), "+", ("read", "k")), "concat unknown": call(lit("a"), "+", ("read", "s")), "repeat": call(lit("a"), "*", lit(3)), "repeat negative": call(lit("a"), "*", lit(-1)), "join": call(("array", lit("a"), ("read", "k")), "join", lit(",")), "format": call(lit("%s"), "%", ("array", lit("x"))), "strip": call(("read", "k"), "strip"), "ljust": call(("read", "k"), "ljust", lit(9)), "interpolate": ("interpolate", lit("a"), ("read", "k")), "interpolate unknown": ("interpolate", lit("a"), ("read", "s")), "upcase": call(("read", "k"), "upcase")}
    return _rows(spark, [(k, X.literal(n, env)) for k, n in nodes.items()])


@case("plan_normalisation", _values({"union flat": "1 | 2 | Integer", "union bot": "1", "union none": "bot", "union top": "top", "intersection": "lowercase-string & non-empty-string", "intersection bot": "bot", "erased": "Integer", "erased untyped": "untyped", "tuple": "[1, String]", "open": "{ a: 1, ... }", "dynamic": "Dynamic[Integer]", "app": "App[json::value, String]"}))
def plan_normalisation(spark, d):
    i, s = L.Nominal("Integer"), L.Nominal("String")
    return _rows(spark, [
        ("union flat", L.union(L.union(i, L.Constant(2)), L.Constant(1), i)), ("union bot", L.union(L.Bot(), L.Constant(1))), ("union none", L.union()), ("union top", L.union(L.Top(), i)),
        ("intersection", L.intersection(L.Difference(s, L.Constant("")), L.Refined(s, "lowercase"))), ("intersection bot", L.intersection(s, L.Bot())), ("erased", L.erase(L.union(L.Constant(1), L.IntegerRange(5, 9)))), ("erased untyped", L.erase(L.union(L.Dynamic(), i))),
        ("tuple", L.Tuple((L.Constant(1), s))), ("open", L.Shape((L.Field("a", L.Constant(1)),), open=True)), ("dynamic", L.Dynamic(i)), ("app", L.App("json::value", (s,))),
    ])


@case("plan_type_functions", _values({"reduced": "Array[Integer]", "knot": "String", "unknown": "top"}))
def plan_type_functions(spark, d):
    i, s = L.Nominal("Integer"), L.Nominal("String")
    bodies = {"list": lambda x: L.Nominal("Array", (x,)), "loop": lambda x: L.App("loop", (x,), s), "twice": lambda x: L.App("list", (x,))}
    return _rows(spark, [("reduced", X.reduce_app(L.App("twice", (i,)), bodies)), ("knot", X.reduce_app(L.App("loop", (i,), s), bodies)), ("unknown", X.reduce_app(L.App("other", (i,)), bodies))])


@case("plan_statements", _values({"case": "1 | 2 | 3", "case else": "int<21, 50>", "unless": "2", "op write": "6", "or write": "7", "and write": "nil", "rescue": "1 | 2", "ensured": "3", "loop": "1 | 2", "for": "10 | 20", "early exit": "int<1, 4>", "defined": "String | nil", "def": '"name"', "lambda": "Proc", "jump": "bot"}))
def plan_statements(spark, d):
    env = {"n": L.IntegerRange(1, 50)}
    run = lambda node, e=env: X.evaluate(node, e)
    case = ("case", "n", ((Test("<", 10), lit(1)), (Test("between", (10, 20)), lit(2))), lit(3))
    # what the arms leave to the else: below 10 is gone; between leaves its falsey edge whole, so a second test is needed
    rest = ("case", "n", ((Test("<", 10), lit(1)), (Test("<=", 20), lit(2))), ("read", "n"))
    begin = ("begin", ("write", "x", lit(1)), (("write", "x", lit(2)),), ("write", "done", lit(3)))
    exit_ = ("if", "n", Test(">=", 5), ("jump",), ("read", "n"))
    types = {
        "case": run(case)[0], "case else": run(("case", "n", ((Test("<", 10), ("jump",)), (Test("<=", 20), ("jump",))), ("read", "n")))[0], "unless": run(("unless", "n", Test(">", 0), lit(1), lit(2)))[0], "op write": run(("op_write", "k", "+", lit(1)), {"k": L.Constant(5)})[1]["k"], "or write": run(("or_write", "z", lit(7)))[1]["z"], "and write": run(("and_write", "z", lit(7)))[1]["z"],
        "rescue": run(begin)[1]["x"], "ensured": run(begin)[1]["done"], "loop": run(("loop", ("write", "i", lit(2))), {"i": L.Constant(1)})[1]["i"], "for": run(("for", "e", ("array", lit(10), lit(20)), ("write", "last", ("read", "e"))), {"last": L.Constant(10)})[1]["last"], "early exit": run(exit_)[0], "defined": run(("defined", "x"))[0], "def": run(("def", "name"))[0], "lambda": run(("lambda",))[0], "jump": run(("jump",))[0],
    }
    assert L.describe(run(rest)[0]) == "1 | 2 | int<21, 50>"
    return _rows(spark, list(types.items()))


@case("plan_closures", _values({"Array#each": "non_escaping", "Integer#times": "non_escaping", "Object#tap": "non_escaping", "Thread#new": "escaping", "Foo#bar": "unknown", "kept": "1", "dropped": "Integer"}))
def plan_closures(spark, d):
    env, declared = {"x": L.Constant(1)}, {"x": L.Nominal("Integer")}
    rows = [(f"{c}#{m}", X.escape(c, m)) for c, m in (("Array", "each"), ("Integer", "times"), ("Object", "tap"), ("Thread", "new"), ("Foo", "bar"))]
    return _rows(spark, [*rows, ("kept", X.after_block(env, declared, ("x",), "Array", "each")["x"]), ("dropped", X.after_block(env, declared, ("x",), "Thread", "new")["x"])])


@case("plan_bound_methods", _values({"bound": "Method", "call": "7", "index": "7", "curry": "7", "unknown": "Dynamic[top]"}))
def plan_bound_methods(spark, d):
    call = lambda r, op, *a: ("call", r, op, *a)
    plus = call(lit(3), "method", lit("+"))
    nodes = {"bound": plus, "call": call(plus, "call", lit(4)), "index": call(plus, "[]", lit(4)), "curry": call(call(plus, "curry"), "call", lit(4)), "unknown": call(call(lit(3), "method", lit("other")), "call")}
    return _rows(spark, [(k, X.type_of(n, {})) for k, n in nodes.items()])


_JSON = "Array[App[json::value, {0}]] | Float | Hash[{0}, App[json::value, {0}]] | Integer | String | false | nil | true"


@case("plan_structured_text", _values({"json": _JSON.format("String"), "symbols": _JSON.format("Symbol"), "yaml": "Array[App[json::value, String]] | Date | Float | Hash[String, App[json::value, String]] | Integer | String | false | nil | true", "csv": "Array[Array[String | nil]]", "csv headers": "nothing", "yaml load": "nothing"}))
def plan_structured_text(spark, d):
    option = lambda k, v: L.Shape((L.Field(k, v),))
    types = {"json": X.structured("JSON", "parse"), "symbols": X.structured("JSON", "load_file", option("symbolize_names", L.Constant(True))), "yaml": X.structured("YAML", "safe_load", option("permitted_classes", L.Tuple((L.Singleton("Date"),)))), "csv": X.structured("CSV", "read"), "csv headers": X.structured("CSV", "parse", option("headers", L.Constant(True))), "yaml load": X.structured("YAML", "load")}
    return _rows(spark, [(k, "nothing" if t is None else t) for k, t in types.items()])
