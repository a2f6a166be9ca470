"""A table checked against a contract, and the payloads it can name."""

from pyspark.sql import functions as F

from plumbline import api
from plumbline.api import Config, Contract, Member, Use
from plumbline.operators import rules
from plumbline.operators.refine import compile_payload

CONTRACT = Contract({"id": Member("Integer", nullable=False), "name": Member("String", "lowercase-string"), "by": Member("Integer", "int<0, 9>", private=True)}, arity=(2, 3))


def table(spark):
    rows = [(1, "a", 1, ""), (2, "B", 0, ""), (2, "B", 0, ""), (None, None, 99, None), (5, "C", 50, "# plumbline:disable call.*"), (6, "D", 0, "x # plumbline:disable all")]
    return spark.createDataFrame(rows, "id int, name string, by int, note string")


def found(df):
    return sorted((r.line or "", r.column or "", r.rule, r.severity) for r in df.collect())


def test_rows_and_schema(spark):
    out = api.check(table(spark), CONTRACT, Config(comment="note"), Use(reads=("by", "gone"), divisors=("by",)), key=["id"])
    assert found(out) == sorted([
        ("", "gone", "call.undefined-method", "error"), ("", "note", "call.undefined-method", "error"), ("", "by", "def.method-visibility-mismatch", "error"),
        *[("2", "name", "call.argument-type-mismatch", "error"), ("2", "by", "flow.always-raises", "error")] * 2,
        ("nil", "id", "call.possible-nil-receiver", "warning"), ("nil", "by", "call.argument-type-mismatch", "error"), ("nil", "", "call.wrong-arity", "error"),
    ])
    assert api.failed(out) and {r.rule: r.n for r in api.summary(out).collect()}["flow.always-raises"] == 2


def test_configuration(spark):
    config = Config(disable=("call",), overrides={"def": "off", "flow.always-raises": "info"})
    out = api.check(table(spark), CONTRACT, config, Use(reads=("by",), divisors=("by",)))
    assert found(out) == [("", "by", "flow.always-raises", "info")] * 3 and not api.failed(out)
    assert api.check(table(spark), CONTRACT, Config(profile="lenient")).where("rule = 'call.possible-nil-receiver'").isEmpty()


def test_owner_other_class_and_unknown_payload(spark):
    contract = Contract({"id": Member("String"), "by": Member(payload="no-such-name", private=True)}, open=True)
    out = api.check(table(spark), contract, use=Use(reads=("by",), owner=True, returns={"twice": ("id * 2", "int<min, 9>")}), key=["id"])
    assert [(x[:3]) for x in found(out)] == [("", "by", "contract.unresolved-payload"), ("", "id", "call.argument-type-mismatch"), ("5", "twice", "def.return-type-mismatch"), ("6", "twice", "def.return-type-mismatch")]


def test_empty_table_and_odd_names(spark):
    df = table(spark).where("false").withColumn("a.b`c", F.lit("X")).withColumn("line", F.lit(1)).withColumn("tokens", F.lit(1))
    contract = Contract({"a.b`c": Member(payload="lowercase-string")}, open=True)
    assert api.check(df, contract).count() == 0
    one = spark.range(1).select(F.lit("X").alias("a.b`c"), F.lit(1).alias("x"), F.lit("q").alias("rule"))
    assert [r.column for r in api.check(one, contract, key=["x"]).collect()] == ["a.b`c"]
    assert api.check(one, Contract({}, open=True)).count() == 0


def test_payloads(spark):
    df = spark.createDataFrame([(0, [1], {"a": 1}), (5, [], {}), (6, [0], {"A": 1}), (None, None, None), (8, [1, None], {"a": None})], "n int, a array<int>, h map<string,int>")
    holds = lambda payload, c: [r[0] for r in df.select(compile_payload(payload)(F.col(c))).collect()]
    assert holds("int_mask[1, 4]", "n") == [True, True, False, None, False]
    assert holds("int_mask_of[6 | 8]", "n") == [True, False, True, None, True]
    assert holds("Array[positive-int]", "a") == [True, True, False, None, False]
    assert holds("non-empty-hash[lowercase-string, positive-int]", "h") == [True, False, False, None, False]
    assert holds("Tuple[String, int<5, 6>][1]", "n") == [False, True, True, None, False]
    assert compile_payload("Tuple[positive-int][3]") is None and compile_payload("int_mask[positive-int]") is None and compile_payload("Array[positive-int][") is None


def test_suppression_by_project_file_and_line(spark):
    found = spark.createDataFrame([("a", 1, "call.wrong-arity"), ("a", 2, "flow.dead-assignment"), ("b", 1, "call.wrong-arity"), ("b", 1, "call.wrong-arity"), ("b", 2, "dump.type"), (None, None, "dump.type"), ("a", 1, None), ("c", 1, "def.x")], "path string, line int, rule string")
    comments = spark.createDataFrame([("a", 9, "# plumbline:disable-file call"), ("b", 2, "x # plumbline:disable all"), ("b", 2, "# plumbline:disable dump.type"), ("c", 7, "# plumbline:disable def"), ("c", 1, None)], "path string, line int, text string")
    left = lambda *project: sorted((r.path or "", r.line or 0, r.rule or "") for r in rules.suppress(found, comments, project).collect())
    assert left() == [("", 0, "dump.type"), ("a", 1, ""), ("a", 2, "flow.dead-assignment"), ("b", 1, "call.wrong-arity"), ("b", 1, "call.wrong-arity"), ("c", 1, "def.x")]
    assert left("all") == [("a", 1, "")]
    assert left("wrong-arity", "dump-type", "x") == [("a", 1, ""), ("a", 2, "flow.dead-assignment"), ("c", 1, "def.x")]  # "x" is no older name
