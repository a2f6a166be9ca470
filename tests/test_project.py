"""A configuration over several tables: diagnostics, baseline, formats and status."""

import json

import pytest

from plumbline.operators import project as J


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    spark.createDataFrame([(1, "a", "x"), (2, None, "X"), (None, "c", None)], "id int, name string, code string").write.parquet(f"{at}/one.parquet")
    spark.createDataFrame([(1, 0), (2, 5)], "id int, n int").write.parquet(f"{at}/deep/two")
    base = {"tables": {"one": {"key": ["id"], "open": True, "members": {"name": {"nullable": False}, "code": "lowercase-string"}}}}
    (at / "base.json").write_text(json.dumps(base))
    (at / "main.json").write_text(json.dumps({"includes": "base.json", "tables": {"two": {"path": "deep/two", "key": ["id"], "open": True, "divisors": ["n"]}}, "severity": {"call.possible-nil-receiver": "info"}}))
    (at / "known.json").write_text(json.dumps({"diagnostics": [{"path": "one", "line": 2, "column": "code", "rule": "call.argument-type-mismatch"}, {"path": "two", "rule": "flow.always-raises"}]}))
    return str(at)


def found(df):
    return sorted((r.path, r.line, r["column"], r.severity, r.rule) for r in df.collect())


ALL = [("one", "2", "code", "error", "call.argument-type-mismatch"), ("one", "2", "name", "info", "call.possible-nil-receiver"), ("two", "1", "n", "error", "flow.always-raises")]


def test_tables_of_a_configuration(spark, root):
    config = J.read_config(spark, f"{root}/main.json")
    assert found(J.check_all(spark, config, root)) == ALL
    assert found(J.check_all(spark, {**config, "baseline": "known.json"}, root)) == ALL[1:]  # an entry without a line is one about the table
    assert found(J.check_all(spark, {**config, "disable": ["flow"]}, root)) == ALL[:2]
    assert J.check_all(spark, {}, root).count() == 0


def test_formats_and_status(spark, root, tmp_path):
    config = J.read_config(spark, f"{root}/main.json")
    assert J.run(spark, config, f"{tmp_path}/a", root=root, as_json=False) == 1
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/a/text").collect())
    assert [x.rsplit(": ", 1)[0] for x in lines] == ["one:2: error: call.argument-type-mismatch", "one:2: info: call.possible-nil-receiver", "two:1: error: flow.always-raises"]
    quiet = {**config, "disable": ["flow", "call.argument-type-mismatch"]}
    assert J.run(spark, quiet, f"{tmp_path}/b", root=root) == 0
    assert spark.read.json(f"{tmp_path}/b/diagnostics").count() == 1
    gone = {"tables": {"nowhere": {"members": {"x": None}}}}
    assert found(J.check_all(spark, gone, root)) == [("nowhere", None, None, "error", "path.missing")] and J.run(spark, gone, f"{tmp_path}/c", root=root) == 1


@pytest.mark.parametrize("bad", [{"table": {}}, {"tables": {"one": {"colour": 1}}}, {"tables": {"one": {"members": {"id": {"typ": "x"}}}}}, {"severity": {"call": "loud"}}, {"profile": "wild"}])
def test_mistakes_are_told(spark, root, bad):
    with pytest.raises(ValueError):
        J.check_all(spark, bad, root)
