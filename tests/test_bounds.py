"""What has no bound, and what is wider beyond one: hierarchies, literals, files."""

import pytest

from plumbline.operators import graph
from plumbline.operators.narrow import Domain, Test, literal_domain, narrow
from plumbline.sources.files import Policy


def test_deep_chain(spark):
    chain = spark.createDataFrame([(f"c{k:02}", f"c{k + 1:02}") for k in range(40)], "child string, parent string")
    out = graph.closure(chain).collect()
    assert len(out) == 41 * 42 // 2 and sum(r.child == "c00" for r in out) == 41
    assert {r.depth for r in out if r.child == "c00" and r.ancestor == "c40"} == {40}


def test_diamonds_and_roots(spark):
    edges = [("a", None), ("lonely", None), ("x", "y"), ("x", "y")]
    edges += [(f"{k}{s}", f"{k + 1}{t}") for k in range(6) for s in "pq" for t in "pq"] + [("0p", "6q"), ("6q", "a")]
    out = graph.closure(spark.createDataFrame(edges, "child string, parent string")).collect()
    assert len({(r.child, r.ancestor) for r in out}) == len(out)
    depth = {(r.child, r.ancestor): r.depth for r in out}
    assert depth["0p", "6q"] == 1 and depth["0p", "a"] == 2 and depth["0q", "a"] == 7 and depth["lonely", "lonely"] == 0 and depth["x", "y"] == 1


def test_cycles_are_errors(spark):
    with pytest.raises(graph.CycleError):
        graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string"))


def test_nearest_of_equal_depth_is_the_first_by_name(spark):
    pairs = spark.createDataFrame([("a", "z", 1), ("a", "y", 1), ("a", "x", 2)], "child string, ancestor string, depth long")
    owned = spark.createDataFrame([("z", "m"), ("y", "m"), ("x", "m")], "owner string, member string")
    assert [tuple(r) for r in graph.nearest(pairs, owned).collect()] == [("a", "m", "y")]


def test_more_than_eight_values_are_no_literals(spark):
    few = spark.createDataFrame([(k % 8, str(k % 8)) for k in range(50)] + [(None, None)], "n int, s string")
    assert literal_domain(few, "n") == Domain(literals=frozenset(range(8)), nil=True)
    many = spark.createDataFrame([(k % 9 + 3, str(k % 9)) for k in range(50)], "n int, s string")
    assert literal_domain(many, "n") == Domain(3, 11) and literal_domain(many, "s") == Domain()
    assert literal_domain(many.limit(0), "n").empty
    truthy, falsey = narrow(literal_domain(many, "n"), Test("==", 3))
    assert truthy.describe() == "3" and falsey.bounds() == (4, 11)


def test_policy_reads_small_files_below_its_roots(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"12345")
    p = Policy([f"{tmp_path}"], most_bytes=5)
    assert p.read(spark, f"{tmp_path}/a.txt") == b"12345"
    with pytest.raises(PermissionError):
        Policy([f"{tmp_path}"], most_bytes=4).read(spark, f"{tmp_path}/a.txt")
    with pytest.raises(PermissionError):
        p.read(spark, f"{tmp_path}/../a.txt")
