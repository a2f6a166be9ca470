"""Queries of the check of a table against a contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import check as K
from ..operators import project as J
from ..operators import rules as U
from ..registry import query, table

_CUSTOMER = K.Contract({"c_custkey": K.Member("Integer", "positive-int", nullable=False), "c_name": K.Member("String", "non-empty-string"), "c_nationkey": K.Member("Float"), "c_acctbal": K.Member("Float", "int<0, max>", private=True), "c_mktsegment": K.Member("String", "lowercase-string"), "c_fax": K.Member("String")})


@query("check_rows", "SELECT 'customer' AS path, CAST(c_custkey AS VARCHAR) AS line, 'c_custkey' AS \"column\", 'error' AS severity, 'call.argument-type-mismatch' AS rule, 'builtin' AS source_family, 'c_custkey is no positive-int' AS message FROM customer WHERE c_custkey < 1 UNION ALL SELECT 'customer' AS path, CAST(c_custkey AS VARCHAR) AS line, 'c_acctbal' AS \"column\", 'error' AS severity, 'call.argument-type-mismatch' AS rule, 'builtin' AS source_family, 'c_acctbal is no int<0, max>' AS message FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_mktsegment', 'error', 'call.argument-type-mismatch', 'builtin', 'c_mktsegment is no lowercase-string' FROM customer WHERE c_mktsegment <> lower(c_mktsegment) UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'cents', 'warning', 'def.return-type-mismatch', 'builtin', 'cents is no int<min, 900000>' FROM customer WHERE c_acctbal * 100 > 900000")
def check_rows(spark, d):
    """Values outside their refinements, and an output outside its domain; findings of the schema are silenced by family and rule."""
    config = K.Config(disable=("call.undefined-method",))
    members = {k: m for k, m in _CUSTOMER.members.items() if k != "c_nationkey"}
    use = K.Use(returns={"cents": ("c_acctbal * 100", "int<min, 900000>")})
    return K.check(table(spark, d, "customer"), K.Contract(members), config, use, path="customer", key=["c_custkey"])


@query("check_schema", "SELECT * FROM (VALUES ('c_fax', 'call.undefined-method', 'error', 'undefined member c_fax'), ('c_phone', 'call.undefined-method', 'error', 'undefined member c_phone'), ('c_nationkey', 'call.argument-type-mismatch', 'info', 'c_nationkey: Integer is no Float'), ('c_acctbal', 'def.method-visibility-mismatch', 'error', 'c_acctbal is private')) t(\"column\", rule, severity, message)")
def check_schema(spark, d):
    """Members that aren't there, another class, a private member read from outside; one rule re-graded."""
    members = {k: K.Member(m.cls, private=m.private) for k, m in _CUSTOMER.members.items()}
    use = K.Use(reads=("c_name", "c_acctbal", "c_phone"))
    config = K.Config(overrides={"call.argument-type-mismatch": "info"})
    return K.check(table(spark, d, "customer"), K.Contract(members, open=True), config, use).select("column", "rule", "severity", "message")


@query("check_summary", "SELECT 'call.wrong-arity' AS rule, 'error' AS severity, CAST(count(*) AS BIGINT) AS n FROM documents WHERE CAST(text IS NOT NULL AS INT) + CAST(lang IS NOT NULL AS INT) + CAST(source IS NOT NULL AS INT) < 3 HAVING count(*) > 0 UNION ALL SELECT 'call.possible-nil-receiver', 'warning', CAST(sum(n) AS BIGINT) FROM (SELECT CAST(text IS NULL AS INT) + CAST(lang IS NULL AS INT) AS n FROM documents) HAVING sum(n) > 0 UNION ALL SELECT 'call.argument-type-mismatch', 'info', CAST(count(*) AS BIGINT) FROM documents WHERE source <> lower(source) OR source = '' HAVING count(*) > 0 UNION ALL SELECT 'call.undefined-method', 'error', CAST(1 AS BIGINT)")
def check_summary(spark, d):
    """Counts by rule over all documents; one member is declared that no table has."""
    contract = K.Contract({"text": K.Member(nullable=False), "lang": K.Member(nullable=False), "source": K.Member("String", "non-empty-lowercase-string"), "licence": K.Member()}, arity=(3, None), open=True)
    return K.summary(K.check(table(spark, d, "documents"), contract, K.Config(overrides={"call.argument-type-mismatch": "info"})))


_PROJECT = {
    "tables": {
        "customer": {"key": ["c_custkey"], "open": True, "members": {"c_custkey": {"class": "Integer", "payload": "positive-int", "nullable": False}, "c_acctbal": "int<0, max>", "c_fax": None}},
        "documents": {"key": ["doc_id"], "open": True, "members": {"text": {"nullable": False}, "lang": {"class": "String", "nullable": False}, "n_chars": {"class": "Integer", "payload": "int<0, 5000>"}}},
        "lineitem": {"key": ["l_orderkey", "l_linenumber"], "open": True, "divisors": ["l_linenumber"], "returns": {"net": ["l_extendedprice * (1 - l_discount)", "int<min, 90000>"]}},
        "absent": {"members": {"x": "positive-int"}},
    },
    "severity": {"call.argument-type-mismatch": "info"},
}


@query("check_project", "WITH f AS (SELECT 'customer' AS path, 'info' AS severity, 'call.argument-type-mismatch' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'customer', 'info', 'call.argument-type-mismatch' FROM customer WHERE c_custkey < 1 UNION ALL SELECT 'customer', 'error', 'call.undefined-method' UNION ALL SELECT 'documents', 'warning', 'call.possible-nil-receiver' FROM documents WHERE text IS NULL UNION ALL SELECT 'documents', 'warning', 'call.possible-nil-receiver' FROM documents WHERE lang IS NULL UNION ALL SELECT 'documents', 'info', 'call.argument-type-mismatch' FROM documents WHERE n_chars < 0 OR n_chars > 5000 UNION ALL SELECT 'lineitem', 'warning', 'def.return-type-mismatch' FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000 UNION ALL SELECT 'lineitem', 'error', 'flow.always-raises' FROM lineitem WHERE l_linenumber = 0 UNION ALL SELECT 'absent', 'error', 'path.missing') SELECT path, severity, rule, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2, 3")
def check_project(spark, d):
    """Four tables by one configuration, of which one isn't there."""
    return J.check_all(spark, _PROJECT, d).groupBy("path", "severity", "rule").agg(F.count("*").alias("n"))


@query("suppression_levels", "WITH d AS (SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS line, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'call.wrong-arity' ELSE 'flow.dead-assignment' END AS rule FROM lineitem) SELECT d.* FROM d LEFT JOIN orders o ON o.o_orderkey = d.path WHERE NOT coalesce(o.o_orderstatus = 'F' AND d.rule = 'call.wrong-arity', false) AND NOT coalesce(o.o_orderstatus = 'O' AND d.line = 1, false)")
def suppression_levels(spark, d):
    """Orders as files: those of one status silence a family in all their lines, those of another everything in their first."""
    odd = F.col("l_linenumber") % 2 == 0
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("line"), "l_partkey", F.when(odd, "call.wrong-arity").otherwise("flow.dead-assignment").alias("rule"))
    text = F.when(F.col("o_orderstatus") == "F", "# plumbline:disable-file call.*").when(F.col("o_orderstatus") == "O", "# plumbline:disable all")
    return U.suppress(found, table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit(1).cast("long").alias("line"), text.alias("text")))
