"""Queries of decisions over domains: projections of refinements, payloads of containers, members' contracts, complements, constant conditions, differences by all fields, carriers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accept as A
from ..operators import contracts as K
from ..operators import graph as G
from ..operators import narrow as N
from ..operators import refine as R
from ..operators import rules as U
from ..registry import query, table

_PAYLOADS = {
    "key_of[Hash[int<1, 9>, lowercase-string]]": "p_size BETWEEN 1 AND 9", "value_of[non-empty-hash[positive-int, int<30, max>]]": "p_size >= 30", "Hash[lowercase-string, int<5, 7> | 40][\"k\"]": "(p_size BETWEEN 5 AND 7 OR p_size = 40)", "Array[negative-int | 3][0]": "p_size = 3",
    "value_of[Tuple[int<1, 4>, 40, 41]]": "(p_size BETWEEN 1 AND 4 OR p_size IN (40, 41))", "key_of[Tuple[nil, nil, nil]]": "p_size BETWEEN 0 AND 2", "key_of[Array[nil]] ": "p_size >= 0",
}


@query("ref_containers", "SELECT payload, CAST(n AS BIGINT) AS n FROM (SELECT unnest([" + ", ".join(f"{{'payload': '{k}', 'n': a[{i + 1}]}}" for i, k in enumerate(_PAYLOADS)) + "], recursive := true) FROM (SELECT [" + ", ".join(f"count_if({v})" for v in _PAYLOADS.values()) + "] AS a FROM part))")
def ref_containers(spark, d):
    """Keys, values and elements of containers' payloads, each held against part sizes in one aggregate."""
    tests = [F.count_if(R.compile_payload(k)(F.col("p_size"))).alias(f"n{i}") for i, k in enumerate(_PAYLOADS)]
    return table(spark, d, "part").agg(*tests).select(F.inline(F.array(*[F.struct(F.lit(k).alias("payload"), F.col(f"n{i}").alias("n")) for i, k in enumerate(_PAYLOADS)])))


_TEXTS = {"low": "lowercase-string", "up": "uppercase-string", "number": "numeric-string", "whole": "decimal-int-string", "octal": "octal-int-string", "hexa": "hex-int-string"}
_PAIRS = [(c, r, m, out) for c, r in _TEXTS.items() for (of, m), out in R.PROJECTIONS.items() if of == r]


@query("refined_projections", "SELECT t.*, n, CAST(0 AS BIGINT) AS broken FROM (VALUES " + ", ".join(str(p) for p in _PAIRS) + ") t(\"column\", refinement, method, result), (SELECT CAST(count(*) AS BIGINT) AS n FROM part)")
def refined_projections(spark, d):
    """What methods leave of refinements holds for texts made of parts: none is broken."""
    size = F.col("p_size").cast("string")
    texts = {"low": F.lower("p_name"), "up": F.upper("p_type"), "number": F.concat(size, F.lit(".5")), "whole": size, "octal": F.concat(F.lit("0o"), F.conv(size, 10, 8)), "hexa": F.concat(F.lit("0x"), F.conv(size, 10, 16))}
    return R.unprojected(table(spark, d, "part").select(*[c.alias(k) for k, c in texts.items()]), _TEXTS)


@query("contract_members", "SELECT DISTINCT p_type || '/' || p_brand AS member, CASE p_type WHEN 'PROMO' THEN CASE p_brand WHEN 'Brand#1' THEN 'equivalent' ELSE 'tighter-return' END WHEN 'STANDARD' THEN 'new-method' WHEN 'SMALL' THEN 'skipped.complex-shape' WHEN 'MEDIUM' THEN 'skipped.untyped-return' ELSE 'equivalent' END AS verdict FROM part")
def contract_members(spark, d):
    """A member for each type and brand: PROMO is tighter (one brand's by a computed constant), ECONOMY would lose nil, LARGE a collection's sizes."""
    kind, even = F.col("p_type"), F.col("p_size") % 2 == 0
    part = table(spark, d, "part").withColumn("member", F.concat_ws("/", "p_type", "p_brand"))
    seen = F.when(kind == "PROMO", "Integer").when((kind == "ECONOMY") & even, "Integer").when(kind == "ECONOMY", "Float").when(kind == "MEDIUM", "untyped").when(kind == "LARGE", "Tuple").otherwise("String")
    observed = part.select("member", seen.alias("type"), (kind == "SMALL").alias("complex"), ((kind == "PROMO") & (F.col("p_brand") == "Brand#1")).alias("computed"))
    said = F.when(kind == "PROMO", F.array(F.lit("Numeric"))).when(kind == "ECONOMY", F.array(*map(F.lit, ("Integer", "Float", "NilClass")))).when(kind == "LARGE", F.array(F.lit("Array"))).when(kind != "STANDARD", F.array(F.lit("String")))
    declared = part.select("member", F.explode(said).alias("type")).distinct()
    above = G.closure(spark.createDataFrame([("Integer", "Numeric"), ("Float", "Numeric"), ("Numeric", "Object"), ("String", "Object"), ("Tuple", "Array"), ("Array", "Object"), ("NilClass", "Object")], "child string, parent string"))
    return K.classify_members(observed, declared, above, "member")


@query("narrow_complement_difference", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Integer:*|String:' WHEN 1 THEN 'NilClass:*' WHEN 2 THEN 'String:' ELSE 'String:x' END AS left_over FROM part")
def narrow_complement_difference(spark, d):
    """What is left of a union where "a String other than the empty one" doesn't hold; a union of nothing else stays."""
    one = lambda cls, value=None: F.struct(F.lit(cls).alias("cls"), F.lit(value).cast("string").alias("value"))
    n = F.col("p_size") % 4
    members = F.when(n == 0, F.array(one("String"), one("Integer"))).when(n == 1, F.array(one("String", "x"), one("NilClass"))).when(n == 2, F.array(one("Object"))).otherwise(F.array(one("String", "x")))
    out = N.complement_of_difference(members, "String", F.lit(""), {"String": ("Object",)})
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(out, lambda x: F.concat(x["cls"], F.lit(":"), F.coalesce(x["value"], F.lit("*")))), "|").alias("left_over"))


@query("rule_constant_conditions", """
WITH t AS (SELECT CAST(count(*) AS BIGINT) AS n, [{'m': 'l_quantity > 0', 'k': count_if(l_quantity > 0)}, {'m': 'l_discount < 0.05', 'k': count_if(l_discount < 0.05)}, {'m': 'l_linenumber > 7', 'k': count_if(l_linenumber > 7)}] AS a FROM lineitem)
SELECT 'flow.always-truthy-condition' AS rule, 'warning' AS severity, x.m AS message, CASE WHEN x.k = 0 THEN 'falsey' ELSE 'truthy' END AS polarity, n FROM (SELECT n, unnest(a) AS x FROM t) WHERE n > 0 AND (x.k = 0 OR x.k = n)""")
def rule_constant_conditions(spark, d):
    c = F.col
    asked = [
        ("l_quantity > 0", "compare", c("l_quantity") > 0, ""), ("l_discount < 0.05", "compare", c("l_discount") < 0.05, ""), ("l_linenumber > 7", "compare", c("l_linenumber") > 7, ""), ("l_quantity.nil?", "nil", c("l_quantity").isNull(), ""),
        ("true", "literal", F.lit(True), ""), ("l_quantity > 0 in a loop", "compare", c("l_quantity") > 0, "loop"), ("l_tax.zero?", "zero", c("l_tax") == -1, ""), ("l_tax >= 0 in a block", "compare", c("l_tax") >= 0, "block"),
    ]
    return U.constant_conditions(table(spark, d, "lineitem"), asked)


_SIX = "'orders/' || l_orderkey % 10 AS path, l_orderkey AS line, CAST(l_linenumber AS BIGINT) AS \"column\", '{0}' AS severity, CASE WHEN l_discount > 0.05 THEN 'rule-a' END AS rule, l_returnflag AS source_family, CASE WHEN l_tax > 0.02 THEN l_linestatus END AS message"
_MEET = "NOT EXISTS (SELECT 1 FROM {1} b WHERE " + " AND ".join(f'b."{c}" IS NOT DISTINCT FROM a."{c}"' for c in U.FIELDS if c != "severity") + ")"


@query("diag_diff_fields", f"WITH cur AS (SELECT {_SIX.format('error')} FROM lineitem WHERE l_linenumber < 5), base AS (SELECT {_SIX.format('warning')} FROM lineitem WHERE l_linenumber <> 3 AND l_linenumber < 6) SELECT 'new' AS status, a.* FROM cur a WHERE {_MEET.format('', 'base')} UNION ALL SELECT 'fixed', a.* FROM base a WHERE {_MEET.format('', 'cur')}")
def diag_diff_fields(spark, d):
    """By path, line, column, rule, family and message, in which nulls are equal; another severity is no other diagnostic."""
    from ..api import diff

    n, li = F.col("l_linenumber"), table(spark, d, "lineitem")
    path = F.concat(F.lit("orders/"), (F.col("l_orderkey") % 10).cast("string"))

    def rows(severity, keep):
        return li.where(keep).select(path.alias("path"), F.col("l_orderkey").alias("line"), n.cast("long").alias("column"), F.lit(severity).alias("severity"), F.when(F.col("l_discount") > 0.05, "rule-a").alias("rule"), F.col("l_returnflag").alias("source_family"), F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).alias("message"))

    return diff(rows("warning", (n != 3) & (n < 6)), rows("error", n < 5))


@query("accept_carriers", "SELECT d AS declared, g AS given, CASE WHEN g IN (0, 1) OR d IN (0, 2) THEN 'yes' WHEN d = 1 THEN 'no' WHEN g = 2 THEN 'maybe' WHEN d = 3 THEN CASE g WHEN 3 THEN 'yes' ELSE 'no' END WHEN g < 5 THEN 'no' WHEN d = 5 OR g = 5 THEN 'yes' ELSE 'maybe' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_size % 6 AS d, p_partkey % 8 AS g FROM part) GROUP BY 1, 2")
def accept_carriers(spark, d):
    """Six declared carriers against eight given ones, by parts: the whole ladder, with arguments."""
    one = lambda kind, cls=None, *args: F.struct(F.lit(kind).alias("kind"), F.lit(cls).cast("string").alias("cls"), F.array(*map(F.lit, args)).cast("array<string>").alias("args"))
    declared = F.array(one("top"), one("bot"), one("dynamic"), one("nominal", "Numeric"), one("nominal", "Array", "Numeric"), one("nominal", "Array"))
    given = F.array(one("bot"), one("dynamic"), one("top"), one("nominal", "Integer"), one("nominal", "String"), one("nominal", "Array", "Integer"), one("nominal", "Array", "Mystery"), one("nominal", "Array"))
    a, b = F.col("p_size") % 6, F.col("p_partkey") % 8
    verdict = A.carriers_accept(F.element_at(declared, (a + 1).cast("int")), F.element_at(given, (b + 1).cast("int")), {"Integer": ("Numeric",), "String": (), "Array": ()})
    return table(spark, d, "part").select(a.alias("declared"), b.alias("given"), A.verdict(verdict).alias("verdict")).groupBy("declared", "given", "verdict").agg(F.count("*").alias("n"))
