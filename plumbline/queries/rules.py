"""Queries of the rules, their post-processing, and contract inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import contracts as K
from ..operators import rules as U
from ..registry import query, table


@query("rule_undefined_member", "SELECT event_type AS name, CAST(count(*) AS BIGINT) AS n, 'call.undefined-method' AS rule FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def rule_undefined_member(spark, d):
    known = F.broadcast(spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string"))
    gone = table(spark, d, "events").join(known, "event_type", "left_anti")
    return gone.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.lit("call.undefined-method").alias("rule"))


@query("rule_wrong_arity", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS given, 'call.wrong-arity' AS rule FROM lineitem GROUP BY 1 HAVING count(*) NOT BETWEEN 2 AND 6")
def rule_wrong_arity(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("given"), F.lit("call.wrong-arity").alias("rule")).where(~F.col("given").between(2, 6))


@query("rule_argument_mismatch", "SELECT c_custkey, 'call.argument-type-mismatch' AS rule, 'c_acctbal' AS arg FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT c_custkey, 'call.argument-type-mismatch', 'c_mktsegment' FROM customer WHERE NOT c_mktsegment = lower(c_mktsegment)")
def rule_argument_mismatch(spark, d):
    from ..operators.refine import compile_payload

    c = table(spark, d, "customer")
    bad = F.filter(F.array(F.when(~(F.col("c_acctbal") >= 0), "c_acctbal"), F.when(~compile_payload("lowercase-string")(F.col("c_mktsegment")), "c_mktsegment")), lambda x: x.isNotNull())
    return c.select("c_custkey", F.lit("call.argument-type-mismatch").alias("rule"), F.explode(bad).alias("arg"))


@query("rule_nil_receiver", "SELECT d.doc_id, 'call.possible-nil-receiver' AS rule FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def rule_nil_receiver(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels").where("quality is not null").select("doc_id"), "doc_id", "left_anti").withColumn("rule", F.lit("call.possible-nil-receiver"))


@query("rule_dump_type", "SELECT 'info' AS severity, 'dump.type' AS rule, p_type AS subject, 'int<' || min(p_size) || ', ' || max(p_size) || '>' AS message FROM part GROUP BY p_type HAVING min(p_size) < max(p_size)")
def rule_dump_type(spark, d):
    from ..operators.intervals import Interval, describe

    g = table(spark, d, "part").groupBy(F.col("p_type").alias("subject")).agg(F.min("p_size").cast("long").alias("s_lo"), F.max("p_size").cast("long").alias("s_hi")).where("s_lo < s_hi")
    return g.select(F.lit("info").alias("severity"), F.lit("dump.type").alias("rule"), "subject", describe(Interval.of("s")).alias("message"))


@query("rule_assert_mismatch", "SELECT p_type AS subject, 'int<1, 50>' AS expected, 'int<' || min(p_size) || ', ' || max(p_size) || '>' AS got FROM part GROUP BY 1 HAVING 'int<' || min(p_size) || ', ' || max(p_size) || '>' <> 'int<1, 50>'")
def rule_assert_mismatch(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("subject")).agg(F.format_string("int<%d, %d>", F.min("p_size"), F.max("p_size")).alias("got"))
    return g.where("got <> 'int<1, 50>'").select("subject", F.lit("int<1, 50>").alias("expected"), "got")


@query("rule_always_raises", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'flow.always-raises' AS rule FROM lineitem WHERE CAST(l_tax * 100 AS BIGINT) = 0")
def rule_always_raises(spark, d):
    return table(spark, d, "lineitem").where(F.round(F.col("l_tax") * 100).cast("long") == 0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("flow.always-raises").alias("rule"))


@query("rule_unreachable_branch", "SELECT a.arm, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) = 0 AS unreachable FROM (VALUES (1), (2), (3), (4)) a(arm) LEFT JOIN (SELECT CASE WHEN p_size < 51 THEN 1 WHEN p_size < 20 THEN 2 WHEN p_size IS NULL THEN 3 ELSE 4 END AS arm, count(*) AS n FROM part GROUP BY 1) b ON a.arm = b.arm")
def rule_unreachable_branch(spark, d):
    c = F.col("p_size")
    arm = F.when(c < 51, 1).when(c < 20, 2).when(c.isNull(), 3).otherwise(4)
    whole = table(spark, d, "part").agg(*[F.count_if(arm == k).alias(f"n{k}") for k in range(1, 5)])
    return whole.select(F.inline(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(f"n{k}").alias("n"), (F.col(f"n{k}") == 0).alias("unreachable")) for k in range(1, 5)])))


@query("rule_always_truthy", "SELECT 'l_quantity > 0' AS condition, bool_and(l_quantity > 0) AS always FROM lineitem UNION ALL SELECT 'l_discount < 0.05', bool_and(l_discount < 0.05) FROM lineitem UNION ALL SELECT 'l_linenumber between 1 and 7', bool_and(l_linenumber BETWEEN 1 AND 7) FROM lineitem")
def rule_always_truthy(spark, d):
    tests = {"l_quantity > 0": F.col("l_quantity") > 0, "l_discount < 0.05": F.col("l_discount") < 0.05, "l_linenumber between 1 and 7": F.col("l_linenumber").between(1, 7)}
    whole = table(spark, d, "lineitem").agg(*[F.bool_and(F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, t in enumerate(tests.values())])
    return whole.select(F.inline(F.array(*[F.struct(F.lit(k).alias("condition"), F.col(f"t{i}").alias("always")) for i, k in enumerate(tests)])))


@query("rule_dead_assignment", "SELECT p_partkey, 'flow.dead-assignment' AS rule FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) AND p_partkey <> (SELECT max(p_partkey) FROM part)")
def rule_dead_assignment(spark, d):
    """Written and never read, but for the trailing one."""
    part = table(spark, d, "part").select("p_partkey")
    last = part.agg(F.max("p_partkey").alias("p_partkey"))
    read = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return part.join(read, "p_partkey", "left_anti").join(F.broadcast(last), "p_partkey", "left_anti").withColumn("rule", F.lit("flow.dead-assignment"))


@query("rule_return_mismatch", "SELECT o_orderkey, 'def.return-type-mismatch' AS rule FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000")
def rule_return_mismatch(spark, d):
    return table(spark, d, "orders").where(~F.col("o_totalprice").between(1000, 400000)).select("o_orderkey", F.lit("def.return-type-mismatch").alias("rule"))


@query("rule_visibility_mismatch", "SELECT s.s_suppkey, n.n_regionkey, 'def.method-visibility-mismatch' AS rule FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey <> 1 AND s.s_acctbal < 0")
def rule_visibility_mismatch(spark, d):
    """Members private to region 1 (negative balances) that are used outside it."""
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows, a fixed dimension
    s = table(spark, d, "supplier").where("s_acctbal < 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey <> 1")
    return s.select("s_suppkey", "n_regionkey", F.lit("def.method-visibility-mismatch").alias("rule"))


_DIAGS = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN 'call.possible-nil-receiver' WHEN 2 THEN 'call.wrong-arity' WHEN 3 THEN 'flow.dead-assignment' WHEN 4 THEN 'flow.unreachable-branch' WHEN 5 THEN 'dump.type' END AS rule, 'info' AS severity FROM lineitem"


def _diagnostics(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {1: "call.possible-nil-receiver", 2: "call.wrong-arity", 3: "flow.dead-assignment", 4: "flow.unreachable-branch", 5: "dump.type"}.items() for x in kv])
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey", F.try_element_at(names, F.col("l_linenumber")).alias("rule"), F.lit("info").alias("severity"))


@query("severity_resolve", f"SELECT l_orderkey, line, l_partkey, l_suppkey, rule, CASE rule WHEN 'call.wrong-arity' THEN 'warning' WHEN 'call.possible-nil-receiver' THEN 'error' WHEN 'flow.dead-assignment' THEN 'info' WHEN 'flow.unreachable-branch' THEN 'info' ELSE 'info' END AS severity FROM ({_DIAGS}) WHERE rule IS NULL OR rule <> 'dump.type'")
def severity_resolve(spark, d):
    """Overrides: one rule to warning, family call to error, family flow to info, one rule off."""
    o = spark.createDataFrame([("call.wrong-arity", "warning"), ("call", "error"), ("flow", "info"), ("dump.type", "off")], "name string, level string")
    return U.resolve_severity(_diagnostics(spark, d), o, "balanced")


@query("severity_profiles", f"SELECT profile, severity, CAST(count(*) AS BIGINT) AS n FROM (SELECT p.profile, CASE WHEN rule IS NULL THEN 'info' WHEN rule = 'call.wrong-arity' THEN 'error' WHEN rule = 'dump.type' THEN 'info' WHEN rule = 'call.possible-nil-receiver' THEN CASE p.profile WHEN 'lenient' THEN 'off' WHEN 'balanced' THEN 'warning' ELSE 'error' END WHEN rule = 'flow.unreachable-branch' THEN CASE p.profile WHEN 'lenient' THEN 'info' WHEN 'balanced' THEN 'warning' ELSE 'error' END ELSE CASE p.profile WHEN 'lenient' THEN 'info' ELSE 'warning' END END AS severity FROM ({_DIAGS}) CROSS JOIN (VALUES ('lenient'), ('balanced'), ('strict')) p(profile)) WHERE severity <> 'off' GROUP BY 1, 2")
def severity_profiles(spark, d):
    none = spark.createDataFrame([], "name string, level string")
    out = None
    for p in U.PROFILES:
        by = U.resolve_severity(_diagnostics(spark, d), none, p).groupBy("severity").agg(F.count("*").alias("n")).select(F.lit(p).alias("profile"), "severity", "n")
        out = by if out is None else out.unionByName(by)
    return out


@query("suppression", f"SELECT l_orderkey, line, l_partkey, l_suppkey, rule FROM ({_DIAGS}) WHERE rule IS NULL OR NOT (rule = 'dump.type' OR (l_orderkey % 10 = 0 AND rule LIKE 'flow.%') OR (l_orderkey % 10 = 1) OR (l_orderkey % 10 = 2 AND rule = 'call.wrong-arity'))")
def suppression(spark, d):
    """A project-wide list, and comments of a line: a family, all, one rule; rows without a rule stay."""
    k = F.col("l_orderkey") % 10
    comment = F.when(k == 0, "x # plumbline:disable flow.*").when(k == 1, "# plumbline:disable all").when(k == 2, "# plumbline:disable call.wrong-arity, other").otherwise("")
    tokens = F.concat(U.comment_tokens(comment), F.array(F.lit("dump.type")))
    return _diagnostics(spark, d).where(~U.suppressed(F.col("rule"), tokens)).drop("severity")


@query("qualified_names", f"SELECT DISTINCT rule, CASE WHEN line = 2 THEN rule ELSE 'pack.' || rule END AS name FROM ({_DIAGS}) WHERE rule IS NOT NULL")
def qualified_names(spark, d):
    source = F.when(F.col("line") == 2, "builtin").otherwise("pack")
    return _diagnostics(spark, d).where("rule is not null").select("rule", U.qualified(F.col("rule"), source).alias("name")).distinct()


@query("rule_catalogue", f"SELECT family, rules, CAST(count(d.rule) AS BIGINT) AS found FROM (VALUES ('call', 4), ('dump', 1), ('assert', 1), ('flow', 4), ('def', 3)) t(family, rules) LEFT JOIN ({_DIAGS}) d ON split_part(d.rule, '.', 1) = family GROUP BY 1, 2")
def rule_catalogue(spark, d):
    """Families of the catalogue, with the diagnostics found of each."""
    rows = spark.createDataFrame([(r,) for r in U.SEVERITIES], "rule string")
    families = rows.groupBy(U.family(F.col("rule")).alias("family")).agg(F.count("*").cast("int").alias("rules"))
    found = _diagnostics(spark, d).groupBy(U.family(F.col("rule")).alias("family")).agg(F.count("rule").alias("found"))
    return families.join(found, "family", "left").select("family", "rules", F.coalesce("found", F.lit(0)).cast("long").alias("found"))


@query("reporter_union", "SELECT 'coverage' AS source, lang AS subject, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'unresolved', event_type, CAST(count(*) AS BIGINT) FROM events GROUP BY 2 UNION ALL SELECT 'lossy', p_type, CAST(count(*) AS BIGINT) FROM part GROUP BY 2")
def reporter_union(spark, d):
    one = lambda source, t, c: table(spark, d, t).groupBy(F.col(c).alias("subject")).agg(F.count("*").alias("n")).select(F.lit(source).alias("source"), "subject", "n")
    return one("coverage", "documents", "lang").unionByName(one("unresolved", "events", "event_type")).unionByName(one("lossy", "part", "p_type"))


_DECLARED = [("p_size", "Integer", 1, 60), ("p_partkey", "Integer", 0, None), ("p_name", "String", None, None), ("gone", "Integer", 0, 1), ("p_linkage", "Integer", 5, 9)]


@query("contract_classify", "SELECT * FROM (SELECT 'p_size' AS col, CASE WHEN min(p_size) = 1 AND max(p_size) = 60 THEN 'equivalent' WHEN min(p_size) >= 1 AND max(p_size) <= 60 THEN 'tighter' ELSE 'looser' END AS verdict FROM part) UNION ALL SELECT 'p_partkey', 'tighter' UNION ALL SELECT 'p_name', 'equivalent' UNION ALL SELECT 'p_brand', 'new' UNION ALL SELECT 'p_type', 'new' UNION ALL SELECT 'p_retailprice', 'new' UNION ALL SELECT 'gone', 'unobserved' UNION ALL SELECT 'p_linkage', 'unobserved'")
def contract_classify(spark, d):
    from ..operators.profile import profile

    declared = spark.createDataFrame(_DECLARED, "col string, cls string, lo long, hi long")
    return K.classify(profile(table(spark, d, "part"), "part").select("col", "cls", "lo", "hi"), declared, "col")


@query("contract_observed_domains", "SELECT p_brand, CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi, min(p_size) >= 1 AND max(p_size) <= 50 AND NOT (min(p_size) <= 1 AND max(p_size) >= 50) AS tighter, count(DISTINCT p_size % 3) = 1 AS constant FROM part GROUP BY 1")
def contract_observed_domains(spark, d):
    from ..operators.intervals import Interval

    g = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").cast("long").alias("i_lo"), F.max("p_size").cast("long").alias("i_hi"), (F.count_distinct(F.col("p_size") % 3) == 1).alias("constant"))
    return g.select("p_brand", F.col("i_lo").alias("lo"), F.col("i_hi").alias("hi"), K.tighter(Interval(F.lit(1), F.lit(50)), Interval.of("i")).alias("tighter"), "constant")


@query("contract_merge", "SELECT p_type AS member, CASE WHEN p_type LIKE 'S%' THEN 'Integer' WHEN p_type LIKE 'P%' THEN '(untyped) -> Integer' WHEN p_type LIKE 'E%' THEN 'String' ELSE 'untyped' END AS type, CASE WHEN p_type LIKE 'S%' THEN 'inserted' WHEN p_type LIKE 'P%' THEN 'replaced' WHEN p_type LIKE 'E%' THEN 'kept' ELSE 'kept' END AS action FROM (SELECT DISTINCT p_type FROM part)")
def contract_merge(spark, d):
    t = F.col("member")
    names = table(spark, d, "part").select(F.col("p_type").alias("member")).distinct()
    old = names.where(~t.startswith("S")).select("member", F.when(t.startswith("P"), "(untyped) -> untyped").when(t.startswith("E"), "String").otherwise("untyped").alias("type"))
    new = names.where(t.startswith("S") | t.startswith("P") | t.startswith("E")).select("member", F.when(t.startswith("S"), "Integer").when(t.startswith("P"), "(untyped) -> Integer").otherwise("Integer").alias("type"), F.when(t.startswith("E"), "other").otherwise("new_method").alias("kind"))
    return K.merge(old, new, "member")


_RANGES = "(SELECT 'int<' || min(p_partkey) || ', ' || max(p_partkey) || '>' AS k, 'int<' || min(p_size) || ', ' || max(p_size) || '>' AS s FROM part)"


@query("contract_render", f"SELECT 'print' AS mode, 'p_partkey' AS member, 1 AS part, 'def p_partkey: () -> ' || k AS line FROM {_RANGES} UNION ALL SELECT 'print', 'p_size', 1, 'def p_size: () -> ' || s FROM {_RANGES} UNION ALL SELECT 'diff', 'p_partkey', 1, '+ def p_partkey: () -> ' || k FROM {_RANGES} UNION ALL SELECT 'diff', 'p_size', 0, '- def p_size: () -> untyped' UNION ALL SELECT 'diff', 'p_size', 1, '+ def p_size: () -> ' || s FROM {_RANGES} UNION ALL SELECT 'write', 'p_partkey', 1, 'def p_partkey: () -> ' || k FROM {_RANGES} UNION ALL SELECT 'write', 'p_size', 1, 'def p_size: () -> ' || s FROM {_RANGES} UNION ALL SELECT 'write', 'p_name', 1, 'def p_name: () -> Name'")
def contract_render(spark, d):
    """What is observed in part, merged into a contract that has one untyped member and one that is narrower than its class."""
    from ..operators.profile import profile

    seen = profile(table(spark, d, "part"), "part").where(F.col("col").isin("p_partkey", "p_size", "p_name"))
    domain = F.when(F.col("cls") == "Integer", F.format_string("int<%d, %d>", "lo", "hi")).otherwise(F.col("cls"))
    seen = seen.select(F.col("col").alias("member"), domain.alias("type"), F.when(F.col("cls") == "Integer", "tighter_return").otherwise("new_method").alias("kind"))
    old = spark.createDataFrame([("p_size", "untyped"), ("p_name", "Name")], "member string, type string")
    out = None
    for mode in ("print", "diff", "write"):
        one = K.render(old, seen, "member", mode).select(F.lit(mode).alias("mode"), "member", "part", "line")
        out = one if out is None else out.unionByName(one)
    return out


@query("signature_paths", "SELECT p_brand, 'sig/' || lower(replace(p_brand, '#', '/')) || '.sig' AS path FROM (SELECT DISTINCT p_brand FROM part)")
def signature_paths(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.concat(F.lit("sig/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("/"))), F.lit(".sig")).alias("path"))


@query("pack_state_machine", "WITH t AS (SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS a, role AS b FROM conversations) SELECT coalesce(a, 'start') AS from_state, b AS to_state, CAST(count(*) AS BIGINT) AS n, coalesce(a, 'start') || '>' || b IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS allowed FROM t GROUP BY ALL")
def pack_state_machine(spark, d):
    """Transitions of roles against a declared machine."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = table(spark, d, "conversations").select(F.coalesce(F.lag("role").over(w), F.lit("start")).alias("from_state"), F.col("role").alias("to_state"))
    ok = F.concat("from_state", F.lit(">"), "to_state").isin("start>system", "start>user", "system>user", "user>assistant", "assistant>user")
    return t.groupBy("from_state", "to_state").agg(F.count("*").alias("n")).withColumn("allowed", ok)


@query("pack_deprecations", "SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: x IN ('the', 'und'))) AS BIGINT) AS uses FROM documents WHERE len(list_filter(string_split(text, ' '), lambda x: x IN ('the', 'und'))) > 0")
def pack_deprecations(spark, d):
    uses = F.size(F.filter(F.split("text", " "), lambda x: x.isin("the", "und"))).cast("long")
    return table(spark, d, "documents").select("doc_id", uses.alias("uses")).where("uses > 0")


@query("pack_pattern_rules", r"SELECT page_id, 'query string' AS pattern FROM pages WHERE regexp_matches(url, '\?[^#]') UNION ALL SELECT page_id, 'fragment' FROM pages WHERE regexp_matches(url, '#\w+')")
def pack_pattern_rules(spark, d):
    hits = F.filter(F.array(F.when(F.col("url").rlike(r"\?[^#]"), "query string"), F.when(F.col("url").rlike(r"#\w+"), "fragment")), lambda x: x.isNotNull())
    return table(spark, d, "pages").select("page_id", F.explode(hits).alias("pattern"))


@query("pack_missing_keys", "SELECT DISTINCT lang AS key FROM documents WHERE lang NOT IN ('en', 'de')")
def pack_missing_keys(spark, d):
    known = F.broadcast(spark.createDataFrame([("en",), ("de",)], "key string"))
    return table(spark, d, "documents").select(F.col("lang").alias("key")).distinct().join(known, "key", "left_anti")


@query("pack_routes", r"SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]{2})/(\d+)', 1) AS lang, try_cast(nullif(regexp_extract(url, '://[^/]+/([a-z]{2})/(\d+)', 2), '') AS BIGINT) AS id, regexp_matches(url, '://[^/]+/[a-z]{2}/\d+') AS matched FROM pages")
def pack_routes(spark, d):
    """/:lang/:id"""
    p = r"://[^/]+/([a-z]{2})/(\d+)"
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, p, 1).alias("lang"), F.nullif(F.regexp_extract(u, p, 2), F.lit("")).try_cast("long").alias("id"), u.rlike(p).alias("matched"))


@query("pack_units", "SELECT l_orderkey, round(sum(l_quantity * 2.5), 2) AS kilograms, round(sum(l_quantity * 2.5) / 1000, 6) AS tonnes FROM lineitem GROUP BY 1")
def pack_units(spark, d):
    kg = F.sum(F.col("l_quantity") * 2.5)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(kg, 2).alias("kilograms"), F.round(kg / 1000, 6).alias("tonnes"))


@query("pack_schema_columns", "SELECT * FROM (VALUES ('p_partkey', true), ('p_size', true), ('p_colour', false), ('p_weight', false)) t(col, known)")
def pack_schema_columns(spark, d):
    have = set(table(spark, d, "part").columns)
    return spark.createDataFrame([(c, c in have) for c in ("p_partkey", "p_size", "p_colour", "p_weight")], "col string, known boolean")


@query("plugin_isolation", "SELECT 'bad pack' AS path, 'plugin-runtime-error' AS rule, 'KeyError' AS message")
def plugin_isolation(spark, d):
    def broken(df):
        raise KeyError("no such option")

    return U.isolated("bad pack", broken, table(spark, d, "region"))


_ASKED = "SELECT CASE l_linenumber WHEN 1 THEN 'wrong-arity' WHEN 2 THEN 'flow' WHEN 3 THEN 'dump.type' WHEN 4 THEN 'no-such-rule' END AS name FROM lineitem"
_KNOWN = "(VALUES ('wrong-arity', 'call.wrong-arity', 'call', 'error'), ('dump.type', 'dump.type', 'dump', 'info'), ('flow', 'flow.always-raises', 'flow', 'error'), ('flow', 'flow.unreachable-branch', 'flow', 'warning'), ('flow', 'flow.always-truthy-condition', 'flow', 'warning'), ('flow', 'flow.dead-assignment', 'flow', 'warning')) t(name, rule, family, severity)"


@query("rule_explain", f"SELECT a.name, rule, family, severity, rule IS NOT NULL AS explained, n FROM (SELECT name, CAST(count(*) AS BIGINT) AS n FROM ({_ASKED}) GROUP BY 1) a LEFT JOIN {_KNOWN} ON t.name = a.name")
def rule_explain(spark, d):
    """Names that lines ask for: an older name, a family, a rule, one that isn't known, and none."""
    from ..api import EXPLANATIONS

    n = F.col("l_linenumber")
    name = F.when(n == 1, "wrong-arity").when(n == 2, "flow").when(n == 3, "dump.type").when(n == 4, "no-such-rule")
    asked = table(spark, d, "lineitem").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return U.explained(asked, EXPLANATIONS).select("name", "rule", "family", "severity", F.col("text").isNotNull().alias("explained"), "n")


@query("api_type_of", "SELECT 'Integer' AS cls, CAST(count(*) AS BIGINT) AS n, CAST(min(p_size * 2) AS BIGINT) AS lo, CAST(max(p_size * 2) AS BIGINT) AS hi FROM part")
def api_type_of(spark, d):
    from ..api import type_of

    return type_of(table(spark, d, "part"), "p_size * 2").select("cls", "n", "lo", "hi")
