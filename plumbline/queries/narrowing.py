"""Queries that hold predicted domains against what the data show, and interval arithmetic over groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accept as A
from ..operators import intervals as I
from ..operators import narrow as N
from ..operators import refine as R
from ..operators.narrow import Domain, Test
from ..registry import query, table

SIZES = Domain(1, 50)
TESTS = {
    "p_size < 10": Test("<", 10), "p_size <= 10": Test("<=", 10), "p_size > 40": Test(">", 40), "p_size >= 40": Test(">=", 40), "p_size == 7": Test("==", 7), "p_size != 1": Test("!=", 1),
    "p_size between 5, 9": Test("between", (5, 9)), "p_size > 5 and p_size < 20": Test("and", parts=(Test(">", 5), Test("<", 20))), "p_size < 3 or p_size < 8": Test("or", parts=(Test("<", 3), Test("<", 8))), "not p_size < 30": Test("not", parts=(Test("<", 30),)),
}
_EDGES = [("p_size < 10", 1, 9, 10, 50), ("p_size <= 10", 1, 10, 11, 50), ("p_size > 40", 41, 50, 1, 40), ("p_size >= 40", 40, 50, 1, 39), ("p_size = 7", 7, 7, 1, 50), ("p_size <> 1", 2, 50, 1, 1), ("p_size BETWEEN 5 AND 9", 5, 9, 1, 50), ("p_size > 5 AND p_size < 20", 6, 19, 1, 50), ("p_size < 3 OR p_size < 8", 1, 7, 8, 50), ("NOT p_size < 30", 30, 50, 1, 29)]
_EDGE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS test, '{edge}' AS edge, CAST({lo} AS BIGINT) AS lo, CAST({hi} AS BIGINT) AS hi, coalesce(min(p_size) >= {lo} AND max(p_size) <= {hi}, true) AS contained, CAST(count(*) AS BIGINT) AS n FROM part WHERE {cond}"
    for name, (sql, tl, th, fl, fh) in zip(TESTS, _EDGES)
    for edge, lo, hi, cond in (("truthy", tl, th, sql), ("falsey", fl, fh, f"NOT ({sql})"))
)


@query("narrow_int_edges", _EDGE_SQL)
def narrow_int_edges(spark, d):
    """Predicted bounds on both edges of each test, and whether all rows of the edge lie within: one pass over the table."""
    c = F.col("p_size")
    edges = [(name, edge, dom, cond) for name, t in TESTS.items() for edge, dom, cond in zip(("truthy", "falsey"), N.narrow(SIZES, t), (N.keep(c, t), N.drop(c, t)))]
    aggs = []
    for i, (_, _, dom, cond) in enumerate(edges):
        lo, hi = dom.bounds()
        aggs += [F.coalesce((F.min(F.when(cond, c)) >= lo) & (F.max(F.when(cond, c)) <= hi), F.lit(True)).alias(f"c{i}"), F.count_if(cond).alias(f"n{i}")]
    rows = [F.struct(F.lit(n).alias("test"), F.lit(e).alias("edge"), F.lit(dom.bounds()[0]).cast("long").alias("lo"), F.lit(dom.bounds()[1]).cast("long").alias("hi"), F.col(f"c{i}").alias("contained"), F.col(f"n{i}").alias("n")) for i, (n, e, dom, _) in enumerate(edges)]
    return table(spark, d, "part").agg(*aggs).select(F.inline(F.array(*rows)))


@query("narrow_equality_sets", "SELECT o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n, o_orderstatus = 'F' AS equal, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE (SELECT array_to_string(list_sort(list(DISTINCT o_orderstatus)), ' | ') FROM orders WHERE o_orderstatus <> 'F') END AS domain FROM orders GROUP BY 1")
def narrow_equality_sets(spark, d):
    orders = table(spark, d, "orders")
    truthy, falsey = N.narrow(N.literal_domain(orders, "o_orderstatus"), Test("==", "F"))
    equal = F.col("o_orderstatus") == "F"
    return orders.groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"), F.first(equal).alias("equal"), F.first(F.when(equal, truthy.describe()).otherwise(falsey.describe())).alias("domain"))


@query("narrow_case_when", "SELECT CASE WHEN p_size < 10 THEN 1 WHEN p_size BETWEEN 5 AND 20 THEN 2 WHEN p_size = 50 THEN 3 ELSE 4 END AS arm, CAST(count(*) AS BIGINT) AS n, min(CASE WHEN p_size < 10 THEN 'int<1, 9>' WHEN p_size BETWEEN 5 AND 20 THEN 'int<10, 20>' WHEN p_size = 50 THEN '50' ELSE 'int<10, 49>' END) AS domain, bool_and(CASE WHEN p_size < 10 THEN p_size BETWEEN 1 AND 9 WHEN p_size <= 20 THEN p_size BETWEEN 10 AND 20 WHEN p_size = 50 THEN true ELSE p_size BETWEEN 10 AND 49 END) AS contained FROM part GROUP BY 1")
def narrow_case_when(spark, d):
    tests = [Test("<", 10), Test("between", (5, 20)), Test("==", 50)]
    each, rest = N.arms(SIZES, tests)
    c = F.col("p_size")
    arm, domain, inside = F.lit(4), F.lit(rest.describe()), c.between(*rest.bounds())
    for k in reversed(range(3)):
        cond = N.keep(c, tests[k])
        arm, domain, inside = F.when(cond, k + 1).otherwise(arm), F.when(cond, each[k].describe()).otherwise(domain), F.when(cond, c.between(*each[k].bounds())).otherwise(inside)
    return table(spark, d, "part").groupBy(arm.alias("arm")).agg(F.count("*").alias("n"), F.min(domain).alias("domain"), F.bool_and(inside).alias("contained"))


@query("narrow_nil", "SELECT 'nil' AS edge, CAST(count_if(quality IS NULL) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM (SELECT l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) UNION ALL SELECT 'non-nil', CAST(count(quality) AS BIGINT), CAST(min(quality) AS BIGINT), CAST(max(quality) AS BIGINT) FROM (SELECT l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) UNION ALL SELECT 'truthy', CAST(count(quality) AS BIGINT), CAST(min(quality) AS BIGINT), CAST(max(quality) AS BIGINT) FROM (SELECT l.quality FROM documents d LEFT JOIN labels l USING (doc_id))")
def narrow_nil(spark, d):
    """Numbers are truthy, 0 too: only nil (and false) are not."""
    q = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("quality")
    c = F.col("quality")
    whole = q.agg(F.count_if(c.isNull()).alias("nil"), F.count(c).alias("n"), F.min(c).cast("long").alias("lo"), F.max(c).cast("long").alias("hi"))
    null = F.lit(None).cast("long")
    rows = [F.struct(F.lit("nil").alias("edge"), F.col("nil").alias("n"), null.alias("lo"), null.alias("hi"))] + [F.struct(F.lit(e).alias("edge"), F.col("n"), F.col("lo"), F.col("hi")) for e in ("non-nil", "truthy")]
    return whole.select(F.inline(F.array(*rows)))


@query("narrow_sign_methods", "SELECT CASE WHEN c_acctbal > 0 THEN 'positive?' WHEN c_acctbal < 0 THEN 'negative?' ELSE 'zero?' END AS method, CAST(count(*) AS BIGINT) AS n, bool_and(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) >= 0 WHEN c_acctbal < 0 THEN floor(c_acctbal) <= -1 ELSE true END) AS contained FROM customer GROUP BY 1")
def narrow_sign_methods(spark, d):
    c = F.col("c_acctbal")
    method = F.when(N.keep(c, N.METHODS["positive?"]), "positive?").when(N.keep(c, N.METHODS["negative?"]), "negative?").otherwise("zero?")
    return table(spark, d, "customer").groupBy(method.alias("method")).agg(F.count("*").alias("n"), F.bool_and(F.when(c > 0, F.floor(c) >= 0).when(c < 0, F.floor(c) <= -1).otherwise(True)).alias("contained"))


@query("narrow_class_tests", "SELECT CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'Integer' ELSE 'other' END AS cls, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def narrow_class_tests(spark, d):
    """is_a? on gradual values: the class of a JSON member."""
    v = F.expr("schema_of_variant(variant_get(try_parse_json(props), '$.k'))")
    return table(spark, d, "events").groupBy(F.when(v == "BIGINT", "Integer").otherwise("other").alias("cls")).agg(F.count("*").alias("n"))


@query("narrow_match_capture", r"SELECT nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1), '') AS lang, CAST(count(*) AS BIGINT) AS n, bool_and(coalesce(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) = lower(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1)), true)) AS lower FROM pages GROUP BY 1")
def narrow_match_capture(spark, d):
    """A named capture is a string where the match holds, and nil where not."""
    lang = F.nullif(F.regexp_extract("url", "/([a-z]{2})/([0-9]+)", 1), F.lit(""))
    return table(spark, d, "pages").groupBy(lang.alias("lang")).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(R.STRINGS["lowercase-string"](lang), F.lit(True))).alias("lower"))


@query("narrow_text_facts", "SELECT 'relational' AS bucket, 'url' AS target, m AS predicate, p AS payload, CASE WHEN h THEN 'positive' ELSE 'negative' END AS polarity, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([{'m': 'start_with?', 'p': 'https://', 'h': starts_with(url, 'https://')}, {'m': 'end_with?', 'p': '.html', 'h': ends_with(url, '.html')}, {'m': 'include?', 'p': 'example', 'h': contains(url, 'example')}], recursive := true) FROM pages) GROUP BY ALL")
def narrow_text_facts(spark, d):
    u = F.col("url")
    tests = [("start_with?", "https://", u.startswith("https://")), ("end_with?", ".html", u.endswith(".html")), ("include?", "example", u.contains("example"))]
    rows = table(spark, d, "pages").select(F.inline(F.array(*[F.struct(F.lit(m).alias("predicate"), F.lit(p).alias("payload"), F.when(h, "positive").otherwise("negative").alias("polarity")) for m, p, h in tests])))
    return rows.groupBy(F.lit("relational").alias("bucket"), F.lit("url").alias("target"), "predicate", "payload", "polarity").agg(F.count("*").alias("n"))


@query("narrow_complement_halves", "SELECT l_returnflag, CAST(NULL AS BIGINT) AS lo, CAST(min(l_quantity) AS BIGINT) - 1 AS hi FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, CAST(max(l_quantity) AS BIGINT) + 1, NULL FROM lineitem GROUP BY 1")
def narrow_complement_halves(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").cast("long").alias("q_lo"), F.max("l_quantity").cast("long").alias("q_hi"))
    return g.select("l_returnflag", F.inline(I.halves(I.Interval.of("q"))))


@query("narrow_de_morgan", "SELECT CAST(count_if(NOT (p_size > 10 AND p_size < 30)) AS BIGINT) AS outside, CAST(count_if(p_size <= 10 OR p_size >= 30) AS BIGINT) AS either, CAST(count_if(NOT (p_type = upper(p_type))) AS BIGINT) AS not_upper FROM part")
def narrow_de_morgan(spark, d):
    c = F.col("p_size")
    both = Test("and", parts=(Test(">", 10), Test("<", 30)))
    either = Test("or", parts=(Test("<=", 10), Test(">=", 30)))
    return table(spark, d, "part").agg(F.count_if(N.drop(c, both)).alias("outside"), F.count_if(N.keep(c, either)).alias("either"), F.count_if(R.complement("uppercase-string")(F.col("p_type"))).alias("not_upper"))


_GROUPS = "SELECT l_suppkey AS k, CAST(min(l_quantity) AS BIGINT) - 25 AS a_lo, CAST(max(l_quantity) AS BIGINT) - 25 AS a_hi, CAST(min(l_linenumber) AS BIGINT) AS b_lo, CAST(max(l_linenumber) AS BIGINT) AS b_hi FROM lineitem GROUP BY 1"


def _groups(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg((F.min(q).cast("long") - 25).alias("a_lo"), (F.max(q).cast("long") - 25).alias("a_hi"), F.min(n).cast("long").alias("b_lo"), F.max(n).cast("long").alias("b_hi"))




@query("ivl_add_sub_mul", f"SELECT k, a_lo + b_lo AS add_lo, a_hi + b_hi AS add_hi, a_lo - b_hi AS sub_lo, a_hi - b_lo AS sub_hi, least(a_lo * b_lo, a_lo * b_hi, a_hi * b_lo, a_hi * b_hi) AS mul_lo, greatest(a_lo * b_lo, a_lo * b_hi, a_hi * b_lo, a_hi * b_hi) AS mul_hi FROM ({_GROUPS})")
def ivl_add_sub_mul(spark, d):
    _A, _B = I.Interval.of("a"), I.Interval.of("b")
    return _groups(spark, d).select("k", *I.add(_A, _B).columns("add"), *I.subtract(_A, _B).columns("sub"), *I.multiply(_A, _B).columns("mul"))


@query("ivl_div_mod", f"SELECT k, NOT (b_lo <= 0 AND b_hi >= 0) AS ok, CAST(least(floor(a_lo / b_lo), floor(a_lo / b_hi), floor(a_hi / b_lo), floor(a_hi / b_hi)) AS BIGINT) AS div_lo, CAST(greatest(floor(a_lo / b_lo), floor(a_lo / b_hi), floor(a_hi / b_lo), floor(a_hi / b_hi)) AS BIGINT) AS div_hi, b_lo = b_hi AS mod_known, CASE WHEN b_lo = b_hi THEN CAST(0 AS BIGINT) END AS mod_lo, CASE WHEN b_lo = b_hi THEN b_lo - 1 END AS mod_hi FROM ({_GROUPS})")
def ivl_div_mod(spark, d):
    _A, _B = I.Interval.of("a"), I.Interval.of("b")
    ok, q = I.divide(_A, _B)
    known, m = I.modulo(_B)
    return _groups(spark, d).select("k", ok.alias("ok"), *q.columns("div"), known.alias("mod_known"), *m.columns("mod"))


@query("ivl_compare", f"SELECT k, CASE WHEN a_hi < b_lo THEN 'true' WHEN a_lo >= b_hi THEN 'false' ELSE 'both' END AS lt, CASE WHEN a_hi <= b_lo THEN 'true' WHEN a_lo > b_hi THEN 'false' ELSE 'both' END AS le, CASE WHEN a_lo > b_hi THEN 'true' WHEN a_hi <= b_lo THEN 'false' ELSE 'both' END AS gt, CASE WHEN a_lo >= b_hi THEN 'true' WHEN a_hi < b_lo THEN 'false' ELSE 'both' END AS ge, CASE WHEN a_hi < b_lo OR a_lo > b_hi THEN 'false' ELSE CASE WHEN a_lo = a_hi AND b_lo = b_hi THEN 'true' ELSE 'both' END END AS eq FROM ({_GROUPS})")
def ivl_compare(spark, d):
    _A, _B = I.Interval.of("a"), I.Interval.of("b")
    return _groups(spark, d).select("k", *[I.compare(_A, op, _B).alias(n) for op, n in (("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge"), ("==", "eq"))])


@query("ivl_unary", f"SELECT k, -a_hi AS neg_lo, -a_lo AS neg_hi, CASE WHEN a_lo >= 0 THEN a_lo WHEN a_hi <= 0 THEN -a_hi ELSE 0 END AS abs_lo, CASE WHEN a_lo >= 0 THEN a_hi WHEN a_hi <= 0 THEN -a_lo ELSE greatest(abs(a_lo), abs(a_hi)) END AS abs_hi, a_lo + 1 AS succ_lo, a_hi + 1 AS succ_hi, a_lo - 1 AS pred_lo, a_hi - 1 AS pred_hi FROM ({_GROUPS})")
def ivl_unary(spark, d):
    _A = I.Interval.of("a")
    return _groups(spark, d).select("k", *I.negate(_A).columns("neg"), *I.absolute(_A).columns("abs"), *I.shift(_A, 1).columns("succ"), *I.shift(_A, -1).columns("pred"))


@query("ivl_tests", f"SELECT k, CASE WHEN a_lo = a_hi THEN CASE WHEN a_lo % 2 = 0 THEN 'true' ELSE 'false' END ELSE 'both' END AS even, CASE WHEN b_lo = b_hi THEN CASE WHEN b_lo % 2 <> 0 THEN 'true' ELSE 'false' END ELSE 'both' END AS odd, CASE WHEN a_lo = 0 AND a_hi = 0 THEN 'true' WHEN a_lo > 0 OR a_hi < 0 THEN 'false' ELSE 'both' END AS zero, CASE WHEN a_lo > 0 THEN 'true' WHEN a_hi <= 0 THEN 'false' ELSE 'both' END AS positive, CASE WHEN a_hi < 0 THEN 'true' WHEN a_lo >= 0 THEN 'false' ELSE 'both' END AS negative, CASE WHEN a_lo >= -30 AND a_hi <= 24 THEN 'true' WHEN a_hi < -30 OR a_lo > 24 THEN 'false' ELSE 'both' END AS inside FROM ({_GROUPS})")
def ivl_tests(spark, d):
    _A, _B = I.Interval.of("a"), I.Interval.of("b")
    return _groups(spark, d).select("k", I.parity(_A, False).alias("even"), I.parity(_B, True).alias("odd"), *[I.sign_test(_A, w).alias(w) for w in ("zero", "positive", "negative")], I.between(_A, -30, 24).alias("inside"))


@query("ivl_width_clamp", f"SELECT k, CAST(0 AS BIGINT) AS bits_lo, CAST(greatest(length(ltrim(format('{{:b}}', CASE WHEN a_lo < 0 THEN -a_lo - 1 ELSE a_lo END), '0')), length(ltrim(format('{{:b}}', CASE WHEN a_hi < 0 THEN -a_hi - 1 ELSE a_hi END), '0'))) AS BIGINT) AS bits_hi, least(greatest(a_lo, -10), 10) AS clamp_lo, least(greatest(a_hi, -10), 10) AS clamp_hi FROM ({_GROUPS})")
def ivl_width_clamp(spark, d):
    _A = I.Interval.of("a")
    return _groups(spark, d).select("k", *I.width(_A).columns("bits"), *I.clamp(_A, -10, 10).columns("clamp"))


@query("ivl_collapse_describe", f"SELECT k, CASE WHEN b_lo = b_hi THEN CAST(b_lo AS VARCHAR) ELSE 'int<' || b_lo || ', ' || b_hi || '>' END AS text, CASE WHEN b_lo = b_hi THEN b_lo END AS constant FROM ({_GROUPS})")
def ivl_collapse_describe(spark, d):
    _B = I.Interval.of("b")
    return _groups(spark, d).select("k", I.describe(_B).alias("text"), F.when(_B.lo == _B.hi, _B.lo).alias("constant"))


@query("ivl_to_s_bases", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS dec, printf('%o', p_partkey) AS oct, printf('%x', p_partkey) AS hex FROM part")
def ivl_to_s_bases(spark, d):
    from ..functions.numeric import to_base

    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", to_base(k, 10).alias("dec"), to_base(k, 8).alias("oct"), to_base(k, 16).alias("hex"))


@query("ivl_meet_contains", f"SELECT k, greatest(a_lo, b_lo) <= least(a_hi, b_hi) AS meets, CASE WHEN greatest(a_lo, b_lo) <= least(a_hi, b_hi) THEN greatest(a_lo, b_lo) END AS meet_lo, CASE WHEN greatest(a_lo, b_lo) <= least(a_hi, b_hi) THEN least(a_hi, b_hi) END AS meet_hi, b_lo >= a_lo AND b_hi <= a_hi AS contains FROM ({_GROUPS})")
def ivl_meet_contains(spark, d):
    _A, _B = I.Interval.of("a"), I.Interval.of("b")
    ok, m = I.meet(_A, _B)
    return _groups(spark, d).select("k", ok.alias("meets"), *m.columns("meet"), I.contains(_A, _B).alias("contains"))


@query("accept_intervals", f"SELECT k, CASE WHEN b_lo >= 1 AND b_hi <= 6 THEN 'yes' ELSE 'no' END AS declared, CASE WHEN b_lo >= a_lo AND b_hi <= a_hi THEN 'yes' WHEN greatest(a_lo, b_lo) <= least(a_hi, b_hi) THEN 'maybe' ELSE 'no' END AS overlap FROM ({_GROUPS})")
def accept_intervals(spark, d):
    _A, _B = I.Interval.of("a"), I.Interval.of("b")
    declared = I.Interval(F.lit(1), F.lit(6))
    return _groups(spark, d).select("k", A.verdict(A.interval_accepts(declared, _B)).alias("declared"), A.verdict(A.intervals_overlap(_A, _B)).alias("overlap"))


@query("accept_literal_sets", "SELECT p_brand, CASE WHEN len(list_filter(list(DISTINCT p_size % 10), lambda x: x NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8))) = 0 THEN 'yes' ELSE 'no' END AS verdict FROM part GROUP BY 1")
def accept_literal_sets(spark, d):
    values = table(spark, d, "part").select("p_brand", (F.col("p_size") % 10).alias("v")).distinct()
    return values.groupBy("p_brand").agg(F.collect_list("v").alias("v")).select("p_brand", A.verdict(A.literals_accept(F.array(*map(F.lit, range(9))), F.col("v"))).alias("verdict"))


@query("accept_union_members", "WITH m AS (SELECT p_type, p_size % 4 AS v, CASE WHEN p_size % 4 IN (0, 1) THEN 2 WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS t FROM part) SELECT p_type, CASE min(t) WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'yes' END AS given_union, CASE max(t) WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'yes' END AS declared_union FROM m GROUP BY 1")
def accept_union_members(spark, d):
    """A given union needs every member accepted; a declared one needs one member that accepts."""
    v = F.col("p_size") % 4
    t = F.when(v.isin(0, 1), A.YES).when(v == 2, A.MAYBE).otherwise(A.NO)
    return table(spark, d, "part").groupBy("p_type").agg(A.verdict(A.all_of(t)).alias("given_union"), A.verdict(A.any_of(t)).alias("declared_union"))


@query("accept_classes", "SELECT event_type AS cls, CASE event_type WHEN 'click' THEN 'yes' WHEN 'view' THEN 'yes' WHEN 'purchase' THEN 'yes' WHEN 'error' THEN 'no' ELSE 'maybe' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def accept_classes(spark, d):
    ancestors = {"click": ("view",), "purchase": ("click", "view"), "error": ()}
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cls")).agg(F.count("*").alias("n")).select("cls", A.verdict(A.class_accepts("view", F.col("cls"), ancestors)).alias("verdict"), "n")


@query("accept_refined", r"SELECT p_brand, bool_and(regexp_matches(substr(p_brand, 7), '\A-?[0-9]+\z')) AS same, CASE WHEN bool_and(regexp_matches(substr(p_brand, 7), '\A-?[0-9]+\z')) THEN 'yes' ELSE 'no' END AS verdict FROM part GROUP BY 1")
def accept_refined(spark, d):
    """A constant that satisfies the predicate is accepted; anything else is rejected, not doubted."""
    holds = F.bool_and(R.STRINGS["decimal-int-string"](F.substr("p_brand", F.lit(7))))
    return table(spark, d, "part").groupBy("p_brand").agg(holds.alias("same")).withColumn("verdict", A.verdict(F.when(F.col("same"), A.YES).otherwise(A.NO)))


@query("accept_difference", "SELECT p_type, CAST(min(p_size) AS BIGINT) AS lo, CASE WHEN count_if(p_size = 25) = 0 THEN 'yes' ELSE 'no' END AS without_25 FROM part GROUP BY 1")
def accept_difference(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.min("p_size").cast("long").alias("lo"), A.verdict(F.when(F.count_if(F.col("p_size") == 25) == 0, A.YES).otherwise(A.NO)).alias("without_25"))


@query("accept_intersection", "SELECT p_type, CASE WHEN bool_and(p_size > 0) AND bool_and(p_size < 50) THEN 'yes' ELSE 'no' END AS all_members, CASE WHEN bool_and(p_size > 0) OR bool_and(p_size < 50) THEN 'yes' ELSE 'no' END AS any_member FROM part GROUP BY 1")
def accept_intersection(spark, d):
    g = table(spark, d, "part").groupBy("p_type").agg(F.bool_and(F.col("p_size") > 0).alias("a"), F.bool_and(F.col("p_size") < 50).alias("b"))
    t = lambda c: F.when(c, A.YES).otherwise(A.NO)
    return g.select("p_type", A.verdict(F.least(t(F.col("a")), t(F.col("b")))).alias("all_members"), A.verdict(F.greatest(t(F.col("a")), t(F.col("b")))).alias("any_member"))


@query("accept_record_shapes", "SELECT CAST(count_if(json_exists(props, '$.k')) AS BIGINT) AS required, CAST(count_if(len(json_keys(props)) = 1) AS BIGINT) AS closed, CASE WHEN bool_and(json_exists(props, '$.k') AND len(json_keys(props)) = 1) THEN 'yes' ELSE 'no' END AS verdict FROM events")
def accept_record_shapes(spark, d):
    """A closed record needs its required keys and rejects others."""
    keys = F.json_object_keys("props")
    has, only = F.array_contains(keys, "k"), F.size(keys) == 1
    return table(spark, d, "events").agg(F.count_if(has).alias("required"), F.count_if(only).alias("closed"), A.verdict(F.when(F.bool_and(has & only), A.YES).otherwise(A.NO)).alias("verdict"))


@query("narrow_contract_facts", "SELECT p_type, CAST(count(*) AS BIGINT) AS n, CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi FROM part WHERE p_size BETWEEN 10 AND 40 AND p_brand <> '' GROUP BY 1")
def narrow_contract_facts(spark, d):
    """Contracts declared in the fields' metadata narrow like conditions do."""
    from ..api import contract_filter, declared

    part = declared(table(spark, d, "part"), p_size="int<10, 40>", p_brand="non-empty-string")
    return part.where(contract_filter(part)).groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_size").cast("long").alias("lo"), F.max("p_size").cast("long").alias("hi"))


@query("narrow_assignment_early_exit", "SELECT l_orderkey, CAST(sum(q) AS BIGINT) AS total FROM (SELECT l_orderkey, CAST(floor(l_quantity / 2) AS BIGINT) AS q FROM lineitem) WHERE q >= 10 AND NOT q > 20 GROUP BY 1")
def narrow_assignment_early_exit(spark, d):
    """`return unless (q = n / 2) >= 10`, then `return if q > 20`: only the live edges go on."""
    q = F.col("q")
    rows = table(spark, d, "lineitem").withColumn("q", F.floor(F.col("l_quantity") / 2))
    live = rows.where(N.keep(q, Test(">=", 10))).where(N.drop(q, Test(">", 20)))
    return live.groupBy("l_orderkey").agg(F.sum("q").alias("total"))
