"""Queries over profiles, refinements, coverage and aggregates of domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import refine as R
from ..registry import query, table


def _profile_sql(name: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for c, cls in columns:
        few = f"CASE WHEN count(DISTINCT {c}) <= 8 THEN"
        listed = cls in ("String", "Integer")
        bounds = f"CAST(min({c}) AS BIGINT) AS lo, CAST(max({c}) AS BIGINT) AS hi" if cls == "Integer" else "CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi"
        proofs = {"decimal-int-string": rf"regexp_matches({c}, '\A-?[0-9]+\z')", "lowercase-string": f"{c} = lower({c})", "non-empty-string": f"{c} <> ''", "numeric-string": rf"regexp_matches({c}, '\A-?[0-9]+(?:\.[0-9]+)?\z')", "uppercase-string": f"{c} = upper({c})"}
        proven = "concat_ws(',', " + ", ".join(f"CASE WHEN bool_and({x}) THEN '{k}' END" for k, x in proofs.items()) + ")" if cls == "String" else "''"
        nd = f"CAST({few} count(DISTINCT {c}) END AS BIGINT)" if listed else "CAST(NULL AS BIGINT)"
        lit = f"{few} array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), '|') END" if listed else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{name}' AS tbl, '{c}' AS col, '{cls}' AS cls, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count({c}) AS BIGINT) AS n_null, {bounds}, {proven} AS refinements, {nd} AS n_distinct, {lit} AS literals FROM {name}")
    return " UNION ALL ".join(parts)


TABLES = {
    "orders": [("o_orderkey", "Integer"), ("o_custkey", "Integer"), ("o_orderstatus", "String"), ("o_totalprice", "Float"), ("o_orderdate", "Time"), ("o_orderpriority", "String")],
    "lineitem": [("l_orderkey", "Integer"), ("l_partkey", "Integer"), ("l_suppkey", "Integer"), ("l_linenumber", "Integer"), ("l_quantity", "Float"), ("l_extendedprice", "Float"), ("l_discount", "Float"), ("l_tax", "Float"), ("l_returnflag", "String"), ("l_linestatus", "String"), ("l_shipdate", "Time")],
    "events": [("event_id", "Integer"), ("ts", "Time"), ("user_id", "Integer"), ("event_type", "String"), ("value", "Float"), ("props", "String")],
    "part": [("p_partkey", "Integer"), ("p_name", "String"), ("p_brand", "String"), ("p_type", "String"), ("p_size", "Integer"), ("p_retailprice", "Float")],
    "customer": [("c_custkey", "Integer"), ("c_name", "String"), ("c_nationkey", "Integer"), ("c_acctbal", "Float"), ("c_mktsegment", "String")],
}
for _name, _columns in TABLES.items():
    query(f"profile_{_name}", _profile_sql(_name, _columns))(lambda spark, d, n=_name, cs=_columns: P.profile(table(spark, d, n).select(*[c for c, _ in cs]), n))


def _tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("t"))


_STRING_SQL = {
    "non-empty-string": "t <> ''", "lowercase-string": "t = lower(t)", "non-lowercase-string": "t <> lower(t)", "uppercase-string": "t = upper(t)", "non-uppercase-string": "t <> upper(t)",
    "numeric-string": r"regexp_matches(t, '\A-?[0-9]+(?:\.[0-9]+)?\z')", "non-numeric-string": r"NOT regexp_matches(t, '\A-?[0-9]+(?:\.[0-9]+)?\z')", "decimal-int-string": r"regexp_matches(t, '\A-?[0-9]+\z')",
    "octal-int-string": r"regexp_matches(t, '\A-?(?:0[oO][0-7]+|0[0-7]+)\z')", "hex-int-string": r"regexp_matches(t, '\A-?0[xX][0-9a-fA-F]+\z')",
    "non-empty-lowercase-string": "t <> '' AND t = lower(t)", "non-empty-uppercase-string": "t <> '' AND t = upper(t)", "literal-string": "t IS NOT NULL", "non-empty-literal-string": "t <> ''",
}


def _counts(df, predicates: dict):
    """A row for each predicate, from one pass."""
    whole = df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(f"h{i}") for i, p in enumerate(predicates.values())], F.count("*").alias("total"))
    return whole.select(F.inline(F.array(*[F.struct(F.lit(k).alias("refinement"), F.col(f"h{i}").alias("holds"), F.col("total")) for i, k in enumerate(predicates)])))


def _counts_sql(source: str, predicates: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS refinement, CAST(count_if({x}) AS BIGINT) AS holds, CAST(count(*) AS BIGINT) AS total FROM ({source})" for k, x in predicates.items())


@query("ref_string_predicates", _counts_sql("SELECT unnest(string_split(text, ' ')) AS t FROM documents", _STRING_SQL))
def ref_string_predicates(spark, d):
    return _counts(_tokens(spark, d), {k: R.STRINGS[k](F.col("t")) for k in _STRING_SQL})


@query("ref_numeric_text", _counts_sql("SELECT CASE p_partkey % 5 WHEN 0 THEN '0x' || printf('%x', p_partkey) WHEN 1 THEN '0' || printf('%o', p_partkey) WHEN 2 THEN CAST(-p_partkey AS VARCHAR) WHEN 3 THEN CAST(p_partkey AS VARCHAR) || '.5' ELSE CAST(p_partkey AS VARCHAR) || chr(10) END AS t FROM part", {k: _STRING_SQL[k] for k in ("numeric-string", "decimal-int-string", "octal-int-string", "hex-int-string", "non-numeric-string")}))
def ref_numeric_text(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 5 == 1, F.concat(F.lit("0"), F.conv(k.cast("string"), 10, 8))).when(k % 5 == 2, (-k).cast("string")).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(".5"))).otherwise(F.concat(k.cast("string"), F.lit("\n")))
    df = table(spark, d, "part").select(text.alias("t"))
    return _counts(df, {n: R.STRINGS[n](F.col("t")) for n in ("numeric-string", "decimal-int-string", "octal-int-string", "hex-int-string", "non-numeric-string")})


@query("ref_int_predicates", _counts_sql("SELECT o_custkey - 75 AS t FROM orders", {"non-zero-int": "t <> 0", "positive-int": "t > 0", "non-negative-int": "t >= 0", "negative-int": "t < 0", "non-positive-int": "t <= 0", "int<-5, 20>": "t BETWEEN -5 AND 20", "int<min, 3>": "t <= 3", "int<7, max>": "t >= 7"}))
def ref_int_predicates(spark, d):
    df = table(spark, d, "orders").select((F.col("o_custkey") - 75).alias("t"))
    names = (*R.INTEGERS, "int<-5, 20>", "int<min, 3>", "int<7, max>")
    return _counts(df, {n: R.compile_payload(n)(F.col("t")) for n in names})


@query("ref_collections", _counts_sql("SELECT list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '[0-9]')) AS t FROM documents", {"non-empty-array": "len(t) > 0", "non-empty-array[numeric-string]": r"len(t) > 0 AND len(list_filter(t, lambda x: NOT regexp_matches(x, '\A-?[0-9]+(?:\.[0-9]+)?\z'))) = 0"}))
def ref_collections(spark, d):
    df = table(spark, d, "documents").select(F.filter(F.split("text", " "), lambda x: x.rlike("[0-9]")).alias("t"))
    return _counts(df, {n: R.compile_payload(n)(F.col("t")) for n in ("non-empty-array", "non-empty-array[numeric-string]")})


@query("ref_complements", _counts_sql("SELECT nullif(c_mktsegment, 'BUILDING') AS t FROM customer", {"lowercase-string": "t = lower(t)", "not lowercase-string": "t <> lower(t)", "uppercase-string": "t = upper(t)", "not uppercase-string": "t <> upper(t)", "numeric-string": r"regexp_matches(t, '\A-?[0-9]+(?:\.[0-9]+)?\z')", "not numeric-string": r"NOT regexp_matches(t, '\A-?[0-9]+(?:\.[0-9]+)?\z')"}))
def ref_complements(spark, d):
    t = F.col("t")
    df = table(spark, d, "customer").select(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("t"))
    return _counts(df, {k: f for n in R.COMPLEMENTS for k, f in ((n, R.NAMES[n](t)), (f"not {n}", R.complement(n)(t)))})


@query("ref_regex_capture", r"SELECT capture, 'decimal-int-string' AS refinement, CAST(count(*) AS BIGINT) AS n, bool_and(regexp_matches(capture, '\A-?[0-9]+\z')) AS holds FROM (SELECT regexp_extract(p_brand, 'Brand#(\d+)', 1) AS capture FROM part) GROUP BY capture")
def ref_regex_capture(spark, d):
    refinement = R.capture_refinement(r"\d+")
    df = table(spark, d, "part").select(F.regexp_extract("p_brand", r"Brand#(\d+)", 1).alias("capture"))
    return df.groupBy("capture").agg(F.lit(refinement).alias("refinement"), F.count("*").alias("n"), F.bool_and(R.NAMES[refinement](F.col("capture"))).alias("holds"))


@query("ref_parser_unions", _counts_sql("SELECT nullif(p_size, 7) AS t FROM part", {"int<1, 9> | 40 | nil": "coalesce(t BETWEEN 1 AND 9, false) OR coalesce(t = 40, false) OR t IS NULL", "negative-int | int<49, max>": "coalesce(t < 0, false) OR coalesce(t >= 49, false)"}))
def ref_parser_unions(spark, d):
    df = table(spark, d, "part").select(F.nullif(F.col("p_size"), F.lit(7)).alias("t"))
    return _counts(df, {n: R.compile_payload(n)(F.col("t")) for n in ("int<1, 9> | 40 | nil", "negative-int | int<49, max>")})


@query("domain_union_widening", "SELECT o_orderpriority AS k, CASE WHEN count(DISTINCT o_custkey % 13) <= 8 THEN array_to_string(list_sort(list(DISTINCT o_custkey % 13)), '|') END AS literals, CAST(min(o_custkey % 13) AS BIGINT) AS lo, CAST(max(o_custkey % 13) AS BIGINT) AS hi FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, CASE WHEN count(DISTINCT o_custkey % 5) <= 8 THEN array_to_string(list_sort(list(DISTINCT o_custkey % 5)), '|') END, CAST(min(o_custkey % 5) AS BIGINT), CAST(max(o_custkey % 5) AS BIGINT) FROM orders GROUP BY 1")
def domain_union_widening(spark, d):
    orders = table(spark, d, "orders")

    def widen(key: str, m: int):
        values = orders.select(F.col(key).alias("k"), (F.col("o_custkey") % m).alias("v")).groupBy("k", "v").agg(F.lit(1).alias("one"))
        return values.groupBy("k").agg(F.when(F.count("*") <= P.MOST_LITERALS, F.array_join(F.array_sort(F.collect_list("v")), "|")).alias("literals"), F.min("v").alias("lo"), F.max("v").alias("hi"))

    return widen("o_orderpriority", 13).unionByName(widen("o_orderstatus", 5))


@query("coverage_by_lang", "SELECT lang AS node_class, CAST(count(*) AS BIGINT) AS visited, CAST(count_if(q.doc_id IS NULL) AS BIGINT) AS unrecognised, round(count_if(q.doc_id IS NULL) / count(*), 6) AS ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) q USING (doc_id) GROUP BY lang")
def coverage_by_lang(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("seen")).distinct(), "doc_id", "left")
    return P.coverage(docs, "lang", F.col("seen").isNull())


@query("coverage_scan_accumulator", "SELECT source, lang, CAST(count(*) AS BIGINT) AS visited, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source, lang")
def coverage_scan_accumulator(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("visited"), F.sum("n_chars").alias("chars"))


@query("distinct_exact", "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1")
def distinct_exact(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("arity_envelope", "WITH n AS (SELECT l_suppkey, l_orderkey, count(*) AS arity FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, CAST(min(arity) AS BIGINT) AS least, CAST(CASE WHEN bool_or(arity > 3) THEN NULL ELSE max(arity) END AS BIGINT) AS most, bool_and(arity < 9) AS eligible FROM n GROUP BY 1")
def arity_envelope(spark, d):
    """Least and greatest number of lines of a supplier in an order; over three counts as unbounded."""
    n = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("arity"))
    return n.groupBy("l_suppkey").agg(F.min("arity").alias("least"), F.when(~F.bool_or(F.col("arity") > 3), F.max("arity")).alias("most"), F.bool_and(F.col("arity") < 9).alias("eligible"))


@query("observed_calls", "SELECT event_type AS method, CAST(user_id % 3 AS BIGINT) AS arity, CAST(count(*) AS BIGINT) AS calls, array_to_string(list_sort(list(DISTINCT CASE WHEN value < 0 THEN 'negative' WHEN value < 50 THEN 'low' ELSE 'high' END)), '|') AS argument FROM events GROUP BY 1, 2")
def observed_calls(spark, d):
    kind = F.when(F.col("value") < 0, "negative").when(F.col("value") < 50, "low").otherwise("high")
    rows = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 3).alias("arity"), kind.alias("kind"))
    by = rows.groupBy("method", "arity", "kind").agg(F.count("*").alias("n"))
    return by.groupBy("method", "arity").agg(F.sum("n").alias("calls"), F.array_join(F.array_sort(F.collect_list("kind")), "|").alias("argument"))


@query("descriptor_compose", "WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS slot, CASE page_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS strict, page_id % 7 AS v FROM pages) SELECT slot, CAST(max(strict) AS BIGINT) AS comparator, count(DISTINCT v) > 1 AS conflict FROM p GROUP BY slot")
def descriptor_compose(spark, d):
    """By slot (a normalised url) the strictest comparator (digest 3, time 2, presence 1), and whether its values disagree."""
    p = table(spark, d, "pages")
    slot = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    strict = F.when(F.col("page_id") % 3 == 0, 3).when(F.col("page_id") % 3 == 1, 2).otherwise(1)
    values = p.select(slot.alias("slot"), strict.alias("strict"), (F.col("page_id") % 7).alias("v")).groupBy("slot", "v").agg(F.max("strict").alias("strict"))
    return values.groupBy("slot").agg(F.max("strict").cast("long").alias("comparator"), (F.count("*") > 1).alias("conflict"))


@query("cache_stats", "SELECT event_type AS producer, CAST(count_if(user_id % 4 = 0) AS BIGINT) AS hits, CAST(count_if(user_id % 4 = 1) AS BIGINT) AS misses, CAST(count_if(user_id % 4 > 1) AS BIGINT) AS writes FROM events GROUP BY 1")
def cache_stats(spark, d):
    m = F.col("user_id") % 4
    return table(spark, d, "events").groupBy(F.col("event_type").alias("producer")).agg(F.count_if(m == 0).alias("hits"), F.count_if(m == 1).alias("misses"), F.count_if(m > 1).alias("writes"))


@query("duplicate_declarations", "SELECT text, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id) AS BIGINT) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_declarations(spark, d):
    return P.repeated(table(spark, d, "documents"), "doc_id", "text")


@query("class_index_union", "SELECT l_returnflag AS class, 'l_linestatus' AS field, array_to_string(list_sort(list(DISTINCT l_linestatus)), '|') AS writes FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_linenumber', array_to_string(list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))), '|') FROM lineitem GROUP BY 1")
def class_index_union(spark, d):
    """(class, field) to the union of what is written to it: fields, class-wide and global values alike."""
    li = table(spark, d, "lineitem")
    pairs = li.select(F.col("l_returnflag").alias("class"), F.explode(F.array(F.struct(F.lit("l_linestatus").alias("field"), F.col("l_linestatus").alias("v")), F.struct(F.lit("l_linenumber").alias("field"), F.col("l_linenumber").cast("string").alias("v")))).alias("w")).select("class", "w.*").distinct()
    return pairs.groupBy("class", "field").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("writes"))


@query("visibility_tables", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS visibility, CAST(count(*) AS BIGINT) AS marks FROM events GROUP BY user_id")
def visibility_tables(spark, d):
    """The last marker of a key wins."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("visibility"), F.count("*").alias("marks"))


@query("reporter_dedupe", "SELECT DISTINCT p_brand, p_type FROM part")
def reporter_dedupe(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("trinary_logic", "WITH v AS (SELECT l_orderkey, CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.07 THEN 1 ELSE 2 END AS t FROM lineitem) SELECT l_orderkey, CASE min(t) WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'yes' END AS all_of, CASE max(t) WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'yes' END AS any_of, CASE 2 - min(t) WHEN 0 THEN 'no' WHEN 1 THEN 'maybe' ELSE 'yes' END AS negated FROM v GROUP BY 1")
def trinary_logic(spark, d):
    from ..operators.accept import all_of, any_of, negate, verdict

    t = F.when(F.col("l_discount") < 0.03, 0).when(F.col("l_discount") < 0.07, 1).otherwise(2)
    li = table(spark, d, "lineitem").select("l_orderkey", t.alias("t"))
    return li.groupBy("l_orderkey").agg(verdict(all_of("t")).alias("all_of"), verdict(any_of("t")).alias("any_of"), verdict(negate(all_of("t"))).alias("negated"))


@query("diagnostics_by_severity", "SELECT CASE WHEN l_discount > 0.09 THEN 'error' WHEN l_discount > 0.05 THEN 'warning' ELSE 'info' END AS severity, CAST(count(*) AS BIGINT) AS n, count_if(l_discount > 0.09) = 0 AS success FROM lineitem GROUP BY 1")
def diagnostics_by_severity(spark, d):
    s = F.when(F.col("l_discount") > 0.09, "error").when(F.col("l_discount") > 0.05, "warning").otherwise("info")
    return table(spark, d, "lineitem").groupBy(s.alias("severity")).agg(F.count("*").alias("n"), (F.count_if(F.col("l_discount") > 0.09) == 0).alias("success"))


@query("run_stats")
def run_stats(spark, d):
    """Files, bytes and rows of each table as Spark sees them."""
    parts = []
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        df = table(spark, d, name).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        by = df.groupBy("path").agg(F.max("size").alias("size"), F.count("*").alias("n"))
        parts.append(by.agg(F.lit(name).alias("tbl"), F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("n").alias("n_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
