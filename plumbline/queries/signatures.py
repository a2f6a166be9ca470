"""Queries about layered signatures, arity and parameters, positions, and how much of the tables is recognised."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import metrics as M
from ..operators import ordering as O
from ..operators import scan as N
from ..operators import signatures as G
from ..operators.shared import shared_folder
from ..registry import query, table
from .classes import _edges

_TAKES = "o_custkey % 3 AS required, o_orderkey % 2 AS optional, o_orderkey % 97 = 0 AS rest, CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END AS keywords"
_LAYERS = (
    "j AS (SELECT *, o_orderpriority AS member, o_orderstatus AS kind FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    f"p AS (SELECT 0 AS layer, n_name AS cls, member, kind, {_TAKES} FROM j WHERE o_totalprice > 400000 UNION SELECT 1, n_name, member, kind, {_TAKES} FROM j WHERE o_totalprice > 350000 UNION SELECT 1, r_name, member, kind, {_TAKES} FROM j WHERE o_totalprice > 450000), "
    "w AS (SELECT *, min(layer) OVER (PARTITION BY cls, member, kind) AS first FROM p), "
    "e AS (SELECT cls, member, kind, layer, CAST(count(*) AS BIGINT) AS overloads, bool_or(keywords > 0) AS void, bool_or(rest) AS rest, CAST(min(required) AS BIGINT) AS lo, CAST(max(required + optional) AS BIGINT) AS hi FROM w WHERE layer = first GROUP BY 1, 2, 3, 4)"
)


def _orders(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.withColumns({"member": F.col("o_orderpriority"), "kind": F.col("o_orderstatus")})


def _signatures(spark, d):
    """Nations declare what their large orders had; a second provider declares more of them, and regions. Orders are overloads."""
    key = F.col("o_orderkey")
    takes = [(F.col("o_custkey") % 3).alias("required"), (key % 2).alias("optional"), (key % 97 == 0).alias("rest"), (key % 89 == 0).cast("int").alias("required_keywords"), F.lit(0).alias("trailing"), F.lit(False).alias("untyped")]
    rows = _orders(spark, d)

    def of(cls, least):
        return rows.where(F.col("o_totalprice") > least).select(F.col(cls).alias("cls"), "member", "kind", *takes)

    return G.layered(of("n_name", 400000), of("n_name", 350000).unionByName(of("r_name", 450000)))


@query("signature_layers", f"WITH {_LAYERS} SELECT cls, member, kind, CAST(layer AS BIGINT) AS layer, overloads, void, CASE WHEN NOT void THEN lo END AS least, CASE WHEN NOT void AND NOT rest THEN hi END AS most FROM e")
def signature_layers(spark, d):
    """Who declares a member, with how many overloads, and what they take together."""
    return G.envelope(_signatures(spark, d), *G.KEY, "layer").withColumn("layer", F.col("layer").cast("long"))


@query("call_arity", f"WITH {_LAYERS}, l AS (SELECT l_orderkey, count(*) AS given FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey, given, coalesce(a.cls, b.cls) AS owner, CASE WHEN a.cls IS NULL THEN b.void ELSE a.void END AS void, CASE WHEN a.cls IS NULL THEN b.lo ELSE a.lo END AS least, CASE WHEN a.cls IS NULL THEN CASE WHEN NOT b.rest THEN b.hi END ELSE CASE WHEN NOT a.rest THEN a.hi END END AS most FROM j JOIN l ON l_orderkey = o_orderkey LEFT JOIN e a ON a.cls = n_name AND a.member = j.member AND a.kind = j.kind LEFT JOIN e b ON b.cls = r_name AND b.member = j.member AND b.kind = j.kind WHERE o_orderkey % 10 <> 0) SELECT o_orderkey, owner, CAST(given AS BIGINT) AS given, least, most, 'call.wrong-arity' AS rule, 'given ' || given || ', expected ' || least || '..' || coalesce(CAST(most AS VARCHAR), '') AS message FROM c WHERE NOT void AND (given < least OR coalesce(given > most, false))")
def call_arity(spark, d):
    """Orders as calls of their customer's member with as many arguments as they have lines; every tenth passes its arguments on and isn't judged."""
    given = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("given"))
    calls = _orders(spark, d).join(given, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("c_name").alias("cls"), "member", "kind", "given", (F.col("o_orderkey") % 10 != 0).alias("plain"))
    found = G.wrong_arity(calls, _signatures(spark, d), H.labelled(_edges(spark, d)))
    return found.select("o_orderkey", "owner", "given", "least", "most", "rule", "message")


@query("parameters_bound", "WITH s AS (SELECT DISTINCT l_suppkey, CASE WHEN l_linenumber = 7 THEN 'rest' WHEN l_linenumber = 6 THEN 'keyword' ELSE 'required' END AS slot, CAST(l_linenumber AS BIGINT) AS position, 'p' || l_partkey % 5 AS name, l_linestatus, l_quantity, l_discount FROM lineitem), u AS (SELECT DISTINCT l_suppkey, slot, position, name FROM s), t AS (SELECT l_suppkey, slot, CASE slot WHEN 'required' THEN CAST(position AS VARCHAR) WHEN 'keyword' THEN name ELSE '' END AS place, array_to_string(list_sort(list(DISTINCT CASE l_linestatus WHEN 'O' THEN 'Integer' ELSE 'String' END)), '|') AS type FROM s WHERE l_quantity > 40 GROUP BY 1, 2, 3), o AS (SELECT DISTINCT l_suppkey, name FROM s WHERE l_discount >= 0.09 AND l_quantity < 5) SELECT u.l_suppkey, u.slot, u.position, u.name, CASE WHEN o.name IS NOT NULL THEN 'non-empty-string' WHEN u.slot = 'rest' THEN 'Array[' || coalesce(t.type, 'untyped') || ']' ELSE coalesce(t.type, 'untyped') END AS type FROM u LEFT JOIN t ON t.l_suppkey = u.l_suppkey AND t.slot = u.slot AND t.place = CASE u.slot WHEN 'required' THEN CAST(u.position AS VARCHAR) WHEN 'keyword' THEN u.name ELSE '' END LEFT JOIN o ON o.l_suppkey = u.l_suppkey AND o.name = u.name")
def parameters_bound(spark, d):
    """Suppliers as methods, places of lines as parameters; large lines declare types, small ones with a discount override by name."""
    line = F.col("l_linenumber")
    slot = F.when(line == 7, "rest").when(line == 6, "keyword").otherwise("required")
    rows = table(spark, d, "lineitem").select("l_suppkey", slot.alias("slot"), line.cast("long").alias("position"), F.concat(F.lit("p"), F.col("l_partkey") % 5).alias("name"), F.when(F.col("l_linestatus") == "O", "Integer").otherwise("String").alias("type"), "l_quantity", "l_discount")
    overrides = rows.where("l_discount >= 0.09 and l_quantity < 5").select("l_suppkey", "name", F.lit("non-empty-string").alias("type"))
    return G.bound(rows.select("l_suppkey", "slot", "position", "name").distinct(), rows.where("l_quantity > 40"), overrides, ["l_suppkey"])


_SCANNED = [("documents", "doc_id", "Integer"), ("documents", "text", "String"), ("documents", "lang", "String"), ("documents", "source", "String"), ("documents", "n_chars", "Integer"), ("customer", "c_custkey", "Integer"), ("customer", "c_name", "String"), ("customer", "c_nationkey", "Integer"), ("customer", "c_acctbal", "Float"), ("customer", "c_mktsegment", "String")]
_UNLIKE = {"Integer": "{0} <= 0", "Float": "false", "String": "NOT ({0} = lower({0}) AND {0} <> '')"}


def _scanned(spark, d):
    return N.type_scan({t: table(spark, d, t).select(*[c for s, c, _ in _SCANNED if s == t]) for t in ("documents", "customer")}, {"Integer": ["positive-int"], "String": ["non-empty-lowercase-string"]})


@query("type_scan", "WITH s AS (" + " UNION ALL ".join(f"SELECT '{cls}' AS cls, count({c}) AS visited, count_if({_UNLIKE[cls].format(c)}) AS unrecognised FROM {t}" for t, c, cls in _SCANNED) + ") SELECT cls, CAST(sum(visited) AS BIGINT) AS visited, CAST(sum(unrecognised) AS BIGINT) AS unrecognised, round(sum(unrecognised) / sum(visited), 6) AS ratio FROM s GROUP BY cls")
def type_scan(spark, d):
    """All columns of two tables: whole numbers have to be positive, texts lower-case and not empty."""
    return N.by_class(_scanned(spark, d), show_recognised=True)


@query("explain_fallbacks", "WITH s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS path, '{c}' AS \"column\", '{cls}' AS cls, count({c}) AS v, count_if({_UNLIKE[cls].format(c)}) AS u FROM {t}" for t, c, cls in _SCANNED) + ") SELECT path, CAST(NULL AS VARCHAR) AS line, \"column\", 'info' AS severity, 'fallback' AS rule, 'builtin' AS source_family, u || ' of ' || v || ' values of ' || \"column\" || ' (' || cls || ') are not recognised' AS message FROM s WHERE u > 0")
def explain_fallbacks(spark, d):
    return M.fallbacks(_scanned(spark, d))


@query("run_metrics", "SELECT unnest(['rows', 'large', 'customers_from', 'customers_to']) AS figure, unnest([count(*), CAST(count_if(o_totalprice > 400000) AS BIGINT), min(o_custkey), max(o_custkey)]) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def run_metrics(spark, d):
    """Orders of customers in credit are stored; the figures come from the job that writes them."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_totalprice")
    key = F.col("o_custkey").cast("long")
    _, seen = M.stored(rows, shared_folder(spark, "metrics"), large=F.count_if(F.col("o_totalprice") > 400000), customers_from=F.min(key), customers_to=F.max(key))
    return spark.createDataFrame([(k, v) for k, v in seen.items() if k != "seconds"], "figure string, value long")


@query("file_order", "SELECT doc_id, row_number() OVER () - 1 AS position FROM documents")
def file_order(spark, d):
    """Positions of documents in their files."""
    return O.in_file_order(table(spark, d, "documents").select("doc_id")).select("doc_id", "position")


@query("affinity_order", "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY far, p_partkey) - 1 AS position FROM (SELECT *, CASE WHEN split_part(p_type, ' ', 1) = first_word THEN 0 ELSE 1 END AS far FROM (SELECT p.*, min(split_part(p_type, ' ', 1)) OVER (PARTITION BY p_brand) AS first_word FROM part p))")
def affinity_order(spark, d):
    """Parts of a brand as overloads: those of the receiver's class (the brand's least first word) first, then as declared."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("word"))
    least = rows.groupBy("p_brand").agg(F.min("word").alias("receiver"))
    far = rows.join(least, "p_brand").select("p_partkey", "p_brand", (F.col("word") != F.col("receiver")).cast("int").alias("far"))
    return O.positioned_within(far, ["p_brand"], "far", "p_partkey").select("p_partkey", "p_brand", "position")
