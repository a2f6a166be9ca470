"""More of the scalar and collection library: numbers, enumerables, sets, ranges, rationals, text that needs Python, and plan-level acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collections_ as C
from ..functions import numeric as M
from ..functions import unicode as U
from ..plans import acceptance as A
from ..plans import catalogue as K
from ..plans import lattice as L
from ..registry import query, table
from .calls import case

_T = "(SELECT l_orderkey AS k, list_sort(list(CAST(l_quantity AS BIGINT))) AS q FROM lineitem GROUP BY 1)"


def _tuples(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"))
    return li.select(F.col("l_orderkey").alias("k"), "q")


def _text(c):
    return F.array_join(c, "|")


@query("num_digits_bits", "SELECT p_partkey, array_to_string(list_reverse(string_split(CAST(p_partkey AS VARCHAR), '')), '|') AS digits, (p_partkey & 6) = 6 AS all_bits, (p_partkey & 6) <> 0 AS any_bits, (p_partkey & 6) = 0 AS no_bits, CAST((p_partkey >> 1) & 1 AS BIGINT) AS bit, p_partkey << 3 AS shifted, p_partkey >> 2 AS unshifted FROM part")
def num_digits_bits(spark, d):
    k = F.col("p_partkey")
    both = k.bitwiseAND(F.lit(6).cast("long"))
    return table(spark, d, "part").select("p_partkey", _text(F.reverse(F.split(k.cast("string"), ""))).alias("digits"), (both == 6).alias("all_bits"), (both != 0).alias("any_bits"), (both == 0).alias("no_bits"), F.shiftright(k, 1).bitwiseAND(F.lit(1).cast("long")).alias("bit"), F.shiftleft(k, 3).alias("shifted"), F.shiftright(k, 2).alias("unshifted"))


@query("num_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice / 100) * 100 AS BIGINT) AS down, CAST(ceil(l_extendedprice / 100) * 100 AS BIGINT) AS up, round(l_extendedprice / 7, 6) AS fdiv, CAST(sign(l_extendedprice - 20000) AS BIGINT) AS sgn, round(sqrt(l_extendedprice), 6) AS root, CAST(floor(sqrt(l_extendedprice)) AS BIGINT) AS isqrt FROM lineitem")
def num_rounding(spark, d):
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.floor(x / 100) * 100).cast("long").alias("down"), (F.ceil(x / 100) * 100).cast("long").alias("up"), F.round(x / 7, 6).alias("fdiv"), F.signum(x - 20000).cast("long").alias("sgn"), F.round(F.sqrt(x), 6).alias("root"), F.floor(F.sqrt(x)).alias("isqrt"))


@query("num_rational", "SELECT p_partkey, CAST(p_size // gcd(p_size, 12) AS BIGINT) AS numerator, CAST(12 // gcd(p_size, 12) AS BIGINT) AS denominator, CAST((p_size * 5 + 12 * 2) // gcd(p_size * 5 + 24, 60) AS BIGINT) AS sum_numerator, CAST(p_size * p_size + 9 AS BIGINT) AS abs2 FROM part")
def num_rational(spark, d):
    """Rational(p_size, 12) in lowest terms, plus 2/5; and Complex(p_size, 3).abs2."""
    n, twelve = F.col("p_size").cast("long"), F.lit(12).cast("long")
    g = M.gcd(n, twelve)
    top, bottom = n * 5 + 24, F.lit(60).cast("long")
    return table(spark, d, "part").select("p_partkey", M.floor_div(n, g).alias("numerator"), M.floor_div(twelve, g).alias("denominator"), M.floor_div(top, M.gcd(top, bottom)).alias("sum_numerator"), (n * n + 9).alias("abs2"))


@query("arr_rotate_insert", f"SELECT k, array_to_string(list_concat(q[2:], q[1:1]), '|') AS rotated, array_to_string(list_concat(q[1:1], [0::BIGINT], q[2:]), '|') AS inserted, array_to_string(list_concat(q, [7::BIGINT]), '|') AS pushed, array_to_string(list_prepend(7::BIGINT, q), '|') AS unshifted, array_to_string(list_filter(q, lambda x: x <> 7), '|') AS deleted FROM {_T}")
def arr_rotate_insert(spark, d):
    q = F.col("q")
    tail = F.slice(q, F.lit(2), F.greatest(F.size(q), F.lit(1)))
    head = F.slice(q, 1, 1)
    zero, seven = F.lit(0).cast("long"), F.lit(7).cast("long")
    return _tuples(spark, d).select("k", _text(F.concat(tail, head)).alias("rotated"), _text(F.concat(head, F.array(zero), tail)).alias("inserted"), _text(F.array_append(q, seven)).alias("pushed"), _text(F.array_prepend(q, seven)).alias("unshifted"), _text(F.array_remove(q, seven)).alias("deleted"))


@query("arr_take_drop_values", f"SELECT k, array_to_string(q[1:2], '|') AS taken, array_to_string(q[3:], '|') AS dropped, coalesce(CAST(q[1] AS VARCHAR), 'nil') || ',' || coalesce(CAST(q[3] AS VARCHAR), 'nil') AS at, CAST(len(q) * (len(q) - 1) // 2 AS BIGINT) AS combinations FROM {_T}")
def arr_take_drop_values(spark, d):
    q = F.col("q")
    at = F.transform(F.array(F.get(q, F.lit(0)), F.get(q, F.lit(2))), lambda x: F.coalesce(x.cast("string"), F.lit("nil")))
    pairs = F.flatten(F.transform(q, lambda x, i: F.transform(F.filter(q, lambda y, j: j > i), lambda y: F.struct(x, y))))
    return _tuples(spark, d).select("k", _text(F.slice(q, 1, 2)).alias("taken"), _text(F.slice(q, F.lit(3), F.greatest(F.size(q), F.lit(1)))).alias("dropped"), F.array_join(at, ",").alias("at"), F.size(pairs).cast("long").alias("combinations"))


@query("arr_index_bsearch", f"SELECT k, CAST(list_position(q, 7) - 1 AS BIGINT) AS idx, list_filter(q, lambda x: x >= 20)[1] AS searched, CAST(len(list_filter(q, lambda x: x = 7)) AS BIGINT) AS occurrences FROM {_T}")
def arr_index_bsearch(spark, d):
    q = F.col("q")
    p = F.array_position(q, 7)
    return _tuples(spark, d).select("k", F.when(p > 0, p - 1).alias("idx"), C.detect(q, lambda x: x >= 20).alias("searched"), C.count_(q, lambda x: x == 7).alias("occurrences"))


@query("enum_tally_minmax", "SELECT event_type, CAST(count(*) AS BIGINT) AS tally, round(min(value), 6) AS least, round(max(value), 6) AS most, arg_min(event_id, (value, event_id)) AS min_by, arg_max(event_id, (value, event_id)) AS max_by FROM events GROUP BY 1")
def enum_tally_minmax(spark, d):
    key = F.struct("value", "event_id")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("tally"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"), F.min_by("event_id", key).alias("min_by"), F.max_by("event_id", key).alias("max_by"))


@query("enum_sort_by_cycle", f"SELECT k, array_to_string(list_transform(list_sort(list_transform(q, lambda x: {{'a': x % 7, 'b': x}})), lambda s: s.b), '|') AS sorted_by, array_to_string(list_concat(q, q), '|') AS cycled FROM {_T}")
def enum_sort_by_cycle(spark, d):
    q = F.col("q")
    keyed = F.array_sort(F.transform(q, lambda x: F.struct((x % 7).alias("a"), x.alias("b"))))
    return _tuples(spark, d).select("k", _text(F.transform(keyed, lambda s: s["b"])).alias("sorted_by"), _text(F.flatten(F.array_repeat(q, 2))).alias("cycled"))


@query("enum_slice_when", f"SELECT k, CAST(1 + len(list_filter(range(2, len(q) + 1), lambda i: q[i] - q[i - 1] > 5)) AS BIGINT) AS slices FROM {_T}")
def enum_slice_when(spark, d):
    """Slices between neighbours more than five apart."""
    q = F.col("q")
    cuts = F.filter(F.transform(q, lambda x, i: F.when(i > 0, x - F.get(q, i - 1))), lambda g: g > 5)
    return _tuples(spark, d).select("k", (F.size(cuts) + 1).cast("long").alias("slices"))


@query("set_relations", "WITH s AS (SELECT user_id AS u, list(DISTINCT event_type) AS x FROM events GROUP BY 1) SELECT u, array_to_string(list_sort(list_intersect(x, ['click', 'view', 'zoo'])), '|') AS both, array_to_string(list_sort(list_filter(x, lambda v: v NOT IN ('click', 'view', 'zoo'))), '|') AS minus, list_has_all(['click', 'view', 'purchase', 'signup', 'error', 'zoo'], x) AS subset, list_has_all(x, ['click']) AS superset, NOT list_has_any(x, ['zoo']) AS disjoint, CAST(len(x) + 3 - 2 * len(list_intersect(x, ['click', 'view', 'zoo'])) AS BIGINT) AS symmetric FROM s")
def set_relations(spark, d):
    x = F.col("x")
    other = F.array(*map(F.lit, ("click", "view", "zoo")))
    every = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error", "zoo")))
    s = table(spark, d, "events").select(F.col("user_id").alias("u"), "event_type").distinct().groupBy("u").agg(F.collect_list("event_type").alias("x"))
    return s.select("u", _text(F.array_sort(F.array_intersect(x, other))).alias("both"), _text(F.array_sort(F.array_except(x, other))).alias("minus"), (F.size(F.array_except(x, every)) == 0).alias("subset"), F.array_contains(x, "click").alias("superset"), (~F.arrays_overlap(x, F.array(F.lit("zoo")))).alias("disjoint"), (F.size(F.array_except(x, other)) + F.size(F.array_except(other, x))).cast("long").alias("symmetric"))


@query("range_step_cover", "SELECT p_partkey, array_to_string(range(0, p_size + 1, 10), '|') AS steps, p_size BETWEEN 5 AND 9 AS covers, p_size >= 5 AND p_size < 9 AS covers_open, CAST(least(greatest(p_size, 5), 9) AS BIGINT) AS clamped FROM part")
def range_step_cover(spark, d):
    n = F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", _text(F.sequence(F.lit(0).cast("long"), n, F.lit(10).cast("long"))).alias("steps"), M.between(n, F.lit(5), F.lit(9)).alias("covers"), ((n >= 5) & (n < 9)).alias("covers_open"), M.clamp(n, F.lit(5), F.lit(9)).alias("clamped"))


@query("hsh_filters", "WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, coalesce(string_agg(CASE WHEN n > 12 THEN event_type END, '|' ORDER BY event_type), '') AS selected, coalesce(string_agg(CASE WHEN n <= 12 THEN event_type END, '|' ORDER BY event_type), '') AS rejected, string_agg(event_type || '=' || n * 2, '|' ORDER BY event_type) AS transformed, string_agg(upper(event_type), '|' ORDER BY event_type) AS renamed, CAST(sum(n) AS BIGINT) AS total, bool_or(n > 20) AS any_high FROM m GROUP BY 1")
def hsh_filters(spark, d):
    m = F.col("m")
    by = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    records = by.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    doubled = F.transform(F.map_entries(F.transform_values(m, lambda _, v: v * 2)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return records.select("user_id", _text(F.map_keys(F.map_filter(m, lambda _, v: v > 12))).alias("selected"), _text(F.map_keys(F.map_filter(m, lambda _, v: v <= 12))).alias("rejected"), _text(doubled).alias("transformed"), _text(F.map_keys(F.transform_keys(m, lambda k, _: F.upper(k)))).alias("renamed"), C.total(F.map_values(m)).alias("total"), C.any_(F.map_values(m), lambda v: v > 20).alias("any_high"))


@query("str_indexing", "SELECT p_partkey, left(p_type, 1) AS first, right(p_type, 1) AS last, substr(p_type, 2, 3) AS middle, replace(p_type, 'A', '@') AS replaced, CAST(instr(p_type, 'S') - 1 AS BIGINT) AS idx, regexp_extract(p_brand, '[0-9]+', 0) AS matched, insert_.x AS inserted FROM part, LATERAL (SELECT left(p_type, 2) || '-' || substr(p_type, 3) AS x) insert_")
def str_indexing(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.left(t, F.lit(1)).alias("first"), F.right(t, F.lit(1)).alias("last"), F.substring(t, 2, 3).alias("middle"), F.replace(t, F.lit("A"), F.lit("@")).alias("replaced"), (F.instr(t, "S") - 1).cast("long").alias("idx"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("matched"), F.concat(F.left(t, F.lit(2)), F.lit("-"), F.substr(t, F.lit(3))).alias("inserted"))


@query("str_digests_codes", "SELECT p_partkey, md5(p_brand) AS md5, sha256(p_brand) AS sha256, to_base64(encode(p_brand)) AS base64, upper(hex(encode(p_brand))) AS hex, CAST(0 AS BIGINT) AS casecmp FROM part")
def str_digests_codes(spark, d):
    b = F.col("p_brand")
    same = M.spaceship(F.lower(b), F.lower(F.upper(b)))
    return table(spark, d, "part").select("p_partkey", F.md5(b).alias("md5"), F.sha2(b, 256).alias("sha256"), F.base64(F.encode(b, "utf-8")).alias("base64"), F.hex(b).alias("hex"), same.alias("casecmp"))


@query("str_unicode", "SELECT doc_id, CAST(length(nfc_normalize(text)) AS BIGINT) AS composed FROM documents")
def str_unicode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(U.unicode_normalize(F.col("text"), "NFC")).cast("long").alias("composed"))


@query("str_successors", "SELECT 'brand' AS kind, p_brand AS x, 'Brand#' || (CAST(substr(p_brand, 7) AS BIGINT) + 1) AS next FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'customer', c_name, 'Customer#' || lpad(CAST(CAST(substr(c_name, 10) AS BIGINT) + 1 AS VARCHAR), 9, '0') FROM customer UNION ALL SELECT 'amount', x, printf('%.1f', CAST(x AS DOUBLE) + 0.1) FROM (SELECT DISTINCT printf('%.1f', l_quantity) AS x FROM lineitem)")
def str_successors(spark, d):
    """Carries run through digits, over a point too; letters to the left of a digit take none."""
    brands = table(spark, d, "part").select(F.lit("brand").alias("kind"), F.col("p_brand").alias("x")).distinct()
    names = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("x"))
    amounts = table(spark, d, "lineitem").select(F.lit("amount").alias("kind"), F.format_string("%.1f", F.col("l_quantity").cast("double")).alias("x")).distinct()
    return brands.union(names).union(amounts).select("kind", "x", U.succ(F.col("x")).alias("next"))


@query("path_algebra", "SELECT page_id, '/' || l || '/./' || page_id || '/../x//y' AS path, '/' || l || '/x/y' AS clean, CASE l WHEN 'en' THEN 'x/y' ELSE '../' || l || '/x/y' END AS relative FROM (SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS l FROM pages)")
def path_algebra(spark, d):
    """Paths made of pages' addresses, cleaned, and from /en to them."""
    lang, path = F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1), F.col("path")
    df = table(spark, d, "pages").select("page_id", F.concat(F.lit("/"), lang, F.lit("/./"), F.col("page_id").cast("string"), F.lit("/../x//y")).alias("path"))
    return df.select("page_id", "path", U.cleanpath(path).alias("clean"), U.relative_path(U.cleanpath(path), "/en").alias("relative"))


@query("date_sequences", "SELECT o_orderkey, array_to_string(list_transform(range(0, 3), lambda i: strftime(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER), '%m/%d')), '|') AS days, strftime(date_trunc('week', CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS monday, dayofweek(o_orderdate) IN (0, 6) AS weekend, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap FROM orders")
def date_sequences(spark, d):
    c = F.col("o_orderdate").cast("date")
    y = F.year(c)
    days = F.transform(F.sequence(c, F.date_add(c, 2)), lambda x: F.date_format(x, "MM/dd"))
    return table(spark, d, "orders").select("o_orderkey", _text(days).alias("days"), F.date_format(F.date_sub(c, F.weekday(c)), "yyyy-MM-dd").alias("monday"), F.dayofweek(c).isin(1, 7).alias("weekend"), (((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)).alias("leap"))


_NAMES = ("upper", "rand", "now", "nothing_known", "sha2", "sort!")
_CALLS = "(SELECT CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NAMES)) + " END AS name, p_size FROM part)"


def _calls(spark, d):
    """A call for each part: one of six names."""
    at = (F.pmod("p_partkey", F.lit(len(_NAMES))) + 1).cast("int")
    return table(spark, d, "part").select(F.element_at(F.array(*map(F.lit, _NAMES)), at).alias("name"), "p_size")


@query("catalogue_purity", f"SELECT name, CASE name WHEN 'upper' THEN 'leaf' WHEN 'sha2' THEN 'leaf' WHEN 'rand' THEN 'impure' WHEN 'now' THEN 'session' END AS purity, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM {_CALLS} GROUP BY 1")
def catalogue_purity(spark, d):
    """Calls by name with what the catalogue says of them; names that it lacks have no purity."""
    used = _calls(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
    return used.join(K.catalogue(spark), "name", "left").select("name", "purity", "n", "total")


@query("catalogue_permission", f"SELECT name, name = 'upper' AS foldable, CAST(count(*) AS BIGINT) AS n FROM {_CALLS} GROUP BY 1")
def catalogue_permission(spark, d):
    return K.permitted(_calls(spark, d), spark, blocked=("sha2",)).groupBy("name", "foldable").agg(F.count("*").alias("n"))


_I, _S = L.Nominal("Integer"), L.Nominal("String")
_PAIRS = {
    "top by bot": (L.Bot(), L.Top(), "no"), "any takes bot": (_I, L.Bot(), "yes"), "gradual": (_I, L.Dynamic(), "yes"), "subclass": (L.Nominal("Numeric"), _I, "yes"), "other class": (_S, _I, "no"), "unresolved": (L.Nominal("Mystery"), _I, "maybe"),
    "given union": (_I, L.union(L.Constant(1), L.Constant("a")), "no"), "declared union": (L.union(_I, _S), L.Constant("a"), "yes"), "interval in": (L.IntegerRange(0, 9), L.Constant(3), "yes"), "interval out": (L.IntegerRange(0, 9), L.IntegerRange(5, 12), "no"), "interval of Integer": (L.IntegerRange(0, None), _I, "no"), "universal interval": (L.IntegerRange(None, None), _I, "yes"),
    "difference": (L.Difference(_S, L.Constant("")), L.Constant("a"), "yes"), "difference removed": (L.Difference(_S, L.Constant("")), L.Constant(""), "no"), "difference unproven": (L.Difference(_S, L.Constant("")), _S, "no"), "refined constant": (L.Refined(_S, "lowercase"), L.Constant("ab"), "yes"), "refined other": (L.Refined(_S, "lowercase"), _S, "no"),
    "intersection": (L.intersection(L.Difference(_S, L.Constant("")), L.Refined(_S, "lowercase")), L.Constant("x"), "yes"), "tuple": (L.Tuple((_I, _S)), L.Tuple((L.Constant(1), L.Constant("a"))), "yes"), "tuple arity": (L.Tuple((_I,)), L.Tuple(()), "no"), "shape": (L.Shape((L.Field("a", _I),)), L.Shape((L.Field("a", L.Constant(1)),)), "yes"),
    "shape extra": (L.Shape((L.Field("a", _I),)), L.Shape((L.Field("a", _I), L.Field("b", _I))), "no"), "shape optional": (L.Shape((L.Field("a", _I),)), L.Shape((L.Field("a", _I, optional=True),)), "no"), "generic": (L.Nominal("Array", (_I,)), L.Nominal("Array", (_S,)), "no"), "generic bare": (L.Nominal("Array", (_I,)), L.Nominal("Array"), "maybe"), "generic tuple": (L.Nominal("Array", (_I,)), L.Tuple((L.Constant(1),)), "yes"), "singleton": (L.Singleton("A"), L.Singleton("B"), "no"),
}


@case("plan_acceptance", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[2]}')" for k, v in _PAIRS.items()) + ") t(subject, verdict)")
def plan_acceptance(spark, d):
    return spark.createDataFrame([(k, A.accepts(a, b)) for k, (a, b, _) in _PAIRS.items()], "subject string, verdict string")
