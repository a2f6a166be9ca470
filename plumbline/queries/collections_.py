"""Queries of tuple, record and block functions, and of iterators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import collections_ as C
from ..operators.ordering import positioned_within
from ..registry import query, table



def _tuples(spark, d):
    """Per supplier and order the quantities of its lines, ascending: short tuples of integers."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"))
    return li.select(F.col("l_orderkey").alias("k"), "q")


_T = "(SELECT l_orderkey AS k, list_sort(list(CAST(l_quantity AS BIGINT))) AS q FROM lineitem GROUP BY 1)"


def _text(c):
    return F.array_join(c, "|")


def _s(x: str) -> str:
    return f"array_to_string({x}, '|')"


@query("tup_ends_size", f"SELECT k, q[1] AS first, q[-1] AS last, CAST(len(q) AS BIGINT) AS n, len(q) = 0 AS empty, len(q) > 0 AS any, {_s('q')} AS items FROM {_T}")
def tup_ends_size(spark, d):
    q = F.col("q")
    return _tuples(spark, d).select("k", C.first(q).alias("first"), C.last(q).alias("last"), F.size(q).cast("long").alias("n"), (F.size(q) == 0).alias("empty"), (F.size(q) > 0).alias("any"), _text(q).alias("items"))


@query("tup_folds", f"SELECT k, CAST(coalesce(list_sum(q), 0) AS BIGINT) AS sum, list_min(q) AS least, list_max(q) AS most, {_s('list_sort(q)')} AS sorted, {_s('list_reverse(q)')} AS reversed, list_contains(q, 7) AS seven, len(list_filter(q, lambda x: x > 0)) = len(q) AS all_truthy, len(list_filter(q, lambda x: x > 0)) = 0 AS none_truthy FROM {_T}")
def tup_folds(spark, d):
    q = F.col("q")
    positive = lambda x: x > 0
    return _tuples(spark, d).select("k", C.total(q).alias("sum"), F.array_min(q).alias("least"), F.array_max(q).alias("most"), _text(F.array_sort(q)).alias("sorted"), _text(F.reverse(q)).alias("reversed"), C.include(q, F.lit(7).cast("long")).alias("seven"), C.all_(q, positive).alias("all_truthy"), C.none_(q, positive).alias("none_truthy"))


@query("tup_access", f"SELECT k, q[3] AS third, CASE WHEN len(q) >= 2 THEN q[-2] END AS second_last, CASE WHEN len(q) >= 1 THEN {_s('q[2:3]')} END AS pair, CASE WHEN len(q) >= 4 THEN {_s('q[5:6]')} END AS far, {_s('q[2:]')} AS tail, CAST(CASE WHEN len(q) >= 2 THEN len(q) - 2 END AS BIGINT) AS idx FROM {_T}")
def tup_access(spark, d):
    """[2], [-2], [1, 2], [4, 2] (nil beyond the size), [1..], and what -2 is as an index."""
    q = F.col("q")
    rest = F.slice(q, F.lit(2), F.greatest(F.size(q), F.lit(1)))
    return _tuples(spark, d).select("k", C.at(q, 2).alias("third"), C.at(q, -2).alias("second_last"), _text(C.slice_(q, 1, 2)).alias("pair"), _text(C.slice_(q, 4, 2)).alias("far"), _text(rest).alias("tail"), C.normal_index(q, F.lit(-2)).cast("long").alias("idx"))


@query("tup_fetch_dig", f"SELECT k, CASE WHEN len(q) > 1 THEN q[2] END AS fetched, CASE WHEN len(q) > 1 THEN q[2] * 10 END AS dug FROM {_T}")
def tup_fetch_dig(spark, d):
    q = F.col("q")
    nested = F.transform(q, lambda x: F.array(x, x * 10))
    return _tuples(spark, d).select("k", F.get(q, F.lit(1)).alias("fetched"), F.get(F.get(nested, F.lit(1)), F.lit(1)).alias("dug"))


@query("tup_zip_to_h", f"SELECT k, array_to_string(list_transform(q, lambda x, i: x || ':' || coalesce(CAST(q[i + 1] AS VARCHAR), 'nil')), '|') AS zipped, len(list_distinct(q)) = len(q) AS to_h FROM {_T}")
def tup_zip_to_h(spark, d):
    """Zipped with its own tail: the receiver's length, nil where the tail is shorter. to_h declines repeated keys."""
    q = F.col("q")
    tail = F.slice(q, F.lit(2), F.greatest(F.size(q), F.lit(1)))
    pairs = C.zip_to(q, tail)
    shown = F.transform(pairs, lambda p: F.concat(p["left"].cast("string"), F.lit(":"), F.coalesce(p["right"].cast("string"), F.lit("nil"))))
    keys = F.transform(q, lambda x: F.struct(x, x))
    return _tuples(spark, d).select("k", _text(shown).alias("zipped"), (F.size(F.array_distinct(q)) == F.size(keys)).alias("to_h"))


@query("tup_uniq_compact_flatten", f"SELECT k, {_s('list_sort(list_distinct(q))')} AS uniq, {_s('list_filter(list_transform(q, lambda x: CASE WHEN x > 25 THEN x END), lambda y: y IS NOT NULL)')} AS compacted, {_s('flatten(list_transform(q, lambda x: [x, -x]))')} AS flat FROM {_T}")
def tup_uniq_compact_flatten(spark, d):
    q = F.col("q")
    return _tuples(spark, d).select("k", _text(F.array_sort(C.unique(q))).alias("uniq"), _text(C.compact(F.transform(q, lambda x: F.when(x > 25, x)))).alias("compacted"), _text(F.flatten(F.transform(q, lambda x: F.array(x, -x)))).alias("flat"))


@query("blk_select_reject", f"SELECT k, {_s('list_filter(q, lambda x: x % 2 = 0)')} AS selected, {_s('list_filter(q, lambda x: x % 2 <> 0)')} AS rejected, {_s('list_filter(q, lambda x: x < 20)')} AS taken, {_s('list_filter(q, lambda x: x >= 20)')} AS dropped FROM {_T}")
def blk_select_reject(spark, d):
    """The tuples ascend, so what take_while takes is what lies below the bound."""
    q = F.col("q")
    even, low = (lambda x: x % 2 == 0), (lambda x: x < 20)
    return _tuples(spark, d).select("k", _text(F.filter(q, even)).alias("selected"), _text(F.filter(q, lambda x: ~even(x))).alias("rejected"), _text(C.take_while(q, low)).alias("taken"), _text(C.drop_while(q, low)).alias("dropped"))


@query("blk_quantifiers", f"SELECT k, len(list_filter(q, lambda x: x > 10)) = len(q) AS all, len(list_filter(q, lambda x: x > 45)) > 0 AS any, len(list_filter(q, lambda x: x > 45)) = 0 AS none, CAST(len(list_filter(q, lambda x: x > 25)) AS BIGINT) AS n, list_filter(q, lambda x: x > 25)[1] AS found, CAST(CASE WHEN len(list_filter(q, lambda x: x > 25)) > 0 THEN len(list_filter(q, lambda x: x <= 25)) END AS BIGINT) AS at FROM {_T}")
def blk_quantifiers(spark, d):
    q = F.col("q")
    return _tuples(spark, d).select("k", C.all_(q, lambda x: x > 10).alias("all"), C.any_(q, lambda x: x > 45).alias("any"), C.none_(q, lambda x: x > 45).alias("none"), C.count_(q, lambda x: x > 25).alias("n"), C.detect(q, lambda x: x > 25).alias("found"), C.detect_index(q, lambda x: x > 25).alias("at"))


@query("blk_emptiness", f"SELECT k, CASE WHEN len(list_filter(q, lambda x: x > 48)) = 0 THEN 'empty' ELSE 'non_empty' END AS emptiness FROM {_T}")
def blk_emptiness(spark, d):
    q = F.col("q")
    return _tuples(spark, d).select("k", F.when(F.size(F.filter(q, lambda x: x > 48)) == 0, "empty").otherwise("non_empty").alias("emptiness"))


@query("blk_maps", f"SELECT k, {_s('list_transform(q, lambda x: x * x)')} AS mapped, {_s('list_filter(list_transform(q, lambda x: CASE WHEN x % 3 = 0 THEN x // 3 END), lambda y: y IS NOT NULL)')} AS filter_mapped, {_s('flatten(list_transform(q, lambda x: CASE WHEN x > 40 THEN [x, x] ELSE [x] END))')} AS flat_mapped, {_s('list_transform(q, lambda x: CAST(x AS VARCHAR))')} AS by_symbol FROM {_T}")
def blk_maps(spark, d):
    q = F.col("q")
    return _tuples(spark, d).select("k", _text(F.transform(q, lambda x: x * x)).alias("mapped"), _text(C.filter_map(q, lambda x: F.when(x % 3 == 0, (x / 3).cast("long")))).alias("filter_mapped"), _text(C.flat_map(q, lambda x: F.when(x > 40, F.array(x, x)).otherwise(F.array(x)))).alias("flat_mapped"), _text(F.transform(q, lambda x: x.cast("string"))).alias("by_symbol"))


@query("blk_range_receiver", "SELECT p_partkey, CASE WHEN p_size % 12 <= 8 THEN array_to_string(list_transform(range(1, p_size % 12 + 1), lambda x: x * 2), '|') END AS doubled FROM part")
def blk_range_receiver(spark, d):
    """Ranges of eight elements at most are enumerated."""
    n = (F.col("p_size") % 12).cast("long")
    return table(spark, d, "part").select("p_partkey", F.when(n <= 8, _text(F.transform(C.upto(F.lit(1).cast("long"), n), lambda x: x * 2))).alias("doubled"))


@query("itr_times_upto_downto", "SELECT p_partkey, array_to_string(range(0, p_size % 6), '|') AS times, CASE WHEN p_size % 6 >= 2 THEN array_to_string(range(2, p_size % 6 + 1), '|') ELSE '' END AS up, CASE WHEN p_size % 6 <= 3 THEN array_to_string(range(3, p_size % 6 - 1, -1), '|') ELSE '' END AS down FROM part")
def itr_times_upto_downto(spark, d):
    n = (F.col("p_size") % 6).cast("long")
    two, three = F.lit(2).cast("long"), F.lit(3).cast("long")
    return table(spark, d, "part").select("p_partkey", _text(C.times(n)).alias("times"), _text(C.upto(two, n)).alias("up"), _text(C.downto(three, n)).alias("down"))


@query("itr_each_with_index", f"SELECT k, CAST(i - 1 AS BIGINT) AS idx, q[i] AS item FROM (SELECT k, q, unnest(range(1, len(q) + 1)) AS i FROM {_T})")
def itr_each_with_index(spark, d):
    return _tuples(spark, d).select("k", F.posexplode("q").alias("idx", "item")).select("k", F.col("idx").cast("long").alias("idx"), "item")


@query("itr_inject", f"SELECT k, list_reduce(q, lambda a, x: (a * 31 + x) % 100003) AS reduced, list_reduce(list_prepend(7, q), lambda a, x: (a * 31 + x) % 100003) AS seeded, {_s('list_transform(q, lambda x: x + len(q))')} AS with_memo FROM {_T}")
def itr_inject(spark, d):
    q = F.col("q")
    step = lambda a, x: (a * 31 + x) % 100003
    tail = F.slice(q, F.lit(2), F.greatest(F.size(q), F.lit(1)))
    return _tuples(spark, d).select("k", F.aggregate(tail, C.first(q), step).alias("reduced"), F.aggregate(q, F.lit(7).cast("long"), step).alias("seeded"), _text(F.transform(q, lambda x: x + F.size(q))).alias("with_memo"))


@query("itr_group_partition", f"SELECT k, {_s('list_filter(q, lambda x: x > 25)')} AS yes, {_s('list_filter(q, lambda x: x <= 25)')} AS no, CAST(len(list_distinct(list_transform(q, lambda x: x % 4))) AS BIGINT) AS groups FROM {_T}")
def itr_group_partition(spark, d):
    q = F.col("q")
    p = C.partition_(q, lambda x: x > 25)
    return _tuples(spark, d).select("k", _text(p["yes"]).alias("yes"), _text(p["no"]).alias("no"), F.size(F.array_distinct(F.transform(q, lambda x: x % 4))).cast("long").alias("groups"))


@query("itr_each_cons_slice", f"SELECT k, array_to_string(list_transform(range(1, greatest(len(q) - 1, 0)), lambda s: array_to_string(q[s:s + 2], '-')), '|') AS cons, array_to_string(list_transform(range(0, CAST(ceil(len(q) / 2) AS BIGINT)), lambda s: array_to_string(q[s * 2 + 1:s * 2 + 2], '-')), '|') AS slices FROM {_T}")
def itr_each_cons_slice(spark, d):
    q = F.col("q")
    shown = lambda c: _text(F.transform(c, lambda x: F.array_join(x, "-")))
    return _tuples(spark, d).select("k", shown(C.each_cons(q, 3)).alias("cons"), shown(C.each_slice(q, 2)).alias("slices"))


@query("itr_element_types", f"SELECT k, CASE WHEN min(x) = max(x) THEN CAST(min(x) AS VARCHAR) ELSE 'int<' || min(x) || ', ' || max(x) || '>' END AS element FROM (SELECT k, unnest(q) AS x FROM {_T}) GROUP BY k")
def itr_element_types(spark, d):
    q = F.col("q")
    from ..operators.intervals import Interval, describe

    return _tuples(spark, d).select("k", describe(Interval(F.array_min(q), F.array_max(q))).alias("element"))


def _records(spark, d):
    """Per user the number of each event type, as a record with sorted keys."""
    by = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return by.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))


_R = "(SELECT user_id, list(event_type ORDER BY event_type) AS ks, list(n ORDER BY event_type) AS vs FROM (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2) GROUP BY 1)"


@query("hsh_keys_values", f"SELECT user_id, CAST(len(ks) AS BIGINT) AS n, len(ks) = 0 AS empty, len(ks) > 0 AS any, {_s('ks')} AS keys, {_s('vs')} AS vals, {_s('list_transform(ks, lambda x, i: x || chr(61) || vs[i])')} AS pairs, ks[1] || '=' || vs[1] AS first FROM {_R}")
def hsh_keys_values(spark, d):
    m = F.col("m")
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    pairs = F.transform(F.map_entries(m), pair)
    return _records(spark, d).select("user_id", F.size(m).cast("long").alias("n"), (F.size(m) == 0).alias("empty"), (F.size(m) > 0).alias("any"), _text(F.map_keys(m)).alias("keys"), _text(F.map_values(m)).alias("vals"), _text(pairs).alias("pairs"), C.first(pairs).alias("first"))


@query("hsh_invert_flatten", f"SELECT user_id, CASE WHEN len(list_distinct(vs)) = len(vs) THEN {_s('list_sort(vs)')} END AS inverted, {_s('flatten(list_transform(ks, lambda x, i: [x, CAST(vs[i] AS VARCHAR)]))')} AS flat, {_s('list_filter(ks, lambda x, i: vs[i] > 12)')} AS compacted FROM {_R}")
def hsh_invert_flatten(spark, d):
    m = F.col("m")
    flat = F.flatten(F.transform(F.map_entries(m), lambda e: F.array(e["key"], e["value"].cast("string"))))
    thin = C.record_compact(F.transform_values(m, lambda _, v: F.when(v > 12, v)))
    return _records(spark, d).select("user_id", _text(F.array_sort(F.map_keys(C.record_invert(m)))).alias("inverted"), _text(flat).alias("flat"), _text(F.map_keys(thin)).alias("compacted"))


@query("hsh_merge_lookup", f"SELECT user_id, {_s('list_transform(ks, lambda x, i: x || chr(61) || CASE x WHEN chr(118) || chr(105) || chr(101) || chr(119) THEN 0 ELSE vs[i] END)')} || CASE WHEN list_contains(ks, 'view') THEN '' ELSE '|view=0' END || '|zoo=1' AS merged, vs[list_position(ks, 'click')] AS clicks, CAST(NULL AS BIGINT) AS missing, coalesce(CAST(vs[list_position(ks, 'error')] AS VARCHAR), 'nil') || ',' || 'nil' AS at FROM {_R}")
def hsh_merge_lookup(spark, d):
    m = F.col("m")
    right = F.create_map(F.lit("view"), F.lit(0).cast("long"), F.lit("zoo"), F.lit(1).cast("long"))
    merged = F.transform(F.map_entries(C.record_merge(m, right)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    at = F.transform(C.values_at(m, "error", "nothing"), lambda v: F.coalesce(v.cast("string"), F.lit("nil")))
    return _records(spark, d).select("user_id", _text(merged).alias("merged"), F.try_element_at(m, F.lit("click")).alias("clicks"), F.try_element_at(m, F.lit("nothing")).alias("missing"), F.array_join(at, ",").alias("at"))


@query("hsh_dig", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS dug, CAST(NULL AS BIGINT) AS missing FROM events")
def hsh_dig(spark, d):
    """dig through a record, a tuple and nil."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    nested = F.create_map(F.lit("a"), F.array(F.create_map(F.lit("b"), k + 1)))
    step = F.get(F.try_element_at(nested, F.lit("a")), F.lit(0))
    gone = F.get(F.try_element_at(nested, F.lit("z")), F.lit(0))
    return table(spark, d, "events").select("event_id", F.try_element_at(step, F.lit("b")).alias("dug"), F.try_element_at(gone, F.lit("b")).alias("missing"))


@query("prj_keys_values", f"SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(ks) AS k FROM {_R}) GROUP BY k")
def prj_keys_values(spark, d):
    """key_of over all records: the union of their keys."""
    m = F.col("m")
    return _records(spark, d).select(F.explode(F.map_keys(m)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("prj_pick_omit", "SELECT c_custkey, c_name, c_mktsegment, c_nationkey AS kept_nation FROM customer")
def prj_pick_omit(spark, d):
    """pick keeps the table's order of columns, omit drops; unknown names change nothing."""
    df = table(spark, d, "customer")
    wanted = {"c_mktsegment", "c_name", "c_custkey", "nothing"}
    picked = df.select(*[c for c in df.columns if c in wanted], F.col("c_nationkey").alias("kept_nation"))
    return picked.drop("nothing")


@query("prj_struct_shapes", "SELECT c_custkey, c_name AS picked, CAST(NULL AS VARCHAR) AS partial, c_mktsegment AS indexed FROM customer")
def prj_struct_shapes(spark, d):
    s = F.struct("c_name", "c_mktsegment", "c_acctbal")
    df = table(spark, d, "customer").select("c_custkey", s.alias("s"))
    return df.select("c_custkey", F.col("s").dropFields("c_acctbal", "c_mktsegment").getField("c_name").alias("picked"), F.when(F.lit(False), F.col("s.c_name")).alias("partial"), F.col("s")["c_mktsegment"].alias("indexed"))


@query("prj_required", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def prj_required(spark, d):
    """required: rows in which every key of the shape is there."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id", "left")
    return j.na.drop(subset=["quality"])


@query("prj_shape_policies", "SELECT c_custkey, 'c_name' AS field, c_name AS was, c_name || '!' AS now FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), NULL FROM customer WHERE c_custkey % 7 = 0 AND c_nationkey IS NOT NULL")
def prj_shape_policies(spark, d):
    """readonly_of: a later version of customers, in which two marked fields and one unmarked one have changed."""
    from ..operators.records import overwritten, readonly

    df = table(spark, d, "customer")
    k = F.col("c_custkey")
    later = df.withColumns({"c_name": F.when(k % 10 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")), "c_nationkey": F.when(k % 7 != 0, F.col("c_nationkey")), "c_acctbal": F.col("c_acctbal") + 1})
    return overwritten(readonly(df, "c_custkey", "c_name", "c_nationkey", "nothing"), later, "c_custkey")


@query("prj_destructure", "SELECT doc_id, w[1] AS a, CAST(greatest(len(w) - 2, 0) AS BIGINT) AS middle, CASE WHEN len(w) >= 2 THEN w[-1] END AS z, w[2] AS second FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def prj_destructure(spark, d):
    """a, *middle, z = words"""
    w = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", C.first(w).alias("a"), F.greatest(F.size(w) - 2, F.lit(0)).cast("long").alias("middle"), F.when(F.size(w) >= 2, C.last(w)).alias("z"), F.get(w, F.lit(1)).alias("second"))


@query("prj_patterns", "SELECT k, CASE WHEN len(q) = 1 THEN 'one' WHEN len(q) >= 2 AND list_contains(q, 50) THEN 'find' WHEN len(q) >= 2 THEN 'many' ELSE 'none' END AS arm, CASE WHEN len(q) = 1 THEN q[1] WHEN len(q) >= 2 AND list_contains(q, 50) THEN 50 WHEN len(q) >= 2 THEN q[-1] END AS bound FROM " + _T)
def prj_patterns(spark, d):
    """case/in with [x], [*, 50, *] and [*, x] patterns; the name bound is the union over the arms."""
    q = F.col("q")
    one, find, many = F.size(q) == 1, (F.size(q) >= 2) & F.array_contains(q, 50), F.size(q) >= 2
    arm = F.when(one, "one").when(find, "find").when(many, "many").otherwise("none")
    return _tuples(spark, d).select("k", arm.alias("arm"), F.coalesce(F.when(one, C.first(q)), F.when(find, F.lit(50)), F.when(many, C.last(q))).alias("bound"))


@query("size_projections", f"SELECT k, len(q) >= 0 AS non_negative, len(q) > 0 AS positive, false AS empty, len(q) BETWEEN 1 AND 7 AS declared FROM {_T} WHERE len(q) > 0")
def size_projections(spark, d):
    q = F.col("q")
    n = F.size(q)
    return _tuples(spark, d).where(n > 0).select("k", (n >= 0).alias("non_negative"), (n > 0).alias("positive"), F.lit(False).alias("empty"), n.between(1, 7).alias("declared"))


@query("refined_method_projections", r"SELECT p_type, lower(lower(p_type)) = lower(p_type) AS downcase_is_self, upper(lower(p_type)) = upper(upper(p_type)) AS upcase_is_upper, bool_and(try_cast(substr(p_brand, 7) AS BIGINT) IS NOT NULL) AS to_i_known FROM part GROUP BY 1, 2, 3")
def refined_method_projections(spark, d):
    low = F.lower("p_type")
    rows = table(spark, d, "part").select("p_type", (F.lower(low) == low).alias("downcase_is_self"), (F.upper(low) == F.upper("p_type")).alias("upcase_is_upper"), F.substr("p_brand", F.lit(7)).try_cast("long").isNotNull().alias("known"))
    return rows.groupBy("p_type", "downcase_is_self", "upcase_is_upper").agg(F.bool_and("known").alias("to_i_known"))


@query("iter_table_slices", "SELECT CAST((r - 1) // 100 AS BIGINT) AS slice, CAST(count(*) AS BIGINT) AS n, CAST(min(p_partkey) AS BIGINT) AS first FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) GROUP BY 1")
def iter_table_slices(spark, d):
    rows = positioned_within(table(spark, d, "part").select("p_partkey", "p_type"), ["p_type"], "p_partkey")
    return rows.select("p_partkey", F.floor(F.col("position") / 100).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("iter_table_cons", "SELECT l_partkey, CAST(count(*) AS BIGINT) AS windows, CAST(max(a + b + c) AS BIGINT) AS heaviest FROM (SELECT l_partkey, CAST(l_quantity AS BIGINT) AS a, lead(CAST(l_quantity AS BIGINT), 1) OVER w AS b, lead(CAST(l_quantity AS BIGINT), 2) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity)) WHERE c IS NOT NULL GROUP BY 1")
def iter_table_cons(spark, d):
    """each_cons(3) over a part's lines by date."""
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    x = F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select("l_partkey", x.alias("a"), F.lead(x, 1).over(w).alias("b"), F.lead(x, 2).over(w).alias("c")).where("c is not null")
    return rows.groupBy("l_partkey").agg(F.count("*").alias("windows"), F.max(F.col("a") + F.col("b") + F.col("c")).alias("heaviest"))
