"""Queries of environment joins, lookups, set operations, windows and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import envjoin as E
from ..operators import graph as G
from ..operators import ordering as O
from ..registry import query, table


def _env(spark, d, status: str):
    """Environment of one branch: priority (name) to the residues seen (domain)."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == status)
    rows = o.select(F.concat("o_orderpriority", F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.lit("-" + status))).alias("name"), (F.col("o_custkey") % 5).cast("string").alias("v")).distinct()
    return rows.groupBy("name").agg(F.collect_list("v").alias("domain"))


_ENV = "SELECT o_orderpriority || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '-{0}' END AS name, list(DISTINCT CAST(o_custkey % 5 AS VARCHAR)) AS domain FROM orders WHERE o_orderstatus = '{0}' GROUP BY 1"


@query("env_inner_join", f"WITH a AS ({_ENV.format('F')}), b AS ({_ENV.format('O')}) SELECT name, array_to_string(list_sort(list_distinct(list_concat(a.domain, b.domain))), '|') AS domain FROM a JOIN b USING (name)")
def env_inner_join(spark, d):
    return E.join_bindings(_env(spark, d, "F"), _env(spark, d, "O")).select("name", F.array_join("domain", "|").alias("domain"))


@query("env_outer_nil_join", f"WITH a AS ({_ENV.format('F')}), b AS ({_ENV.format('O')}) SELECT name, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.domain, ['nil']), coalesce(b.domain, ['nil'])))), '|') AS domain FROM a FULL JOIN b USING (name)")
def env_outer_nil_join(spark, d):
    return E.join_with_nil(_env(spark, d, "F"), _env(spark, d, "O")).select("name", F.array_join("domain", "|").alias("domain"))


@query("fact_intersection", "SELECT event_type, user_id FROM events WHERE event_id % 2 = 0 INTERSECT SELECT event_type, user_id FROM events WHERE event_id % 2 = 1")
def fact_intersection(spark, d):
    e = table(spark, d, "events")
    return E.common_facts(*[e.where(F.col("event_id") % 2 == k).select("event_type", "user_id") for k in (0, 1)])


@query("lookup_nearest_ancestor", "WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region), up(child, ancestor, depth) AS (SELECT n, n, 0 FROM (SELECT child AS n FROM e UNION SELECT parent FROM e) UNION ALL SELECT u.child, e.parent, u.depth + 1 FROM up u JOIN e ON e.child = u.ancestor), o AS (SELECT 'WORLD' AS owner, 'size' AS member UNION ALL SELECT r_name, 'size' FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT n_name, 'size' FROM nation WHERE n_nationkey % 5 = 0) SELECT child, member, arg_min(o.owner, depth) AS owner FROM up JOIN o ON o.owner = up.ancestor GROUP BY 1, 2")
def lookup_nearest_ancestor(spark, d):
    """A member is found on the class itself, else on the nearest ancestor."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    owned = spark.createDataFrame([("WORLD", "size")], "owner string, member string")
    owned = owned.unionByName(r.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("owner"), F.lit("size").alias("member"))).unionByName(n.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("owner"), F.lit("size").alias("member")))
    return G.nearest(G.closure(_edges(spark, d)), owned)


def _edges(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return up.unionByName(r.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent")))


@query("hierarchy_closure", "SELECT n_name AS child, n_name AS ancestor, CAST(0 AS BIGINT) AS depth FROM nation UNION ALL SELECT r_name, r_name, 0 FROM region UNION ALL SELECT 'WORLD', 'WORLD', 0 UNION ALL SELECT n_name, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD', 1 FROM region UNION ALL SELECT n_name, 'WORLD', 2 FROM nation")
def hierarchy_closure(spark, d):
    return G.closure(_edges(spark, d))


@query("class_ordering", "SELECT a.n_name AS x, b.r_name AS y, CASE WHEN a.n_regionkey = b.r_regionkey THEN 'subclass' ELSE 'disjoint' END AS relation FROM nation a, region b")
def class_ordering(spark, d):
    """Each nation against each region: below it or apart (a question on both small dimension tables)."""
    up = G.closure(_edges(spark, d)).where("depth = 1").select(F.col("child").alias("x"), F.col("ancestor").alias("y"), F.lit("subclass").alias("relation"))
    asked = table(spark, d, "nation").select(F.col("n_name").alias("x")).join(F.broadcast(table(spark, d, "region").select(F.col("r_name").alias("y"))))
    return asked.join(up, ["x", "y"], "left").select("x", "y", F.coalesce("relation", F.lit("disjoint")).alias("relation"))


@query("lookup_catalogue", "SELECT e.event_id, c.purity FROM events e LEFT JOIN (VALUES ('click', 'leaf'), ('view', 'leaf'), ('purchase', 'mutates')) c(event_type, purity) USING (event_type)")
def lookup_catalogue(spark, d):
    c = spark.createDataFrame([("click", "leaf"), ("view", "leaf"), ("purchase", "mutates")], "event_type string, purity string")
    return table(spark, d, "events").join(F.broadcast(c), "event_type", "left").select("event_id", "purity")


@query("union_receiver_dispatch", "SELECT user_id, bool_and(event_type IN ('click', 'view', 'signup')) AS resolves, CAST(count(DISTINCT event_type) AS BIGINT) AS members FROM events GROUP BY 1")
def union_receiver_dispatch(spark, d):
    """A union answers only if each of its members does."""
    known = F.broadcast(spark.createDataFrame([("click",), ("view",), ("signup",)], "event_type string").withColumn("hit", F.lit(True)))
    members = table(spark, d, "events").select("user_id", "event_type").distinct().join(known, "event_type", "left")
    return members.groupBy("user_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("resolves"), F.count("*").alias("members"))


@query("nil_receiver_division", "SELECT source, count_if(l.quality IS NULL) > 0 AND count(l.quality) > 0 AS possible_nil, CAST(count_if(l.quality IS NULL) AS BIGINT) AS nils FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def nil_receiver_division(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.count_if(F.col("quality").isNull())
    return j.groupBy("source").agg(((n > 0) & (F.count("quality") > 0)).alias("possible_nil"), n.alias("nils"))


@query("plugin_fact_join", "WITH f AS (SELECT p_brand AS plugin, p_type AS name, min(p_size) AS v, count(DISTINCT p_size) AS n FROM part GROUP BY 1, 2) SELECT plugin, name, CAST(v AS BIGINT) AS v, n > 1 AS conflict FROM f")
def plugin_fact_join(spark, d):
    """Facts are written once, or equal: more values of a key are a conflict."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("plugin"), F.col("p_type").alias("name")).agg(F.min("p_size").cast("long").alias("v"), (F.min("p_size") != F.max("p_size")).alias("conflict"))


@query("boundary_cross", "SELECT DISTINCT s_nationkey AS key, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey")
def boundary_cross(spark, d):
    """Keys that both providers (suppliers, customers) have, once each."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).distinct()
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).distinct()
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    return n.join(s, "key", "left_semi").join(c, "key", "left_semi")


@query("ivl_overlap_range_join", "WITH w AS (SELECT p_brand AS b, CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi FROM part GROUP BY 1) SELECT a.b AS left_, c.b AS right_, greatest(a.lo, c.lo) AS lo, least(a.hi, c.hi) AS hi, c.lo >= a.lo AND c.hi <= a.hi AS contains FROM w a JOIN w c ON a.b < c.b AND a.lo <= c.hi AND c.lo <= a.hi")
def ivl_overlap_range_join(spark, d):
    """Overlaps of intervals: each is dealt to the fixed-width cells it touches, pairs meet in cells, and count in the first shared one."""
    w = table(spark, d, "part").groupBy(F.col("p_brand").alias("b")).agg(F.min("p_size").cast("long").alias("lo"), F.max("p_size").cast("long").alias("hi"))
    width = 16
    cells = w.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    a, c = cells.alias("a"), cells.alias("c")
    j = a.join(c, (F.col("a.cell") == F.col("c.cell")) & (F.col("a.b") < F.col("c.b")) & (F.col("a.lo") <= F.col("c.hi")) & (F.col("c.lo") <= F.col("a.hi")))
    lo = F.greatest("a.lo", "c.lo")
    j = j.where(F.floor(lo / width) == F.col("a.cell"))
    return j.select(F.col("a.b").alias("left_"), F.col("c.b").alias("right_"), lo.alias("lo"), F.least("a.hi", "c.hi").alias("hi"), ((F.col("c.lo") >= F.col("a.lo")) & (F.col("c.hi") <= F.col("a.hi"))).alias("contains"))


_DIAG = "SELECT l_orderkey AS k, CASE WHEN l_discount > 0.05 THEN 'rule-a' END AS rule, l_returnflag AS sev, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_linenumber {0} 5"


@query("diag_diff_new_fixed", f"WITH cur AS ({_DIAG.format('<')}), base AS ({_DIAG.format('<>')}), new AS (SELECT * FROM cur c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k = c.k AND b.rule IS NOT DISTINCT FROM c.rule AND b.sev = c.sev AND b.line = c.line)), fixed AS (SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE b.k = c.k AND b.rule IS NOT DISTINCT FROM c.rule AND b.sev = c.sev AND b.line = c.line)) SELECT 'new' AS status, * FROM new UNION ALL SELECT 'fixed', * FROM fixed")
def diag_diff_new_fixed(spark, d):
    from ..operators.rules import diff

    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("k"), F.when(F.col("l_discount") > 0.05, "rule-a").alias("rule"), F.col("l_returnflag").alias("sev"), F.col("l_linenumber").cast("long").alias("line"))
    return diff(rows.where("line < 5"), rows.where("line <> 5"), ["k", "rule", "sev", "line"])


@query("sig_coverage_missing", "SELECT n_name, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'covered' ELSE 'missing' END AS state FROM nation")
def sig_coverage_missing(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "nation").join(s, "n_nationkey", "left").select("n_name", F.when(F.col("hit"), "covered").otherwise("missing").alias("state"))


@query("type_drift_first_write", "WITH w AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'NilClass' ELSE event_type END AS cls, ts FROM events), k AS (SELECT *, first_value(cls) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS declared FROM w WHERE cls <> 'NilClass') SELECT user_id, event_id, cls, declared FROM k WHERE cls <> declared")
def type_drift_first_write(spark, d):
    w = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "NilClass").otherwise(F.col("event_type")).alias("cls"), "ts")
    return E.first_write_wins(w, ["user_id"], ["ts", "event_id"], "cls").select("user_id", "event_id", "cls", "declared")


@query("tier_merge", "WITH b AS (SELECT p_type AS call, CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi FROM part GROUP BY 1) SELECT call, greatest(lo, 5) AS lo, least(hi, 30) AS hi, CAST(1 AS BIGINT) AS conflicts, 'builtin' AS first FROM b")
def tier_merge(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_type").alias("call")).agg(F.min("p_size").cast("long").alias("lo"), F.max("p_size").cast("long").alias("hi"))
    one = lambda provider, plugin, idx, lo, hi: b.select("call", F.lit(provider).alias("provider"), F.lit(plugin).cast("string").alias("plugin"), F.lit(idx).alias("idx"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    c = one("builtin", None, 0, F.col("lo"), F.col("hi")).unionByName(one("plugin", "z", 0, F.lit(5), F.lit(900))).unionByName(one("contract_note", None, 1, F.lit(0), F.lit(30))).unionByName(one("other", "a", 2, F.lit(400), F.lit(500)))
    return E.merge_tiers(c)


@query("tier_cascade", "SELECT doc_id, coalesce(CASE WHEN n_chars < 100 THEN 'constant' END, CASE WHEN lang = 'de' THEN 'shape' END, CASE WHEN source = 'src3' THEN 'plugin' END, 'Object') AS tier FROM documents")
def tier_cascade(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("n_chars") < 100, "constant"), F.when(F.col("lang") == "de", "shape"), F.when(F.col("source") == "src3", "plugin"), F.lit("Object")).alias("tier"))


@query("runs_chunk_while", "WITH m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, run")
def runs_chunk_while(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    e = e.withColumn("new", F.when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return e.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("visibility_state_machine", "WITH m AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'system' THEN 'private' WHEN turn = 0 THEN 'public' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS v FROM conversations) SELECT coalesce(v, 'public') AS visibility, role, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1, 2")
def visibility_state_machine(spark, d):
    """A marker holds for what follows, until the next."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("role") == "system", "private").when(F.col("turn") == 0, "public")
    c = table(spark, d, "conversations").select("role", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit("public")).alias("visibility"))
    return c.groupBy("visibility", "role").agg(F.count("*").alias("n"))


@query("statement_environment", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, last_value(CASE WHEN l_discount > 0.05 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS binding FROM lineitem")
def statement_environment(spark, d):
    """The latest binding before or at each statement."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.last(F.when(F.col("l_discount") > 0.05, F.col("l_partkey")), ignorenulls=True).over(w).alias("binding"))


@query("case_remainder_arms", "SELECT CASE WHEN o_totalprice < 1000 THEN 'a' WHEN o_orderstatus = 'F' THEN 'b' WHEN o_orderpriority LIKE '1%' THEN 'c' ELSE 'rest' END AS arm, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def case_remainder_arms(spark, d):
    arm = F.when(F.col("o_totalprice") < 1000, "a").when(F.col("o_orderstatus") == "F", "b").when(F.col("o_orderpriority").startswith("1"), "c").otherwise("rest")
    return table(spark, d, "orders").groupBy(arm.alias("arm")).agg(F.count("*").alias("n"))


@query("sort_members", "SELECT p_type, array_to_string(list_sort(list(DISTINCT p_brand)), ' | ') AS members FROM part GROUP BY 1")
def sort_members(spark, d):
    return table(spark, d, "part").select("p_type", "p_brand").distinct().groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("p_brand")), " | ").alias("members"))


@query("contribution_order", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type, p_partkey) AS BIGINT) AS pos FROM part")
def contribution_order(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return O.positioned_within(rows, ["p_brand"], "p_size", "p_type", "p_partkey").select("p_partkey", (F.col("position") + 1).alias("pos"))


@query("overload_select", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'strict' WHEN p_size < 20 THEN 'alias' WHEN p_size < 30 THEN 'gradual' WHEN p_size < 40 THEN 'block' ELSE 'first' END AS pass, CAST(CASE WHEN p_size < 10 THEN 3 WHEN p_size < 20 THEN 2 WHEN p_size < 30 THEN 1 WHEN p_size < 40 THEN 4 ELSE 0 END AS BIGINT) AS idx FROM part")
def overload_select(spark, d):
    """Of the overloads that accept the argument, the one of the earliest pass, then the earliest declared; else the first."""
    overloads = F.broadcast(spark.createDataFrame([(0, "strict", 1, 2000, 3000), (3, "strict", 1, 0, 9), (2, "alias", 2, 0, 19), (1, "gradual", 3, 0, 29), (4, "block", 4, 0, 39)], "idx long, pass string, n int, lo int, hi int"))
    part = table(spark, d, "part").select("p_partkey", "p_size")
    hit = part.join(overloads, F.col("p_size").between(F.col("lo"), F.col("hi"))).groupBy("p_partkey").agg(F.min_by(F.struct("pass", "idx"), F.struct("n", "idx")).alias("best"))
    return part.join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("best.pass", F.lit("first")).alias("pass"), F.coalesce("best.idx", F.lit(0)).cast("long").alias("idx"))


@query("overload_affinity_order", "SELECT p_brand, array_to_string(list(p_partkey ORDER BY CASE WHEN p_type LIKE 'S%' THEN 0 ELSE 1 END, p_partkey), ',') AS ordered FROM part GROUP BY 1")
def overload_affinity_order(spark, d):
    key = F.struct(F.when(F.col("p_type").startswith("S"), 0).otherwise(1).alias("a"), F.col("p_partkey").alias("k"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["k"]), ",").alias("ordered"))


@query("event_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def event_limit(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("class_table_sort", "SELECT event_type AS cls, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def class_table_sort(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("cls")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls")


@query("input_order", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS pos FROM documents")
def input_order(spark, d):
    return O.positioned_within(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id").select("doc_id", (F.col("position") + 1).alias("pos"))


@query("completion_members", "SELECT event_type AS name, count(DISTINCT user_id % 5) = 5 AS on_every, true AS on_any FROM events GROUP BY 1")
def completion_members(spark, d):
    """A union completes to names on each of its (five) members, an intersection to names on any."""
    seen = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("c")).distinct()
    return seen.groupBy(F.col("event_type").alias("name")).agg((F.count("*") == 5).alias("on_every"), F.lit(True).alias("on_any"))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set_difference", "SELECT p_partkey FROM part WHERE p_size <> 7")
def set_difference(spark, d):
    return table(spark, d, "part").where("p_size <> 7").select("p_partkey")


@query("set_complement", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def set_complement(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").select("s_nationkey"))


@query("set_erasure_untyped", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'untyped' ELSE array_to_string(list_sort(list(DISTINCT event_type)), ' | ') END AS erased FROM events GROUP BY 1")
def set_erasure_untyped(spark, d):
    seen = table(spark, d, "events").select("user_id", "event_type").distinct()
    return seen.groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "error"), "untyped").otherwise(F.array_join(F.array_sort(F.collect_list("event_type")), " | ")).alias("erased"))


@query("set_keys_in_order", "SELECT doc_id, array_to_string(list_filter(w, lambda x: list_contains(['the', 'of', 'der', 'la'], x)), ',') AS kept, CAST(len(list_filter(w, lambda x: NOT list_contains(['the', 'of', 'der', 'la'], x))) AS BIGINT) AS dropped FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def set_keys_in_order(spark, d):
    w, keys = F.split("text", " "), F.array(*map(F.lit, ("the", "of", "der", "la")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.filter(w, lambda x: F.array_contains(keys, x)), ",").alias("kept"), F.size(F.filter(w, lambda x: ~F.array_contains(keys, x))).cast("long").alias("dropped"))
