"""Queries about classes at scale: labels of a hierarchy, relations, lookups, relational division, and branches that meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accept as A
from ..operators import division as D
from ..operators import envjoin as E
from ..operators import hierarchy as H
from ..registry import query, table


def _edges(spark, d):
    """Every customer below its nation, nations below regions, regions below World."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    up = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent"))
    up = up.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")))
    return up.unionByName(r.select(F.col("r_name").alias("child"), F.lit("World").alias("parent")))


@query("hierarchy_labels", "WITH p AS (SELECT ['World', r_name, n_name, c_name] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT ['World', r_name, n_name] FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT ['World', r_name] FROM region UNION ALL SELECT ['World']), s AS (SELECT unnest(path) AS of, count(*) AS n FROM p GROUP BY 1), l AS (SELECT path[-1] AS cls, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS lo FROM p) SELECT cls, depth, lo, CAST(lo + n - 1 AS BIGINT) AS hi FROM l JOIN s ON of = cls")
def hierarchy_labels(spark, d):
    return H.labelled(_edges(spark, d)).drop("path")


_PAIRS = "p AS (SELECT sn.n_name AS x, sn.n_regionkey AS xr, c_name, cn.n_name AS cn, cr.r_name AS cr, cn.n_regionkey AS yr, s_name FROM supplier JOIN customer ON c_custkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey), q AS (SELECT x, c_name AS y, CASE WHEN x = cn THEN 'superclass' ELSE 'disjoint' END AS relation FROM p UNION SELECT x, cn, CASE WHEN x = cn THEN 'equal' ELSE 'disjoint' END FROM p UNION SELECT x, cr, CASE WHEN xr = yr THEN 'subclass' ELSE 'disjoint' END FROM p UNION SELECT x, s_name, 'unknown' FROM p)"


def _related(spark, d):
    """Nations of suppliers against the customer of the same number, its nation and region, and the supplier itself, who is in no hierarchy."""
    s, c, n, r = (table(spark, d, t) for t in ("supplier", "customer", "nation", "region"))
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("x"))
    cn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    rows = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).join(sn, "s_nationkey").join(cn, "c_nationkey")
    asked = rows.select("x", F.explode(F.array("c_name", "n_name", "r_name", "s_name")).alias("y")).distinct()
    return H.related(asked, H.labelled(_edges(spark, d)))


@query("class_relations", f"WITH {_PAIRS} SELECT x, y, relation FROM q")
def class_relations(spark, d):
    """All five verdicts."""
    return _related(spark, d)


@query("narrow_classes", f"WITH {_PAIRS} SELECT x, y, CASE relation WHEN 'superclass' THEN y WHEN 'disjoint' THEN NULL ELSE x END AS is_a, CASE WHEN relation NOT IN ('equal', 'subclass') THEN x END AS is_no, CASE WHEN relation = 'equal' THEN x END AS instance_of, CASE WHEN relation <> 'equal' THEN x END AS no_instance_of FROM q")
def narrow_classes(spark, d):
    """What a class test and an exact one leave of x where they hold, and where not."""
    r, x, y = F.col("relation"), F.col("x"), F.col("y")
    return _related(spark, d).select("x", "y", H.narrowed(r, x, y).alias("is_a"), H.narrowed(r, x, y, holds=False).alias("is_no"), H.narrowed(r, x, y, exact=True).alias("instance_of"), H.narrowed(r, x, y, exact=True, holds=False).alias("no_instance_of"))


@query("accept_hierarchy", "WITH g AS (SELECT r_name AS declared, c_name AS given, CASE WHEN cn.n_regionkey = sn.n_regionkey THEN 'yes' ELSE 'no' END AS verdict FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region ON sn.n_regionkey = r_regionkey UNION ALL SELECT r_name, s_name, 'maybe' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT declared, verdict, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT given) AS BIGINT) AS classes FROM g GROUP BY 1, 2")
def accept_hierarchy(spark, d):
    """Regions of suppliers as declared classes, the customers they deliver to (and the suppliers, who are unknown) as given ones."""
    li, o, c, s, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    s = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", F.col("r_name").alias("declared"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    rows = li.select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    given = rows.select("declared", F.explode(F.array("c_name", "s_name")).alias("given")).groupBy("declared", "given").agg(F.count("*").alias("n"))
    out = H.related(given, H.labelled(_edges(spark, d)), "given", "declared")
    return out.groupBy("declared", A.verdict(H.accepts(F.col("relation"))).alias("verdict")).agg(F.sum("n").alias("n"), F.count("*").alias("classes"))


@query("lookup_members", "WITH w AS (SELECT c_name AS cls, unnest([{'d': 3, 'on_': c_name}, {'d': 2, 'on_': n_name}, {'d': 1, 'on_': r_name}, {'d': 0, 'on_': 'World'}], recursive := true) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), a AS (SELECT DISTINCT c_name AS cls, o_orderpriority AS name, o_orderstatus AS kind FROM orders JOIN customer ON o_custkey = c_custkey), o AS (SELECT DISTINCT n_name AS on_, o_orderpriority AS name, o_orderstatus AS kind FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 400000 UNION SELECT DISTINCT r_name, o_orderpriority, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 450000) SELECT a.cls, a.name, a.kind, arg_max(o.on_, w.d) AS owner FROM a LEFT JOIN w ON w.cls = a.cls LEFT JOIN o ON o.on_ = w.on_ AND o.name = a.name AND o.kind = a.kind GROUP BY 1, 2, 3")
def lookup_members(spark, d):
    """(class, name, kind) to the nearest class that owns it: nations own what a large order had, regions what a larger one had."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("c_name", "n_name", "r_name", F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("kind"), "o_totalprice")
    owned = rows.where("o_totalprice > 400000").select(F.col("n_name").alias("owner"), "name", "kind").unionByName(rows.where("o_totalprice > 450000").select(F.col("r_name").alias("owner"), "name", "kind"))
    return H.looked_up(rows.select(F.col("c_name").alias("cls"), "name", "kind").distinct(), owned, H.labelled(_edges(spark, d)))


_CALLS = "m AS (SELECT DISTINCT user_id AS receiver, event_type AS cls FROM events), g AS (SELECT DISTINCT event_type AS cls, hour(ts) AS name FROM events WHERE value > 250)"


def _calls(spark, d):
    """Users are unions of the classes of their events; a class answers to the hours in which it had a large value."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("receiver"), F.col("event_type").alias("cls")), e.where("value > 250").select(F.col("event_type").alias("cls"), F.hour("ts").cast("long").alias("name"))


@query("complete_members", f"WITH {_CALLS}, t AS (SELECT receiver, count(*) AS members FROM m GROUP BY 1) SELECT receiver, name, count(*) AS matched, any_value(members) AS members, count(*) = any_value(members) AS on_every FROM m JOIN g USING (cls) JOIN t USING (receiver) GROUP BY 1, 2")
def complete_members(spark, d):
    """Names on every class of a union, and those on any (all rows), from one division."""
    return D.divided(*_calls(spark, d))


_HOURS = _CALLS.replace("hour(ts) AS name", "day(ts) * 24 + hour(ts) AS name").replace("value > 250", "value > 100")


@query("nil_receivers", f"WITH {_HOURS}, n AS (SELECT receiver FROM m WHERE cls = 'error'), t AS (SELECT receiver, count(*) AS members FROM m WHERE cls <> 'error' GROUP BY 1), j AS (SELECT receiver, name FROM m JOIN g USING (cls) JOIN t USING (receiver) WHERE cls <> 'error' GROUP BY receiver, name HAVING count(*) = any_value(members)) SELECT receiver, name FROM j WHERE receiver IN (SELECT receiver FROM n) AND name NOT IN (SELECT name FROM g WHERE cls = 'error')")
def nil_receivers(spark, d):
    """Errors as nil: calls (hours of the month) that all other classes of a user answer and nil does not."""
    e = table(spark, d, "events")
    members = e.select(F.col("user_id").alias("receiver"), F.col("event_type").alias("cls"))
    registry = e.where("value > 100").select(F.col("event_type").alias("cls"), (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("long").alias("name"))
    nil = lambda df: df.withColumn("cls", F.when(F.col("cls") != "error", F.col("cls")))
    return D.nil_receivers(nil(members), nil(registry))


@query("env_branches", "WITH r AS (SELECT o_orderstatus AS branch, CASE WHEN o_orderpriority LIKE '1%' THEN 'ivar' ELSE 'local' END AS kind, o_orderpriority || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '-' || o_orderstatus END AS name, CAST(o_custkey % 5 AS VARCHAR) AS value FROM orders), m AS (SELECT kind, name, count(DISTINCT branch) = (SELECT count(DISTINCT o_orderstatus) FROM orders) AS whole, list(DISTINCT value) AS v FROM r GROUP BY 1, 2) SELECT kind, name, array_to_string(list_sort(CASE WHEN whole THEN v ELSE list_append(v, 'nil') END), '|') AS domain FROM m WHERE whole OR kind = 'local'")
def env_branches(spark, d):
    """The branches of a case (order statuses) where they meet."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "ivar").otherwise("local")
    name = F.concat("o_orderpriority", F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("-"), "o_orderstatus")))
    rows = o.select(F.col("o_orderstatus").alias("branch"), kind.alias("kind"), name.alias("name"), (F.col("o_custkey") % 5).cast("string").alias("value"))
    branches = o.agg(F.count_distinct("o_orderstatus")).first()[0]
    return E.join_branches(rows, branches).withColumn("domain", F.array_join("domain", "|"))
