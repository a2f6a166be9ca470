"""Queries of sources, sinks and configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..registry import query, table
from ..sources import files as S

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("src_exclude_globs", r"SELECT page_id, p AS path, regexp_matches(p, '\A(?:.*/)?en/[^/]*\z') OR regexp_matches(p, '\A[^/]*/de/.*\z') AS excluded FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages)")
def src_exclude_globs(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", path.alias("path"), S.excluded(path, ["**/en/*", "*/de/**"]).alias("excluded"))


@query("src_parse_errors", "SELECT event_id % 10 = 0 AS bad, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def src_parse_errors(spark, d):
    """Every tenth record is cut off: it becomes a diagnostic, the others are parsed."""
    lines = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("line"))
    good, errors = S.parse_records(lines, "line", "k long")
    return good.agg(F.lit(False).alias("bad"), F.count("k").alias("n")).unionByName(errors.agg(F.lit(True).alias("bad"), F.count("*").alias("n")))


@query("src_discover_classes", "SELECT DISTINCT event_type AS cls FROM events UNION SELECT DISTINCT role FROM conversations")
def src_discover_classes(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("cls")).union(table(spark, d, "conversations").select("role")).distinct()


@query("src_list_files", "SELECT name || '.parquet' AS name, true AS has_bytes FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") t(name)")
def src_list_files(spark, d):
    """Every table once, however many files it has."""
    return S.list_tables(spark, d).select("name", (F.col("length") > 0).alias("has_bytes"))


@query("src_baseline", "SELECT 'customer.parquet' AS path, c_custkey AS line, CASE WHEN c_custkey % 3 <> 0 THEN 'negative-balance' END AS rule FROM customer WHERE c_acctbal < 0")
def src_baseline(spark, d):
    """Diagnostics stored as JSON files of at most 100 customers each, every second one an object, and read again."""
    at, k = shared_folder(spark, "baseline"), F.col("c_custkey")
    item = F.struct(F.lit("customer.parquet").alias("path"), k.alias("line"), F.when(k % 3 != 0, "negative-balance").alias("rule"))
    below = table(spark, d, "customer").where("c_acctbal < 0").withColumn("file", F.floor(k / 100))
    below = below.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")  # a number given stays: few bytes, but many files to write
    files = below.groupBy("file").agg(F.collect_list(item).alias("all"))
    payload = F.when(F.col("file") % 2 == 0, F.to_json("all")).otherwise(F.to_json(F.struct(F.col("all").alias("diagnostics"))))
    files.select(payload.alias("value")).write.option("maxRecordsPerFile", 1).text(at)  # in one folder: a folder a file takes the driver's time, one by one
    return S.read_baselines(spark, at).select("path", "line", "rule")


@query("src_config_includes", """
WITH c AS (SELECT 'customer/' || c_custkey AS name, c_acctbal < 0 AS off, n_nationkey AS n, n_name, r_regionkey AS r, length(c_mktsegment) AS seg, c_mktsegment AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT name, 'target' AS key, n_name AS value, 'nation/' || n AS origin FROM c UNION ALL SELECT name, 'severity', 'error', 'segment/' || s FROM c
UNION ALL SELECT name, 'limits', 'none', name FROM c WHERE off UNION ALL SELECT name, 'limits.rows', CAST(seg AS VARCHAR), 'segment/' || s FROM c WHERE NOT off
UNION ALL SELECT name, 'limits.bytes', CAST(n AS VARCHAR), 'nation/' || n FROM c WHERE NOT off""")
def src_config_includes(spark, d):
    """A configuration for each customer includes its nation's, which includes the region's, and then its segment's; some replace a mapping by a scalar."""
    from ..operators.settings import effective

    t = lambda name: table(spark, d, name)
    named = lambda kind, c: F.concat(F.lit(kind + "/"), F.col(c).cast("string"))
    one = lambda df, name, key, value: df.select(name.alias("name"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    region, nation, segment, customer = named("region", "r_regionkey"), named("nation", "n_nationkey"), named("segment", "c_mktsegment"), named("customer", "c_custkey")
    segments = t("customer").select("c_mktsegment").distinct()
    settings = [
        one(t("region"), region, "target", F.col("r_name")), one(t("region"), region, "limits.rows", F.col("r_regionkey")), one(t("nation"), nation, "target", F.col("n_name")), one(t("nation"), nation, "limits.bytes", F.col("n_nationkey")),
        one(segments, segment, "severity", F.lit("error")), one(segments, segment, "limits.rows", F.length("c_mktsegment")), one(t("customer").where("c_acctbal < 0"), customer, "limits", F.lit("none")),
    ]
    link = lambda df, name, base, at: df.select(name.alias("name"), base.alias("base"), F.lit(at).alias("position"))
    includes = [link(t("nation"), nation, named("region", "n_regionkey"), 0), link(t("customer"), customer, named("nation", "c_nationkey"), 0), link(t("customer"), customer, segment, 1)]
    return effective(reduce(DataFrame.unionByName, settings), reduce(DataFrame.unionByName, includes)).where(F.col("name").startswith("customer/"))


@query("src_read_policy", r"SELECT page_id, regexp_matches(url, '^https://([^/:?#@]+\.)?example\.net([/?#]|$)') AS may_open, page_id % 4 IN (1, 2) AS may_read FROM pages")
def src_read_policy(spark, d):
    """Pages' addresses under allowed hosts, and paths that leave the allowed folder by .., or only begin like it."""
    p, k = S.Policy(["/data"], ["example.net"]), F.col("page_id").cast("string")
    n = F.col("page_id") % 4
    path = F.when(n == 0, F.concat(F.lit("/data/pages/../../etc/"), k)).when(n == 1, F.concat(F.lit("/data/../data/pages/"), k)).when(n == 2, F.concat(F.lit("/data//./pages/"), k)).otherwise(F.concat(F.lit("/database/"), k))
    return table(spark, d, "pages").select("page_id", p.opens(F.col("url"), subdomains=True).alias("may_open"), p.reads(path).alias("may_read"))


@query("src_lockfile", "SELECT p_partkey, unnest([{'kind': 'specs', 'name': a, 'version': p_size || '.' || p_partkey}, {'kind': 'specs', 'name': b, 'version': p_size || '.0'}, {'kind': 'collection', 'name': b, 'version': p_size || '.1'}], recursive := true) FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)")
def src_lockfile(spark, d):
    """A lockfile of either form for each part: its name's two words with versions."""
    a, b, size, key = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size"), F.col("p_partkey")
    specs = F.format_string("GEM\n  remote: https://x/\n  specs:\n    %s (%d.%d)\n      other (>= 1)\n    %s (%d.0)\n\nPLATFORMS\n  any\n", a, size, key, b, size)
    collection = F.format_string("path: .collection\ngems:\n- name: %s\n  version: \"%d.1\"\n  source:\n    type: git\n", b, size)
    df = table(spark, d, "part").select("p_partkey", F.inline(F.array(F.struct(F.lit("specs").alias("kind"), specs.alias("text")), F.struct(F.lit("collection").alias("kind"), collection.alias("text")))))
    return df.select("p_partkey", "kind", F.inline(S.locked(F.col("text"))))


@query("src_analyse_files")
def src_analyse_files(spark, d):
    """Per-file analysis whose failures are rows: files under 3 kB 'fail'."""
    def analyse(path, content):
        if len(content) < 3000:
            raise ValueError(path)
        yield 1, f"{content[:4].decode('latin-1')}"

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*n.parquet").load(d)
    return S.analyse_files(files, analyse).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "line", "message")


@query("sink_diagnostics", "SELECT c_custkey AS line, 'customer.parquet' AS path, 'warning' AS severity, 'negative balance' AS message FROM customer WHERE c_acctbal < 0")
def sink_diagnostics(spark, d):
    """Written as JSON lines and read again."""
    at = shared_folder(spark, "files")
    df = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("line"), F.lit("customer.parquet").alias("path"), F.lit("warning").alias("severity"), F.lit("negative balance").alias("message"))
    S.write_diagnostics(df, f"{at}/json")
    return spark.read.schema(df.schema).json(f"{at}/json")


@query("sink_contracts", "SELECT p_type AS member, CASE WHEN p_type LIKE 'S%' THEN 'int<1, 50>' ELSE 'untyped' END AS type, CASE WHEN p_type LIKE 'S%' THEN 'inserted' ELSE 'kept' END AS action FROM (SELECT DISTINCT p_type FROM part)")
def sink_contracts(spark, d):
    at = shared_folder(spark, "files")
    t = F.col("member")
    names = table(spark, d, "part").select(F.col("p_type").alias("member")).distinct()
    old = names.where(~t.startswith("S")).withColumn("type", F.lit("untyped"))
    new = names.where(t.startswith("S")).select("member", F.lit("int<1, 50>").alias("type"), F.lit("tighter_return").alias("kind"))
    return S.write_contracts(old, new, "member", f"{at}/sig/part", f"{at}/sig")
