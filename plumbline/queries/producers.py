"""Queries of stored results and of work on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..registry import query, table
from ..sources import paths as A
from ..sources import producers as P


@query("producer_cache", "WITH r AS (SELECT 'by_lang' AS producer, lang AS value, count(*) AS n, 2 AS hits FROM documents GROUP BY lang UNION ALL SELECT 'by_source', source, count(*), 1 FROM documents GROUP BY source) SELECT producer, value, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, CAST(1 AS BIGINT) AS misses, CAST(1 AS BIGINT) AS writes, CAST(1 AS BIGINT) AS entries FROM r")
def producer_cache(spark, d):
    """Counts of documents, fetched three times and twice, computed and stored once each."""
    cache = P.Cache(spark, shared_folder(spark, "producers"))
    docs = table(spark, d, "documents")
    inputs = P.described(spark, f"{d}/documents.parquet")
    out = None
    for column, times in (("lang", 3), ("source", 2)):
        for _ in range(times):
            rows = cache.fetch(f"by_{column}", inputs, lambda c=column: docs.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")))
        rows = rows.withColumn("producer", F.lit(f"by_{column}"))
        out = rows if out is None else out.unionByName(rows)
    return out.join(cache.stats(), "producer").join(cache.inventory().select("producer", "entries"), "producer")


@query("descriptor_files", "WITH p AS (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS path, 1 + page_id % 3 AS rank, CAST(page_id % 7 AS VARCHAR) AS value FROM pages), m AS (SELECT *, max(rank) OVER (PARTITION BY path) AS strict FROM p) SELECT path, CASE strict WHEN 1 THEN 'exists' WHEN 2 THEN 'mtime' ELSE 'digest' END AS comparator, min(value) AS value, count(DISTINCT value) > 1 AS conflict FROM m WHERE rank = strict GROUP BY path, strict")
def descriptor_files(spark, d):
    """Pages as entries of their address: the strictest comparator wins, and only its values can disagree."""
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", "")
    kind = F.get(F.array(*map(F.lit, P.COMPARATORS)), (F.col("page_id") % 3).cast("int"))
    return P.composed(table(spark, d, "pages").select(path.alias("path"), kind.alias("comparator"), (F.col("page_id") % 7).cast("string").alias("value")))


_READ = ("customer", "documents", "lineitem", "orders", "pages")


@query("src_footers", " UNION ALL ".join(f"SELECT '{t}' AS name, CAST(count(*) AS BIGINT) AS line, 'rows' AS message FROM {t}" for t in _READ) + " UNION ALL SELECT 'absent', NULL, 'path.missing'")
def src_footers(spark, d):
    """Rows that the footers of some tables' files promise, and a diagnostic for one that isn't there."""
    found, errors = A.footers(spark, [f"{d}/{t}.parquet" for t in (*_READ, "absent")])
    name = F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]*)?$", 1).alias("name")
    rows = found.groupBy(name, "message").agg(F.sum("line").alias("line"))
    return rows.unionByName(errors.select(name, F.col("rule").alias("message"), F.lit(None).cast("long").alias("line")))
