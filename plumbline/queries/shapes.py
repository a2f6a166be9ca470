"""Queries about shapes of nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes as H
from ..registry import query, table


def _records(spark, d):
    """Documents as JSON records with their label, if they have one, as an object of its own."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumnRenamed("doc_id", "of")
    label = F.when(F.col("of").isNotNull(), F.struct("quality", "toxic"))
    row = F.struct(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), label.alias("label"), F.when(F.col("lang") != "en", F.array("lang", "source")).alias("tags"))
    return docs.join(labels, F.col("doc_id") == F.col("of"), "left").select("source", F.to_json(row).alias("record"))


_ROWS = "r AS (SELECT source, d.lang, l.doc_id AS labelled FROM documents d LEFT JOIN labels l USING (doc_id))"
_SHAPE = " UNION ALL ".join(
    f"SELECT source, '{path}' AS path, '{cls}' AS cls, CAST({n} AS BIGINT) AS n FROM r GROUP BY source HAVING {n} > 0"
    for path, cls, n in (("$", "Hash", "count(*)"), ("$.id", "Integer", "count(*)"), ("$.size", "Integer", "count(*)"), ("$.label", "Hash", "count(labelled)"), ("$.label.quality", "Integer", "count(labelled)"), ("$.label.toxic", "Integer", "count(labelled)"), ("$.tags", "Array", "count_if(lang <> 'en')"), ("$.tags[]", "String", "2 * count_if(lang <> 'en')"))
)


@query("record_shapes", f"WITH {_ROWS} {_SHAPE}")
def record_shapes(spark, d):
    return H.shape_of(_records(spark, d), "record", "source").withColumnRenamed("by", "source")


@query("record_contract", f"WITH {_ROWS} SELECT source, '$.label' AS path, 'missing' AS finding, CAST(count(*) - count(labelled) AS BIGINT) AS n FROM r GROUP BY source HAVING count(*) > count(labelled) UNION ALL SELECT source, '$.label.toxic', 'class', CAST(count(labelled) AS BIGINT) FROM r GROUP BY source HAVING count(labelled) > 0 UNION ALL SELECT source, '$.label.quality', 'extra', CAST(count(labelled) AS BIGINT) FROM r GROUP BY source HAVING count(labelled) > 0 UNION ALL SELECT source, '$.tags', 'extra', CAST(count_if(lang <> 'en') AS BIGINT) FROM r GROUP BY source HAVING count_if(lang <> 'en') > 0")
def record_contract(spark, d):
    """A contract that asks for labels, wants toxic to be a boolean, and is closed at both levels."""
    contract = H.Record({"$": ["Hash"], "$.id": ["Integer"], "$.size": ["Integer", "NilClass"], "$.label": ["Hash"], "$.label.toxic": ["Boolean"]})
    return H.findings(H.shape_of(_records(spark, d), "record", "source"), contract).withColumnRenamed("by", "source")
