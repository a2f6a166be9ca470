"""Queries of extensions: their order, facts, answers and templates; and of text whose source is tracked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import provenance as P
from ..operators import extensions as E
from ..operators import graph as G
from ..registry import query, table


@query("plugin_order", "SELECT p_partkey AS name, CASE WHEN p_partkey = 0 THEN 0 ELSE length(to_base(p_partkey, 8)) END AS level FROM part")
def plugin_order(spark, d):
    """Parts need those of an eighth and a sixteenth of their number: producers come before consumers."""
    k = F.col("p_partkey")
    parts = table(spark, d, "part").where("p_partkey > 0")
    needs = parts.select(k.alias("consumer"), F.explode(F.array(F.floor(k / 8), F.floor(k / 16))).alias("producer"))
    return G.levels(table(spark, d, "part").select(k.alias("name")), needs).withColumn("level", F.col("level").cast("long"))


_FACTS = "(SELECT p_brand AS plugin, p_type AS name, CASE WHEN p_type = 'PROMO' THEN p_size ELSE length(p_brand) END AS value FROM part)"


@query("plugin_registry", f"""
WITH g AS (SELECT plugin, name, min(value) AS lo, max(value) AS hi FROM {_FACTS} GROUP BY 1, 2)
SELECT 'fact' AS state, plugin, name, CAST(lo AS BIGINT) AS value FROM g WHERE lo = hi
UNION ALL SELECT 'plugin.fact-conflict', plugin, name, NULL FROM g WHERE lo <> hi
UNION ALL SELECT DISTINCT 'plugin.missing-producer', p_brand, w, NULL FROM (SELECT p_brand, upper(split_part(p_name, ' ', 1)) AS w FROM part) WHERE w NOT IN (SELECT name FROM g WHERE lo = hi)""")
def plugin_registry(spark, d):
    """Brands publish a fact for each type, PROMO with several values; each needs facts named as its parts' first words."""
    part = table(spark, d, "part")
    value = F.when(F.col("p_type") == "PROMO", F.col("p_size")).otherwise(F.length("p_brand")).cast("long")
    standing, conflicts = E.publish(part.select(F.col("p_brand").alias("plugin"), F.col("p_type").alias("name"), value.alias("value")))
    needs = part.select(F.col("p_brand").alias("plugin"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"))
    errors = conflicts.unionByName(E.unmet(needs, standing))
    rows = errors.select(F.col("rule").alias("state"), F.col("path").alias("plugin"), F.col("message").alias("name"), F.lit(None).cast("long").alias("value"))
    return standing.select(F.lit("fact").alias("state"), "plugin", "name", "value").unionByName(rows)


@query("plugin_answers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'int<0, 5>' WHEN o_orderkey % 2 = 0 THEN 'Integer' WHEN o_orderkey % 5 <> 0 THEN 'Numeric' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_orderkey % 5 <> 0 THEN 2 END AS position FROM orders")
def plugin_answers(spark, d):
    """Three plugins' answers to a call for each order; the first in their order counts, whatever the order they come in."""
    k, orders = F.col("o_orderkey"), table(spark, d, "orders")
    one = lambda at, given, name: orders.select("o_orderkey", F.lit(at).alias("position"), F.when(given, name).alias("type"))
    answers = one(2, k % 5 != 0, "Numeric").unionByName(one(0, k % 3 == 0, "int<0, 5>")).unionByName(one(1, k % 2 == 0, "Integer"))
    return E.first_answer(orders.select("o_orderkey"), answers, "o_orderkey")


@query("macro_expand", "SELECT p_partkey, p_brand || s AS member FROM part JOIN (VALUES ('PROMO', ''), ('PROMO', '='), ('ECONOMY', '?')) t(macro, s) ON macro = p_type")
def macro_expand(spark, d):
    """Types are macros, two of which are known: one makes a reader and a writer, the other a predicate."""
    templates = spark.createDataFrame([("PROMO", "{}"), ("PROMO", "{}="), ("ECONOMY", "{}?"), ("ECONOMY", "{}?"), ("UNUSED", "x")], "macro string, template string")
    sites = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("macro"), F.col("p_brand").alias("arg"))
    return E.expand(sites, templates).select("p_partkey", "member")


@query("literal_text", """
WITH t AS (SELECT p_partkey, p_type, p_name, p_type IN ('PROMO', 'SMALL') AS known, p_size FROM part)
SELECT p_partkey, 'a-' || p_type AS concat, known AS concat_literal, p_type || p_name AS mixed, false AS mixed_literal,
       CASE WHEN p_size > 20 THEN repeat('ab', p_size - 20) END AS repeated, p_size > 20 AS repeated_literal, p_type || ',x' AS joined, known AS joined_literal, repeat('*', greatest(9 - length(p_type), 0)) || p_type AS padded, known AS padded_literal,
       '<' || p_type || ':3>' AS formatted, known AS formatted_literal, p_type AS stripped, known AS stripped_literal, lower(p_type) AS lowered, false AS lowered_literal FROM t""")
def literal_text(spark, d):
    """Types that two declared literals stand for keep the flag through operations that make text of text, others lose it."""
    kind = P.Text(F.col("p_type"), F.col("p_type").isin("PROMO", "SMALL"))
    n = F.when(F.col("p_size") > 20, F.col("p_size") - 20).otherwise(F.lit(-1))
    out = {
        "concat": P.literal("a-") + kind, "mixed": kind + P.unknown(F.col("p_name")), "repeated": P.literal("ab").repeated(n), "joined": P.joined([kind, "x"], ","), "padded": kind.padded(9, "*", "right"),
        "formatted": P.formatted("<%s:%d>", kind, 3), "stripped": P.interpolated(" ", kind, " ").stripped(), "lowered": kind.other(F.lower("p_type")),
    }
    return table(spark, d, "part").select("p_partkey", *[c for k, t in out.items() for c in (t.value.alias(k), t.flag.alias(f"{k}_literal"))])
