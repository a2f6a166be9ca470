"""What extensions hand to each other, as tables: facts written once, needs, answers in order, members made from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """plugin, name, value of facts that stand, and path, rule, message of those published with different values.

    facts: plugin, name, value. A fact is written once, or again with an equal value; nulls are equal. Partial aggregates of
    two values a fact, however often it is published.
    """
    v = F.struct("value")
    ends = facts.groupBy("plugin", "name").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    standing = ends.where(same).select("plugin", "name", F.col("lo.value").alias("value"))
    return standing, ends.where(~same).select(F.col("plugin").alias("path"), F.lit("plugin.fact-conflict").alias("rule"), F.col("name").alias("message"))


def unmet(needs: DataFrame, facts: DataFrame) -> DataFrame:
    """path, rule, message of needs (plugin, name) that no plugin's fact serves; each once. A need without a name is none."""
    there = facts.select("name").where("name is not null").distinct()
    lost = needs.where("name is not null").select("plugin", "name").distinct().join(there, "name", "left_anti")
    return lost.select(F.col("plugin").alias("path"), F.lit("plugin.missing-producer").alias("rule"), F.col("name").alias("message"))


def first_answer(calls: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """calls with type and position: the first answer by position that isn't null (of two at one position the smaller); none: nulls.

    answers: key, position, type; every plugin's, in any order. Calls without a key get none. calls have no columns type or position.
    """
    first = answers.where(F.col(key).isNotNull() & F.col("type").isNotNull()).groupBy(key).agg(F.min(F.struct("position", "type")).alias("__first"))
    return calls.join(first, key, "left").select(*calls.columns, F.col("__first.type").alias("type"), F.col("__first.position").alias("position"))


def expand(sites: DataFrame, templates: DataFrame) -> DataFrame:
    """sites (macro, arg and others) with member: one row for each template of the macro, ``{}`` replaced by arg.

    A site of an unknown macro or without an argument makes no member; templates (macro, template) of equal text count once.
    """
    each = templates.where("macro is not null and template is not null").select("macro", "template").distinct()
    made = sites.where("arg is not null").join(each, "macro")
    return made.select(*sites.columns, F.replace("template", F.lit("{}"), F.col("arg")).alias("member"))
