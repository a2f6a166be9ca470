"""Environments (name to domain) and their joins, fact stores, and the tiered merge of contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_bindings(a: DataFrame, b: DataFrame, name: str = "name", domain: str = "domain") -> DataFrame:
    """Names bound on both sides, with the union of the (array) domains."""
    other = b.select(F.col(name), F.col(domain).alias("__b"))
    return a.join(other, name, "inner").select(name, F.array_sort(F.array_union(domain, "__b")).alias(domain))


def join_with_nil(a: DataFrame, b: DataFrame, name: str = "name", domain: str = "domain") -> DataFrame:
    """All names; one that a side doesn't bind may be nil there."""
    nil = F.array(F.lit("nil"))
    other = b.select(F.col(name), F.col(domain).alias("__b"))
    return a.join(other, name, "full_outer").select(name, F.array_sort(F.array_union(F.coalesce(domain, nil), F.coalesce("__b", nil))).alias(domain))


def join_branches(rows: DataFrame, branches: int) -> DataFrame:
    """kind, name, domain (sorted array) where any number of branches meet; rows: branch, kind, name, value, of all of them.

    A local name that not all branches bind may be nil; others (instance variables, globals) have to be bound on all, else they are
    left out. Presence is counted per name, so neither the order of branches nor branches without names matter. branches: how many there are.
    """
    met = rows.groupBy("kind", "name").agg(F.count_distinct("branch").alias("bound"), F.collect_set("value").alias("values"))
    whole = F.col("bound") == branches
    domain = F.array_sort(F.when(whole, F.col("values")).otherwise(F.array_union("values", F.array(F.lit("nil")))))
    return met.where(whole | (F.col("kind") == "local")).select("kind", "name", domain.alias("domain"))


def common_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


#: Tiers of contributions to a call; the lowest decides first.
TIERS = {"builtin": 0, "contract_note": 1, "generated": 1, "plugin": 2}


def tier(provider: Column) -> Column:
    out: Column = F.lit(3)
    for k, v in TIERS.items():
        out = F.when(provider == k, v).otherwise(out)
    return out


def merge_tiers(c: DataFrame) -> DataFrame:
    """call, lo, hi, conflicts, first from contributions (call, provider, plugin, idx, lo, hi).

    In tier order, then by plugin, then by index: the first sets the interval, each later one is intersected with it unless
    nothing would be left; such a one is a conflict and is passed over. A fold over a call's few contributions.
    """
    rows = c.withColumn("tier", tier(F.col("provider"))).groupBy("call").agg(F.array_sort(F.collect_list(F.struct("tier", F.col("plugin").isNotNull().alias("has"), "plugin", "idx", "lo", "hi", "provider"))).alias("all"))
    start = F.struct(F.element_at("all", 1)["lo"].alias("lo"), F.element_at("all", 1)["hi"].alias("hi"), F.lit(0).cast("long").alias("conflicts"))

    def step(a: Column, x: Column) -> Column:
        lo, hi = F.greatest(a["lo"], x["lo"]), F.least(a["hi"], x["hi"])
        ok = lo <= hi
        return F.struct(F.when(ok, lo).otherwise(a["lo"]).alias("lo"), F.when(ok, hi).otherwise(a["hi"]).alias("hi"), (a["conflicts"] + F.when(ok, 0).otherwise(1)).alias("conflicts"))

    return rows.select("call", F.aggregate("all", start, step).alias("m"), F.element_at("all", 1)["provider"].alias("first")).select("call", "m.lo", "m.hi", "m.conflicts", "first")


def first_write_wins(writes: DataFrame, key: list[str], position: list[str], cls: str) -> DataFrame:
    """Writes whose class differs from that of their key's first write that isn't nil; nil writes are passed over."""
    known = writes.where(F.col(cls) != "NilClass")
    declared = F.first(cls).over(Window.partitionBy(*key).orderBy(*position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return known.withColumn("declared", declared).where(F.col(cls) != F.col("declared"))
