"""Signatures of several providers as one table: precedence, lookup up a hierarchy, arity over overloads, types of parameters.

A signature row is an overload of a member: cls, member, kind, and what it takes (see eligible()). Rows without a cls, member or kind
declare nothing and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hierarchy import looked_up

KEY = ["cls", "member", "kind"]
UNTYPED = "untyped"


def layered(*providers: DataFrame) -> DataFrame:
    """Signatures with layer (0: the first provider): of each member those of the first provider that declares it; repeats count once."""
    tagged = [p.withColumn("layer", F.lit(k)) for k, p in enumerate(providers)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).dropna(subset=KEY).distinct()
    first = rows.groupBy(*KEY).agg(F.min("layer").alias("layer"))
    return rows.join(first, [*KEY, "layer"])


def eligible() -> Column:
    """Whether plain arguments say all about an overload: none untyped, with keywords that must be given, or with arguments after the rest.

    Columns: untyped, required_keywords, trailing; a null counts as none.
    """
    return ~F.coalesce("untyped", F.lit(False)) & (F.coalesce("required_keywords", F.lit(0)) == 0) & (F.coalesce("trailing", F.lit(0)) == 0)


def envelope(signatures: DataFrame, *key: str) -> DataFrame:
    """key, overloads, void, least, most: the fewest and most plain arguments that any overload takes (most null: no limit).

    One overload that isn't eligible() voids the whole envelope: least and most are null then. Columns beside eligible()'s: required,
    optional (numbers), rest (whether any more may follow). Sums of parts are combined before they are shuffled.
    """
    void, rest = F.bool_or(~eligible()), F.bool_or(F.coalesce("rest", F.lit(False)))
    need, may = F.coalesce("required", F.lit(0)).cast("long"), F.coalesce("optional", F.lit(0)).cast("long")
    return signatures.groupBy(*key).agg(F.count("*").alias("overloads"), void.alias("void"), F.when(~void, F.min(need)).alias("least"), F.when(~void & ~rest, F.max(need + may)).alias("most"))


def owners(asked: DataFrame, signatures: DataFrame, labels: DataFrame) -> DataFrame:
    """Each distinct (cls, member, kind) asked for with owner: the nearest class upwards that declares it, null for none. labels: hierarchy.labelled()."""
    owned = signatures.select(F.col("cls").alias("owner"), F.col("member").alias("name"), "kind")
    found = looked_up(asked.select("cls", F.col("member").alias("name"), "kind").dropna().distinct(), owned, labels)
    return found.withColumnRenamed("name", "member")


def wrong_arity(calls: DataFrame, signatures: DataFrame, labels: DataFrame) -> DataFrame:
    """calls (cls, member, kind, given, plain) that no overload takes, with owner, least, most, rule and message.

    Nothing is said of calls that aren't plain (a null: not plain), of members nobody declares, or of void envelopes.
    """
    taken = envelope(signatures, *KEY).where("not void").select(F.col("cls").alias("owner"), "member", "kind", "least", "most")
    known = owners(calls, signatures, labels).join(taken, ["owner", "member", "kind"])
    out = calls.where("plain").join(known, KEY)
    out = out.where((F.col("given") < F.col("least")) | F.coalesce(F.col("given") > F.col("most"), F.lit(False)))
    limit = F.concat_ws("..", F.col("least").cast("string"), F.coalesce(F.col("most").cast("string"), F.lit("")))
    return out.withColumns({"rule": F.lit("call.wrong-arity"), "message": F.format_string("given %d, expected %s", F.col("given").cast("long"), limit)})


def bound(slots: DataFrame, declared: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """slots (key, slot, position, name) with type: what the parameter is inside its method.

    slot: required, optional, trailing (matched by position), keyword (by name), rest, rest_keyword, block. declared (key, slot, position,
    name, type): of all overloads, the distinct types joined by ``|`` in order; a rest is an Array of it, a keyword rest a Hash. Nothing
    declared: untyped. overrides (key, name, type) win and are taken as they stand, the first in order where there are several.
    """
    place = F.when(F.col("slot").isin("required", "optional", "trailing"), F.col("position").cast("string")).when(F.col("slot") == "keyword", F.col("name")).otherwise("")
    types = declared.where("type is not null").select(*key, "slot", place.alias("__place"), "type").distinct()
    types = types.groupBy(*key, "slot", "__place").agg(F.array_join(F.array_sort(F.collect_list("type")), "|").alias("__declared"))
    own = overrides.where("type is not null").groupBy(*key, "name").agg(F.min("type").alias("__own"))
    out = slots.withColumn("__place", place).join(types, [*key, "slot", "__place"], "left").join(own, [*key, "name"], "left")
    plain = F.coalesce("__declared", F.lit(UNTYPED))
    whole = F.when(F.col("slot") == "rest", F.concat(F.lit("Array["), plain, F.lit("]"))).when(F.col("slot") == "rest_keyword", F.concat(F.lit("Hash[Symbol, "), plain, F.lit("]"))).otherwise(plain)
    return out.select(*slots.columns, F.coalesce("__own", whole).alias("type"))
