"""Class hierarchies by intervals: each class has a number and the numbers of all below it are one range (nested sets).

Labels are made once, in rounds of joins from the roots down; after that any question about two classes is a comparison of ranges
on rows joined by name: no closure, no pairs of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .accept import MAYBE, NO, YES
from .graph import CycleError, kept
from .ordering import positioned


def labelled(edges: DataFrame) -> DataFrame:
    """cls, depth, path (from the root to itself), lo (its number), hi (the last number below it) of all classes in edges (child, parent).

    A null parent says that a child is a root; so is a class that is no child. Repeated edges count once. A class with two parents
    raises ValueError (graph.closure takes such hierarchies), one that is its own ancestor CycleError. Siblings are in order of names.
    Runs a job for each level.
    """
    named = edges.where("child is not null").groupBy("child").agg(F.min("parent").alias("parent"), F.max("parent").alias("last"))
    if two := named.where("parent <> last").first():
        raise ValueError(f"{two['child']} has more than one parent")
    every = edges.select(F.explode(F.array("child", "parent")).alias("cls")).where("cls is not null").distinct()
    nodes = kept(every.join(named, F.col("cls") == F.col("child"), "left").select("cls", "parent"))
    level = kept(nodes.where("parent is null").select("cls", F.array("cls").alias("path")))
    found = level
    while True:
        above = level.select(F.col("cls").alias("above"), F.col("path").alias("way"))
        level = kept(nodes.join(above, F.col("parent") == F.col("above")).select("cls", F.concat("way", F.array("cls")).alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    found = kept(found)
    if lost := nodes.join(found, "cls", "left_anti").first():
        raise CycleError(f"{lost['cls']} has no root")
    sizes = found.select(F.explode("path").alias("of")).groupBy("of").agg(F.count("*").alias("size"))  # partial sums first: a root costs no more than others
    numbered = positioned(found, "path", name="lo").join(sizes, F.col("cls") == F.col("of"))
    return kept(numbered.select("cls", (F.size("path") - 1).cast("long").alias("depth"), "path", "lo", (F.col("lo") + F.col("size") - 1).alias("hi")))


def related(pairs: DataFrame, labels: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """pairs with relation of x to y: equal, subclass, superclass, disjoint, or unknown where a name is null or not in the hierarchy.

    Equal names are equal even if unknown. Two joins by name, whatever the depth.
    """
    of_x = labels.select(F.col("cls").alias("__x"), F.col("lo").alias("__xlo"), F.col("hi").alias("__xhi"))
    of_y = labels.select(F.col("cls").alias("__y"), F.col("lo").alias("__ylo"), F.col("hi").alias("__yhi"))
    out = pairs.join(of_x, F.col(x) == F.col("__x"), "left").join(of_y, F.col(y) == F.col("__y"), "left")
    relation = (
        F.when(F.col(x) == F.col(y), "equal").when(F.col("__xlo").isNull() | F.col("__ylo").isNull(), "unknown")
        .when(F.col("__xlo").between(F.col("__ylo"), F.col("__yhi")), "subclass").when(F.col("__ylo").between(F.col("__xlo"), F.col("__xhi")), "superclass").otherwise("disjoint")
    )
    return out.withColumn("relation", relation).drop("__x", "__xlo", "__xhi", "__y", "__ylo", "__yhi")


def narrowed(relation: Column, cls: Column, target: Column, *, exact: bool = False, holds: bool = True) -> Column:
    """What is left of cls where a class test against target holds (or not), null for nothing. exact: the class itself, no subclass."""
    same = relation == "equal"
    if exact:
        return F.when(same if holds else ~same, cls)
    if not holds:
        return F.when(~relation.isin("equal", "subclass"), cls)
    return F.when(relation == "superclass", target).when(relation != "disjoint", cls)


def accepts(relation: Column) -> Column:
    """Does a declared class (y) take an instance of the given one (x)? Yes for itself and subclasses, maybe where one is unknown."""
    return F.when(relation.isin("equal", "subclass"), YES).when(relation == "unknown", MAYBE).otherwise(NO)


def looked_up(asked: DataFrame, owned: DataFrame, labels: DataFrame) -> DataFrame:
    """asked (cls, name, kind) with owner: the nearest class on the way up that owns (owner, name, kind) the member, null for none.

    Each question goes to as many classes as its own is deep; a member that all classes have costs no more than others.
    """
    way = asked.distinct().join(labels.select(F.col("cls").alias("__c"), "path"), F.col("cls") == F.col("__c")).select("cls", "name", "kind", F.posexplode("path").alias("__depth", "__on"))
    has = owned.select(F.col("owner").alias("__on"), "name", "kind").distinct()
    best = way.join(has, ["__on", "name", "kind"]).groupBy("cls", "name", "kind").agg(F.max_by("__on", "__depth").alias("owner"))
    return asked.join(best, ["cls", "name", "kind"], "left")
