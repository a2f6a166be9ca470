"""Contracts: declared domains of columns, inferred ones, their comparison and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import Interval, contains


def tighter(declared: Interval, inferred: Interval) -> Column:
    """Declared admits inferred and not the other way round."""
    return contains(declared, inferred) & ~contains(inferred, declared)


def classify(inferred: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """key, verdict: "skipped" (untyped), "new", "tighter", "equivalent" or "looser", "unobserved" from (key, cls, lo, hi) on both sides."""
    d = declared.select(F.col(key), *[F.col(c).alias(f"d_{c}") for c in ("cls", "lo", "hi")])
    i = inferred.select(F.col(key), *[F.col(c).alias(f"i_{c}") for c in ("cls", "lo", "hi")])
    a, b = Interval.of("d"), Interval.of("i")
    same = contains(a, b) & contains(b, a)
    verdict = (
        F.when(F.col("i_cls").isNull(), "unobserved").when(F.col("i_cls") == "untyped", "skipped").when(F.col("d_cls").isNull(), "new")
        .when(F.col("d_cls") != F.col("i_cls"), "new").when(same, "equivalent").when(tighter(a, b), "tighter").otherwise("looser")
    )
    return i.join(d, key, "full_outer").select(key, verdict.alias("verdict"))


def merge(existing: DataFrame, generated: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """key, type, action: absent members are inserted; a tighter return replaces; a new method replaces one with strictly more ``untyped``; else nothing changes.

    generated: key, type, kind ("tighter_return", "new_method", other).
    """
    e = existing.select(key, F.col("type").alias("old"))
    g = generated.select(key, F.col("type").alias("new"), "kind")
    untyped = lambda c: F.coalesce(F.regexp_count(c, F.lit(r"\buntyped\b")), F.lit(0))
    replace = F.coalesce((F.col("kind") == "tighter_return") | ((F.col("kind") == "new_method") & (untyped(F.col("new")) < untyped(F.col("old")))), F.lit(False)) & F.lit(overwrite)
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(replace, "replaced").otherwise("kept")
    return e.join(g, key, "full_outer").select(key, F.when(action.isin("inserted", "replaced"), F.col("new")).otherwise(F.col("old")).alias("type"), action.alias("action"))


def render(existing: DataFrame, generated: DataFrame, key: str, mode: str = "print", only: tuple[str, ...] = (), overwrite: bool = True) -> DataFrame:
    """key, part, line of what merge makes of both: "print" shows members inserted or replaced, "diff" also what they replace (part 0 before part 1), "write" all lines of the new file.

    only: members to show, all if none is named; untyped members that were not there are not shown.
    """
    if mode not in ("print", "diff", "write"):
        raise ValueError(f"{mode} is none of print, diff, write")
    rows = merge(existing, generated, key, overwrite).join(existing.select(key, F.col("type").alias("old")), key, "left")
    rows = rows.where(F.col(key).isin(*only)) if only else rows
    changed = F.col("action").isin("inserted", "replaced") & (F.col("type") != "untyped")
    text = lambda c, sign="": F.concat(F.lit(sign + "def "), F.col(key), F.lit(": () -> "), F.col(c))
    one = lambda part, line: F.struct(F.lit(part).alias("part"), line.alias("line"))
    new = F.when(changed, one(1, text("type", "+ " if mode == "diff" else "")))
    if mode == "write":
        lines = F.array(one(1, text("type")))
    elif mode == "diff":
        lines = F.array(F.when(changed & F.col("old").isNotNull(), one(0, text("old", "- "))), new)
    else:
        lines = F.array(new)
    return rows.select(key, F.inline(F.filter(lines, lambda x: x.isNotNull())))


#: Collections that are not narrowed to the shape of one of their values.
COLLECTIONS = ("Array", "Hash", "Set", "Range", "Enumerable", "Enumerator", "Enumerator::Lazy")


def classify_members(observed: DataFrame, declared: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """key, verdict of each observed member: "skipped.complex-shape", "skipped.untyped-return", "new-method", "tighter-return" or "equivalent".

    observed: key, type, complex, computed (a constant that isn't written as one), a row for each member of the type; declared: key,
    type, likewise; above: child, ancestor (graph.closure, each class itself too). Tighter is a type all of whose members lie below a
    declared one and not the other way round, unless it takes away what the declaration leaves open: a member of a union, a
    collection's other sizes, a constant's other values. Types above doesn't have are below themselves alone. Repeated rows count once.
    A member with no type, or with "untyped" among its types, is untyped.
    """
    o = observed.groupBy(key).agg(
        F.bool_or(F.coalesce("complex", F.lit(False))).alias("complex"), F.bool_or(F.coalesce("computed", F.lit(False))).alias("computed"),
        F.bool_or(F.col("type").isNull() | (F.col("type") == "untyped")).alias("untyped"), F.bool_or(F.col("type").isin("Tuple", "Shape")).alias("shaped"), F.count_distinct("type").alias("n_seen"),
    ).where(F.col(key).isNotNull())
    seen = observed.select(key, F.col("type").alias("seen")).where("seen is not null").distinct()
    said = declared.select(key, F.col("type").alias("said")).where("said is not null").distinct()
    d = said.groupBy(key).agg(F.count("*").alias("n_said"), F.bool_or(F.col("said").isin(*COLLECTIONS)).alias("collection"))
    pairs = seen.join(said, key)
    up = above.select(F.col("child").alias("seen"), F.col("ancestor").alias("said")).distinct().withColumn("under", F.lit(True))
    down = up.select(F.col("seen").alias("said"), F.col("said").alias("seen"), F.col("under").alias("over"))
    same = F.col("seen") == F.col("said")
    pairs = pairs.join(up, ["seen", "said"], "left").join(down, ["seen", "said"], "left").select(key, "seen", "said", F.coalesce("under", same).alias("under"), F.coalesce("over", same).alias("over"))
    forward = pairs.where("under").groupBy(key).agg(F.count_distinct("seen").alias("n_under"))
    backward = pairs.where("over").groupBy(key).agg(F.count_distinct("said").alias("n_over"))
    rows = o.join(d, key, "left").join(forward, key, "left").join(backward, key, "left")
    kept = F.coalesce("n_over", F.lit(0)) == F.col("n_said")
    lost = ((F.col("n_said") > 1) & ~kept) | (F.col("collection") & F.coalesce("shaped", F.lit(False))) | F.col("computed")
    tight = (F.coalesce("n_under", F.lit(0)) == F.col("n_seen")) & ~kept & ~lost
    verdict = F.when(F.col("complex"), "skipped.complex-shape").when(F.col("untyped"), "skipped.untyped-return").when(F.col("n_said").isNull(), "new-method").when(tight, "tighter-return").otherwise("equivalent")
    return rows.select(key, verdict.alias("verdict"))
