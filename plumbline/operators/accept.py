"""Three-valued acceptance: does one domain admit another? Verdicts are 0 (no), 1 (maybe) and 2 (yes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import Interval, contains, meet

NO, MAYBE, YES = 0, 1, 2
WORDS = ("no", "maybe", "yes")


def verdict(c: Column) -> Column:
    return F.when(c == NO, "no").when(c == MAYBE, "maybe").when(c == YES, "yes")


def all_of(c: str | Column) -> Column:
    """Kleene's AND over a group: an aggregate."""
    return F.min(c)


def any_of(c: str | Column) -> Column:
    return F.max(c)


def negate(c: Column) -> Column:
    return F.lit(2) - c


def interval_accepts(declared: Interval, given: Interval) -> Column:
    """Yes when given lies inside; no otherwise: a value outside may come, which a declared interval rejects."""
    return F.when(contains(declared, given), YES).otherwise(NO)


def intervals_overlap(a: Interval, b: Interval) -> Column:
    return F.when(contains(a, b), YES).when(meet(a, b)[0], MAYBE).otherwise(NO)


def literals_accept(declared: Column, given: Column) -> Column:
    """Literal sets: each member of given needs one of declared; some but not all is still no."""
    return F.when(F.size(F.array_except(given, declared)) == 0, YES).otherwise(NO)


def class_accepts(declared: str, given: Column, ancestors: dict[str, tuple[str, ...]]) -> Column:
    """given: class names; a subclass is accepted, a known other class not, an unknown one maybe."""
    below = [declared, *[k for k, v in ancestors.items() if declared in v]]
    known = {declared, *ancestors, *[a for v in ancestors.values() for a in v]}
    return F.when(given.isin(below), YES).when(given.isin(sorted(known)), NO).otherwise(MAYBE)


def carriers_accept(declared: Column, given: Column, above: dict[str, tuple[str, ...]]) -> Column:
    """Verdict over columns of carriers: struct of kind ("top", "bot", "dynamic" or "nominal"), cls, args (array of class names).

    In this order: a given bot is accepted; a dynamic on either side is; equal carriers are; a declared top takes all, a declared bot
    nothing else, and a given top may or may not fit; then classes (class_accepts' verdicts). Arguments of a class that fits are compared place by place and the least
    verdict counts: a place that only one side has is a maybe, a bare declared class takes any arguments. A null is a maybe.
    """
    known = sorted({*above, *[a for v in above.values() for a in v]})
    table = F.create_map(*[x for k in known for x in (F.lit(k), F.array(*[F.lit(a) for a in (k, *above.get(k, ()))]))])

    def classes(d: Column, g: Column) -> Column:
        up = F.try_element_at(table, g)
        return F.when(d == g, YES).when(up.isNull() | F.try_element_at(table, d).isNull(), MAYBE).when(F.array_contains(up, d), YES).otherwise(NO)

    none = F.array().cast("array<string>")
    d_args, g_args = F.coalesce(declared["args"], none), F.coalesce(given["args"], none)
    places = F.zip_with(d_args, g_args, lambda d, g: F.when(d.isNull() | g.isNull(), MAYBE).otherwise(classes(d, g)))
    own = classes(declared["cls"], given["cls"])
    args = F.when((own == YES) & (F.size(d_args) > 0), F.array_min(places)).otherwise(own)
    return (
        F.when(declared.isNull() | given.isNull(), MAYBE).when(given["kind"] == "bot", YES).when((declared["kind"] == "dynamic") | (given["kind"] == "dynamic"), YES).when(declared.eqNullSafe(given), YES)
        .when(declared["kind"] == "top", YES).when(declared["kind"] == "bot", NO).when(given["kind"] == "top", MAYBE).otherwise(F.coalesce(args, F.lit(MAYBE)))
    )
