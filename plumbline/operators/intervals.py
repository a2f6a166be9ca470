"""Intervals of integers as pairs of Columns, null meaning unbounded, and their arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import bit_length, floor_div


@dataclass(frozen=True)
class Interval:
    lo: Column
    hi: Column

    @staticmethod
    def of(prefix: str) -> Interval:
        return Interval(F.col(f"{prefix}_lo"), F.col(f"{prefix}_hi"))

    def columns(self, prefix: str) -> list[Column]:
        return [self.lo.cast("long").alias(f"{prefix}_lo"), self.hi.cast("long").alias(f"{prefix}_hi")]


def point(value: int) -> Interval:
    return Interval(F.lit(value), F.lit(value))


def add(a: Interval, b: Interval) -> Interval:
    return Interval(a.lo + b.lo, a.hi + b.hi)


def subtract(a: Interval, b: Interval) -> Interval:
    return Interval(a.lo - b.hi, a.hi - b.lo)


def negate(a: Interval) -> Interval:
    return Interval(-a.hi, -a.lo)


def shift(a: Interval, by: int) -> Interval:
    return Interval(a.lo + by, a.hi + by)


def _sign(end: Column, missing: int) -> Column:
    return F.coalesce(F.signum(end), F.lit(missing))


def multiply(a: Interval, b: Interval) -> Interval:
    """Least and greatest of the corners; an unbounded corner is unbounded, but for zero times infinity, which is zero."""
    corners = []
    for x, x_inf in ((a.lo, -1), (a.hi, 1)):
        for y, y_inf in ((b.lo, -1), (b.hi, 1)):
            sign = _sign(x, x_inf) * _sign(y, y_inf)
            open_ = x.isNull() | y.isNull()
            value = F.when((x == 0) | (y == 0), 0).when(~open_, x * y)
            corners.append((value, open_ & (sign < 0), open_ & (sign > 0)))
    values = [c[0] for c in corners]
    low = corners[0][1] | corners[1][1] | corners[2][1] | corners[3][1]
    high = corners[0][2] | corners[1][2] | corners[2][2] | corners[3][2]
    return Interval(F.when(~F.coalesce(low, F.lit(False)), F.least(*values)), F.when(~F.coalesce(high, F.lit(False)), F.greatest(*values)))


def divide(a: Interval, b: Interval) -> tuple[Column, Interval]:
    """Whether there is a result (the divisor does not cover 0), and it; for bounded intervals."""
    ok = ~covers(b, 0)
    corners = [floor_div(x, y) for x in (a.lo, a.hi) for y in (b.lo, b.hi)]
    return ok, Interval(F.when(ok, F.least(*corners)), F.when(ok, F.greatest(*corners)))


def modulo(divisor: Interval) -> tuple[Column, Interval]:
    """Only a single divisor other than zero has a known range of remainders."""
    d = divisor.lo
    ok = F.coalesce((divisor.lo == divisor.hi) & (d != 0), F.lit(False))
    return ok, Interval(F.when(ok & (d > 0), 0).when(ok, d + 1), F.when(ok & (d > 0), d - 1).when(ok, 0))


def absolute(a: Interval) -> Interval:
    low, high = F.coalesce(a.lo >= 0, F.lit(False)), F.coalesce(a.hi <= 0, F.lit(False))
    return Interval(F.when(low, a.lo).when(high, -a.hi).otherwise(0), F.when(low, a.hi).when(high, -a.lo).when(a.lo.isNotNull() & a.hi.isNotNull(), F.greatest(F.abs(a.lo), F.abs(a.hi))))


def compare(a: Interval, op: str, b: Interval) -> Column:
    """"true", "false" or "both" (unknown)."""
    always, never = {
        "<": (a.hi < b.lo, a.lo >= b.hi), "<=": (a.hi <= b.lo, a.lo > b.hi), ">": (a.lo > b.hi, a.hi <= b.lo), ">=": (a.lo >= b.hi, a.hi < b.lo),
        "==": ((a.lo == a.hi) & (b.lo == b.hi) & (a.lo == b.lo), (a.hi < b.lo) | (a.lo > b.hi)),
    }["==" if op == "!=" else op]
    if op == "!=":
        always, never = never, always
    return F.when(F.coalesce(always, F.lit(False)), "true").when(F.coalesce(never, F.lit(False)), "false").otherwise("both")


def covers(a: Interval, value: int) -> Column:
    return F.coalesce(a.lo <= value, F.lit(True)) & F.coalesce(a.hi >= value, F.lit(True))


def parity(a: Interval, odd: bool) -> Column:
    """odd? or even?, known of single points only."""
    known = F.coalesce(a.lo == a.hi, F.lit(False))
    return F.when(known, F.when(F.pmod(a.lo, F.lit(2)) == int(odd), "true").otherwise("false")).otherwise("both")


def sign_test(a: Interval, which: str) -> Column:
    return compare(a, {"zero": "==", "positive": ">", "negative": "<"}[which], point(0))


def width(a: Interval) -> Interval:
    """bit_length."""
    both = a.lo.isNotNull() & a.hi.isNotNull()
    return Interval(F.lit(0), F.when(both, F.greatest(bit_length(a.lo), bit_length(a.hi))))


def between(a: Interval, lo: int, hi: int) -> Column:
    inside = F.coalesce((a.lo >= lo) & (a.hi <= hi), F.lit(False))
    outside = F.coalesce(a.hi < lo, F.lit(False)) | F.coalesce(a.lo > hi, F.lit(False))
    return F.when(inside, "true").when(outside, "false").otherwise("both")


def clamp(a: Interval, lo: int, hi: int) -> Interval:
    end = lambda x, missing: F.least(F.greatest(F.coalesce(x, F.lit(missing)), F.lit(lo)), F.lit(hi))
    return Interval(end(a.lo, lo), end(a.hi, hi))


def meet(a: Interval, b: Interval) -> tuple[Column, Interval]:
    """Whether they meet, and where."""
    lo = F.greatest(a.lo, b.lo)  # nulls are skipped
    hi = F.least(a.hi, b.hi)
    ok = F.coalesce(lo <= hi, F.lit(True))
    return ok, Interval(F.when(ok, lo), F.when(ok, hi))


def halves(a: Interval) -> Column:
    """The complement: an array of at most two (lo, hi) structs."""
    below = F.struct(F.lit(None).cast("long").alias("lo"), (a.lo - 1).alias("hi"))
    above = F.struct((a.hi + 1).alias("lo"), F.lit(None).cast("long").alias("hi"))
    return F.filter(F.array(F.when(a.lo.isNotNull(), below), F.when(a.hi.isNotNull(), above)), lambda x: x.isNotNull())


def contains(a: Interval, b: Interval) -> Column:
    """Whether b lies in a."""
    low = a.lo.isNull() | F.coalesce(b.lo >= a.lo, F.lit(False))
    high = a.hi.isNull() | F.coalesce(b.hi <= a.hi, F.lit(False))
    return low & high


def describe(a: Interval) -> Column:
    """Short text, with the named intervals by name."""
    lo, hi = F.coalesce(a.lo.cast("string"), F.lit("min")), F.coalesce(a.hi.cast("string"), F.lit("max"))
    return (
        F.when(a.lo.isNull() & a.hi.isNull(), "Integer").when(F.coalesce(a.lo == a.hi, F.lit(False)), lo)
        .when(F.coalesce(a.lo == 1, F.lit(False)) & a.hi.isNull(), "positive-int").when(F.coalesce(a.lo == 0, F.lit(False)) & a.hi.isNull(), "non-negative-int")
        .when(a.lo.isNull() & F.coalesce(a.hi == -1, F.lit(False)), "negative-int").when(a.lo.isNull() & F.coalesce(a.hi == 0, F.lit(False)), "non-positive-int")
        .otherwise(F.concat(F.lit("int<"), lo, F.lit(", "), hi, F.lit(">")))
    )
