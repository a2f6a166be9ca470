"""Integer and float functions with floor semantics: quotients round down, remainders take the divisor's sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """Null for a zero divisor, where the operation always raises."""
    q = F.when(b != 0, F.call_function("div", a.cast("long"), F.when(b != 0, b).cast("long")))
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), q - 1).otherwise(q)


def floor_mod(a: Column, b: Column) -> Column:
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r).cast("long")


def truncated_remainder(a: Column, b: Column) -> Column:
    return F.try_mod(a, b).cast("long")


def divmod_(a: Column, b: Column) -> Column:
    return F.struct(floor_div(a, b).alias("quotient"), floor_mod(a, b).alias("modulo"))


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def between(x: Column, lo: Column, hi: Column) -> Column:
    return (x >= lo) & (x <= hi)


def bit_length(x: Column) -> Column:
    """Bits without the sign: 0 for 0 and -1."""
    magnitude = F.when(x < 0, -x - 1).otherwise(x)
    return F.when(magnitude == 0, 0).otherwise(F.length(F.bin(magnitude))).cast("long")


def spaceship(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0).cast("long")


def to_base(x: Column, base: int) -> Column:
    """Digits of x in a base, lower case, with a minus sign for negative numbers."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(F.abs(x).cast("string"), 10, base)))


def gcd(a: Column, b: Column, steps: int = 64) -> Column:
    """Greatest common divisor of two integers."""
    pair = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair, lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.try_mod(p["x"], p["y"]).alias("y"))))
    return walk["x"]


def mask_closure(flags: list[int], most_flags: int = 6, most_values: int = 16) -> list[int] | tuple[int, int] | None:
    """All values that OR-ing some of the flags gives: a list, an interval when there are too many, None for too many flags."""
    if len(flags) > most_flags:
        return None
    values = {0}
    for f in flags:
        values |= {v | f for v in values}
    return sorted(values) if len(values) <= most_values else (min(values), max(values))


def mask_values(flags: Column) -> Column:
    """The sorted OR-closure of an array of flags."""
    start = F.array(F.lit(0).cast("long"))
    return F.array_sort(F.aggregate(flags, start, lambda acc, f: F.array_distinct(F.concat(acc, F.transform(acc, lambda v: v.bitwiseOR(f))))))
