"""Tuple, record and block functions over arrays and maps, with decided results for empty, missing and null elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def last(c: Column) -> Column:
    return F.try_element_at(c, F.lit(-1))


def at(c: Column, index: int) -> Column:
    """Negative counts from the end; null outside."""
    return F.get(c, F.lit(index)) if index >= 0 else F.try_element_at(c, F.lit(index))


def normal_index(c: Column, index: Column) -> Column:
    n = F.size(c)
    i = F.when(index < 0, index + n).otherwise(index)
    return F.when((i >= 0) & (i < n), i)


def slice_(c: Column, start: int, length: int) -> Column:
    """Null when start is beyond the size or length is negative; else as many elements as there are."""
    n = F.size(c)
    begin = F.when(F.lit(start) < 0, F.lit(start) + n).otherwise(F.lit(start))
    ok = (begin >= 0) & (begin <= n) & F.lit(length >= 0)
    return F.when(ok & (begin < n) & F.lit(length > 0), F.slice(c, F.greatest(begin, F.lit(0)) + 1, F.lit(max(length, 1)))).when(ok, F.filter(c, lambda _: F.lit(False)))


def include(c: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(c, value), F.lit(False))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def zip_to(c: Column, other: Column) -> Column:
    """Of the receiver's length; null where other is shorter."""
    return F.transform(c, lambda x, i: F.struct(x.alias("left"), F.get(other, i).alias("right")))


def unique(c: Column) -> Column:
    return F.array_distinct(c)


def compact(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def all_(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.forall(c, lambda x: F.coalesce(f(x), F.lit(False)))


def any_(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.exists(c, lambda x: F.coalesce(f(x), F.lit(False)))


def none_(c: Column, f: Callable[[Column], Column]) -> Column:
    return ~any_(c, f)


def count_(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(c, f)).cast("long")


def detect(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(c, f), F.lit(0))


def detect_index(c: Column, f: Callable[[Column], Column]) -> Column:
    """Position of the first element for which f holds, else null."""
    p = F.array_position(F.transform(c, lambda x: F.coalesce(f(x), F.lit(False))), True)
    return F.when(p > 0, p - 1)


def take_while(c: Column, f: Callable[[Column], Column]) -> Column:
    stop = detect_index(c, lambda x: ~F.coalesce(f(x), F.lit(False)))
    return F.when(stop.isNull(), c).when(stop > 0, F.slice(c, F.lit(1), F.greatest(stop, F.lit(1)).cast("int"))).otherwise(F.filter(c, lambda _: F.lit(False)))


def drop_while(c: Column, f: Callable[[Column], Column]) -> Column:
    stop = detect_index(c, lambda x: ~F.coalesce(f(x), F.lit(False)))
    return F.when(stop.isNull(), F.filter(c, lambda _: F.lit(False))).otherwise(F.filter(c, lambda _, i: i >= stop))


def partition_(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(F.filter(c, lambda x: F.coalesce(f(x), F.lit(False))).alias("yes"), F.filter(c, lambda x: ~F.coalesce(f(x), F.lit(False))).alias("no"))


def filter_map(c: Column, f: Callable[[Column], Column]) -> Column:
    return compact(F.transform(c, f))


def flat_map(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(c, f))


def each_cons(c: Column, n: int) -> Column:
    count = F.size(c) - n + 1
    starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(c, s, F.lit(n)))


def each_slice(c: Column, n: int) -> Column:
    count = F.ceil(F.size(c) / n).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(c, s * n + 1, F.lit(n)))


def times(n: Column) -> Column:
    """0 to n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def upto(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def downto(a: Column, b: Column) -> Column:
    return F.when(a >= b, F.sequence(a, F.least(a, b), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def record_invert(m: Column) -> Column:
    """Values to keys; null (declined) when a value comes twice."""
    values = F.map_values(m)
    return F.when(F.size(F.array_distinct(values)) == F.size(values), F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"]))))


def record_merge(left: Column, right: Column) -> Column:
    """Right wins; left's keys keep their places."""
    keys = F.array_union(F.map_keys(left), F.map_keys(right))
    value = lambda k: F.coalesce(F.try_element_at(right, k), F.try_element_at(left, k))
    return F.map_from_arrays(keys, F.transform(keys, value))


def record_compact(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def values_at(m: Column, *keys: str) -> Column:
    return F.array(*[F.try_element_at(m, F.lit(k)) for k in keys])


def pairs_to_record(pairs: Column) -> Column:
    """Null (declined) when a key comes twice."""
    keys = F.transform(pairs, lambda p: p[0])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs)))
