"""Narrowing: what a predicate says of a column's domain on its truthy and its falsey edge.

A domain is a set of integers as an interval or as literals, or "any", with nil in it or not. Predicates are small trees. A row whose
predicate is null is on neither edge in SQL; here it is on the falsey one, so filters use keep() and drop().
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """lo and hi: None is unbounded; literals: a finite set instead; empty: nothing is possible."""

    lo: int | None = None
    hi: int | None = None
    literals: frozenset | None = None
    nil: bool = False
    empty: bool = False

    def values(self, keep) -> Domain:
        """The literals for which keep holds."""
        left = frozenset(v for v in self.literals if keep(v))
        return replace(self, literals=left, empty=not left)

    def bounds(self) -> tuple[int | None, int | None]:
        if self.literals is not None:
            return (min(self.literals), max(self.literals)) if self.literals else (None, None)
        return self.lo, self.hi

    def describe(self) -> str:
        if self.empty and not self.nil:
            return "bot"
        if self.literals is not None:
            text = " | ".join(sorted(map(str, self.literals)))
        elif self.lo is not None and self.lo == self.hi:
            text = str(self.lo)
        else:
            text = {(None, None): "Integer", (1, None): "positive-int", (0, None): "non-negative-int", (None, -1): "negative-int", (None, 0): "non-positive-int"}.get((self.lo, self.hi)) or f"int<{'min' if self.lo is None else self.lo}, {'max' if self.hi is None else self.hi}>"
        return f"{text} | nil" if self.nil and not self.empty else "nil" if self.nil else text


MOST_LITERALS = 8  # more distinct values are a wider domain


def literal_domain(df: DataFrame, column: str) -> Domain:
    """The domain of df's column: its literals while there are eight at most, else any value (integers: from the least to the
    greatest). Runs a job; no more than nine values reach the driver."""
    c = F.col(f"`{column}`")
    few = [r[0] for r in df.select(c.alias("v")).where("v is not null").distinct().limit(MOST_LITERALS + 1).collect()]
    r = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(c.isNull()).alias("nil")).first()
    if len(few) <= MOST_LITERALS:
        return Domain(literals=frozenset(few), nil=r["nil"] > 0, empty=not few)
    whole = df.schema[column].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return Domain(r["lo"] if whole else None, r["hi"] if whole else None, nil=r["nil"] > 0)


@dataclass(frozen=True)
class Test:
    __test__ = False  # no test of pytest's
    """op: a comparison with value, "between" with value (lo, hi), "nil", "and", "or" or "not" over parts."""

    op: str
    value: object = None
    parts: tuple = ()


#: An operator's opposite, and what it is with its operands swapped.
OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}
SWAPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
METHODS = {"positive?": Test(">", 0), "negative?": Test("<", 0), "zero?": Test("==", 0), "nonzero?": Test("!=", 0)}
_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def meet(d: Domain, lo: int | None, hi: int | None) -> Domain:
    if d.literals is not None:
        return d.values(lambda v: (lo is None or v >= lo) and (hi is None or v <= hi))
    low = lo if d.lo is None else d.lo if lo is None else max(lo, d.lo)
    high = hi if d.hi is None else d.hi if hi is None else min(hi, d.hi)
    return replace(d, lo=low, hi=high, empty=d.empty or (low is not None and high is not None and low > high))


def compared(d: Domain, op: str, v: int) -> Domain:
    """The part of d for which `x op v` may hold; nil compares with nothing but by == and !=."""
    d = replace(d, nil=d.nil and op == "!=")
    if d.literals is not None:
        return d.values(lambda x: _COMPARE[op](x, v))
    if op == "!=":  # only an end can be trimmed
        if d.lo == v and d.hi == v:
            return replace(d, empty=True)
        return replace(d, lo=d.lo + 1 if d.lo == v else d.lo, hi=d.hi - 1 if d.hi == v else d.hi)
    return meet(d, *{"<": (None, v - 1), "<=": (None, v), ">": (v + 1, None), ">=": (v, None), "==": (v, v)}[op])


def join(a: Domain, b: Domain) -> Domain:
    """Least domain that holds both."""
    nil = a.nil or b.nil
    if a.empty or b.empty:
        return replace(b if a.empty else a, nil=nil)
    if a.literals is not None and b.literals is not None:
        return Domain(literals=a.literals | b.literals, nil=nil)
    (al, ah), (bl, bh) = a.bounds(), b.bounds()
    return Domain(None if al is None or bl is None else min(al, bl), None if ah is None or bh is None else max(ah, bh), nil=nil)


def narrow(d: Domain, t: Test) -> tuple[Domain, Domain]:
    """The domain on the truthy and on the falsey edge."""
    if t.op == "nil":
        return replace(d, empty=True), replace(d, nil=False)
    if t.op == "not":
        return narrow(d, t.parts[0])[::-1]
    if t.op == "and":
        truthy, falsey = d, []
        for p in t.parts:
            truthy, f = narrow(truthy, p)
            falsey.append(f)
        out = falsey[0]
        for f in falsey[1:]:
            out = join(out, f)
        return truthy, out
    if t.op == "or":
        return narrow(d, Test("not", parts=(Test("and", parts=tuple(Test("not", parts=(p,)) for p in t.parts)),)))
    if t.op == "between":
        return meet(replace(d, nil=False), *t.value), d  # what lies outside is two halves: the falsey edge keeps all
    return compared(d, t.op, t.value), replace(compared(d, OPPOSITE[t.op], t.value), nil=d.nil)


def condition(c: Column, t: Test) -> Column:
    if t.op == "nil":
        return c.isNull()
    if t.op == "not":
        return ~F.coalesce(condition(c, t.parts[0]), F.lit(False))
    if t.op in ("and", "or"):
        out = condition(c, t.parts[0])
        for p in t.parts[1:]:
            out = out & condition(c, p) if t.op == "and" else out | condition(c, p)
        return out
    if t.op == "between":
        return c.between(*t.value)
    return {"<": c < t.value, "<=": c <= t.value, ">": c > t.value, ">=": c >= t.value, "==": c == t.value, "!=": c != t.value}[t.op]


def keep(c: Column, t: Test) -> Column:
    return F.coalesce(condition(c, t), F.lit(False))


def drop(c: Column, t: Test) -> Column:
    return ~keep(c, t)


def arms(d: Domain, tests: list[Test]) -> tuple[list[Domain], Domain]:
    """case/when: the domain in each arm, which sees what the arms before it left, and in the else."""
    out = []
    for t in tests:
        truthy, d = narrow(d, t)
        out.append(truthy)
    return out, d


def halves(d: Domain) -> list[Domain]:
    """Complement of an interval inside the integers."""
    out = []
    if d.lo is not None:
        out.append(Domain(None, d.lo - 1))
    if d.hi is not None:
        out.append(Domain(d.hi + 1, None))
    return out


#: What is known of text after a test: a fact with the edge it holds on.
def text_facts(target: str, method: str, argument: str) -> list[tuple[str, str, str, str, str]]:
    """(bucket, target, predicate, payload, polarity) of start_with?, end_with? and include?."""
    return [("relational", target, method, argument, p) for p in ("positive", "negative")]


def complement_of_difference(members: Column, base: str, removed: Column, above: dict[str, tuple[str, ...]] | None = None) -> Column:
    """What the falsey edge of "a base other than removed" leaves of a union: members of no kin to base, and removed once if one may be it.

    members: array of cls, value (null: all of the class); removed: a value of base, as text. above: ancestors by class; classes of
    which one lies above the other are kin. If nothing is left the union stays as it is; nulls among the members go.
    """
    kin = {base, *(above or {}).get(base, ()), *(k for k, v in (above or {}).items() if base in v)}
    whole = F.lit(base)

    def covers(x: Column) -> Column:
        own = x["cls"].isin(sorted({base, *(above or {}).get(base, ())}))
        return (own & x["value"].isNull()) | ((x["cls"] == whole) & (x["value"] == removed))

    there = F.filter(members, lambda x: x.isNotNull() & x["cls"].isNotNull())
    others = F.filter(there, lambda x: ~x["cls"].isin(sorted(kin)))
    one = F.array(F.struct(whole.alias("cls"), removed.cast("string").alias("value")))
    out = F.when(F.exists(there, lambda x: F.coalesce(covers(x), F.lit(False))), F.concat(others, one)).otherwise(others)
    return F.when(F.size(out) == 0, members).otherwise(F.array_distinct(out))
