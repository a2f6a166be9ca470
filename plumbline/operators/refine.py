"""Refinements: named predicates that narrow a base type, as Columns; their names' parser; resolvers.

A refinement's payload is a name (``lowercase-string``), a name with bounds (``int<0, max>``) or with element types
(``non-empty-array[positive-int]``), an element of a tuple, array or hash (``Tuple[int<0, 9>, nil][0]``), their keys or values (``key_of[Hash[non-empty-string, nil]]``), the sums of flags (``int_mask[1, 2, 4]``,
``int_mask_of[1 | 2]``), or a union of payloads and literals (``positive-int | "none" | nil``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]

#: The patterns of the string refinements. They hold for the whole value, so line feeds don't matter.
NUMERIC = r"\A-?[0-9]+(?:\.[0-9]+)?\z"
DECIMAL = r"\A-?[0-9]+\z"
OCTAL = r"\A-?(?:0[oO][0-7]+|0[0-7]+)\z"
HEX = r"\A-?0[xX][0-9a-fA-F]+\z"


def interval(lo: int | None, hi: int | None) -> Predicate:
    def holds(c: Column) -> Column:
        out = F.lit(True)
        if lo is not None:
            out = out & (c >= lo)
        if hi is not None:
            out = out & (c <= hi)
        return F.when(c.isNotNull(), out)

    return holds


def mask(flags: list[int]) -> Predicate:
    """What some of the flags give, or'ed: the flags inside a value make it up."""

    def holds(c: Column) -> Column:
        out = F.lit(0).cast("long")
        for f in flags:
            out = out.bitwiseOR(F.when(c.bitwiseAND(f) == f, f).otherwise(0).cast("long"))
        return F.when(c.isNotNull(), out == c)

    return holds


STRINGS: dict[str, Predicate] = {
    "non-empty-string": lambda c: c != "",
    "lowercase-string": lambda c: c == F.lower(c),
    "uppercase-string": lambda c: c == F.upper(c),
    "numeric-string": lambda c: c.rlike(NUMERIC),
    "decimal-int-string": lambda c: c.rlike(DECIMAL),
    "octal-int-string": lambda c: c.rlike(OCTAL),
    "hex-int-string": lambda c: c.rlike(HEX),
}
#: Names whose complement inside the base type has a name.
COMPLEMENTS = {"lowercase-string": "non-lowercase-string", "uppercase-string": "non-uppercase-string", "numeric-string": "non-numeric-string"}
for _name, _other in COMPLEMENTS.items():
    STRINGS[_other] = lambda c, f=STRINGS[_name]: ~f(c)
STRINGS["non-empty-lowercase-string"] = lambda c: (c != "") & STRINGS["lowercase-string"](c)
STRINGS["non-empty-uppercase-string"] = lambda c: (c != "") & STRINGS["uppercase-string"](c)
# where a value came from is no test of the value: these two hold for any (non-empty) string
STRINGS["literal-string"] = lambda c: c.isNotNull()
STRINGS["non-empty-literal-string"] = lambda c: c != ""

INTEGERS: dict[str, Predicate] = {
    "non-zero-int": lambda c: c != 0,
    "positive-int": interval(1, None),
    "non-negative-int": interval(0, None),
    "negative-int": interval(None, -1),
    "non-positive-int": interval(None, 0),
}
COLLECTIONS: dict[str, Predicate] = {
    "non-empty-array": lambda c: F.size(c) > 0,
    "non-empty-hash": lambda c: F.size(c) > 0,
}
NAMES: dict[str, Predicate] = {**STRINGS, **INTEGERS, **COLLECTIONS}


def complement(name: str) -> Predicate:
    """What the base type holds besides the refinement; null stays null."""
    f = NAMES[name]
    return lambda c: ~f(c)


#: What a capture group of one repeated class says of its text.
CAPTURES = {r"\d": "decimal-int-string", r"[0-9]": "decimal-int-string", r"[a-z]": "lowercase-string", r"[A-Z]": "uppercase-string", r"[0-7]": "octal-int-string", r"\h": "hex-int-string", r"[0-9a-f]": "hex-int-string", r"[[:digit:]]": "numeric-string"}


#: What a method leaves of a string's refinement. Digits have no case; the texts of ``to_i`` have no sign.
PROJECTIONS = {
    ("lowercase-string", "downcase"): "lowercase-string", ("lowercase-string", "upcase"): "uppercase-string",
    ("uppercase-string", "upcase"): "uppercase-string", ("uppercase-string", "downcase"): "lowercase-string",
    ("numeric-string", "downcase"): "numeric-string", ("numeric-string", "upcase"): "numeric-string",
    ("decimal-int-string", "downcase"): "decimal-int-string", ("decimal-int-string", "upcase"): "decimal-int-string",
    ("octal-int-string", "downcase"): "octal-int-string", ("octal-int-string", "upcase"): "octal-int-string",
    ("hex-int-string", "downcase"): "hex-int-string", ("hex-int-string", "upcase"): "hex-int-string",
    ("decimal-int-string", "to_i"): "non-negative-int", ("decimal-int-string", "to_int"): "non-negative-int",
    ("numeric-string", "to_i"): "non-negative-int", ("numeric-string", "to_int"): "non-negative-int",
}


def _leading_integer(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"\A([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


METHODS: dict[str, Predicate] = {"downcase": F.lower, "upcase": F.upper, "to_i": _leading_integer, "to_int": _leading_integer}


def unprojected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """column, refinement, method, result, n, broken: for every method that a column's refinement says something of, how many
    values that satisfy the refinement have a result outside the projected one. columns: name to refinement; one aggregate for all.

    Nulls and values outside their refinement count for nothing.
    """
    asked = [(c, r, m, out) for c, r in columns.items() for (of, m), out in PROJECTIONS.items() if of == r]
    totals = []
    for i, (c, r, m, out) in enumerate(asked):
        v = F.col(f"`{c}`")
        fits = F.coalesce(NAMES[r](v), F.lit(False))
        totals += [F.count_if(fits).alias(f"n{i}"), F.count_if(fits & ~F.coalesce(NAMES[out](METHODS[m](v)), F.lit(False))).alias(f"b{i}")]
    rows = [F.struct(*[F.lit(x).alias(k) for k, x in zip(("column", "refinement", "method", "result"), a)], F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("broken")) for i, a in enumerate(asked)]
    if not rows:
        raise ValueError("no method is known of these refinements")
    return df.agg(*totals).select(F.inline(F.array(*rows)))


def capture_refinement(body: str) -> str | None:
    """Refinement of a group's text from its pattern: one known class, repeated once at least."""
    m = re.fullmatch(r"(\\d|\\h|\[\[:digit:\]\]|\[[^\]]+\])(\+|\{(\d+)(?:,(\d*))?\})", body)
    if not m or m[1] not in CAPTURES:
        return None
    if m[2] != "+":
        least = int(m[3])
        if least < 1 or (m[4] and int(m[4]) < least):
            return None
    return CAPTURES[m[1]]


@dataclass(frozen=True)
class Node:
    """A parsed payload: name with arguments, "literal" with a value, "union" with members, or "at" with a payload and a key."""

    name: str
    args: tuple = ()


_TOKEN = re.compile(r"""\s*(?:(-?\d+)|([A-Za-z_][\w-]*)|("(?:[^"\\]|\\.)*")|(:[A-Za-z_]\w*)|([\[\]<>,|]))""")


def parse(payload: str) -> Node | None:
    """The payload's tree, None where it isn't well formed."""
    tokens, at = [], 0
    payload = payload.rstrip()
    while at < len(payload):
        m = _TOKEN.match(payload, at)
        if not m:
            return None
        tokens.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    place = 0

    def take(*symbols: str) -> str | None:
        nonlocal place
        if place < len(tokens) and tokens[place][0] == 5 and tokens[place][1] in symbols:
            place += 1
            return tokens[place - 1][1]
        return None

    def union() -> Node:
        members = [single()]
        while take("|"):
            members.append(single())
        return members[0] if len(members) == 1 else Node("union", tuple(members))

    def single() -> Node:
        nonlocal place
        if place >= len(tokens) or tokens[place][0] == 5:
            raise ValueError(payload)
        kind, text = tokens[place]
        place += 1
        if kind == 1:
            return Node("literal", (int(text),))
        if kind == 3:
            return Node("literal", (text[1:-1],))
        if kind == 4:
            return Node("literal", (text[1:],))
        if opened := take("[", "<"):
            args = [union()]
            while take(","):
                args.append(union())
            if not take({"[": "]", "<": ">"}[opened]):
                raise ValueError(payload)
            out = Node(text, tuple(args))
            while take("["):
                out = Node("at", (out, union()))
                if not take("]"):
                    raise ValueError(payload)
            return out
        return Node(text)

    try:
        tree = union()
    except ValueError:
        return None
    return tree if place == len(tokens) else None


Resolver = Callable[[Node], "Predicate | None"]


def resolve(node: Node, more: tuple[Resolver, ...] = ()) -> Predicate | None:
    """The first resolver's answer that isn't None; None for an unknown name."""
    for r in (*more, _built_in):
        if (f := r(node)) is not None:
            return f
    return None


def _bound(node: Node) -> int | None:
    return None if node.name in ("min", "max") else node.args[0]


#: Containers whose elements have one type, which is their last argument, and which argument that is.
VALUES_AT = {"Array": 0, "non-empty-array": 0, "Hash": 1, "non-empty-hash": 1}


def _built_in(node: Node) -> Predicate | None:
    if node.name == "union":
        parts = [_built_in(x) for x in node.args]
        if any(p is None for p in parts):
            return None

        def any_of(c: Column) -> Column:
            out = F.coalesce(parts[0](c), F.lit(False))
            for p in parts[1:]:
                out = out | F.coalesce(p(c), F.lit(False))
            return out

        return any_of
    if node.name == "literal":
        return lambda c: c == F.lit(node.args[0])
    if node.name == "nil":
        return lambda c: c.isNull()
    if node.name == "int" and len(node.args) == 2:
        return interval(_bound(node.args[0]), _bound(node.args[1]))
    if node.name == "at":
        of, key = node.args
        place = key.args[0] if key.name == "literal" else None
        if of.name in VALUES_AT and len(of.args) == VALUES_AT[of.name] + 1:
            return None if of.name.endswith(("Array", "array")) and type(place) is not int else _built_in(of.args[-1])
        return _built_in(of.args[place]) if of.name == "Tuple" and type(place) is int and 0 <= place < len(of.args) else None
    if node.name in ("key_of", "value_of") and len(node.args) == 1:
        of = node.args[0]
        if of.name == "Tuple" and of.args:
            return interval(0, len(of.args) - 1) if node.name == "key_of" else _built_in(Node("union", of.args))
        if of.name in VALUES_AT and len(of.args) == VALUES_AT[of.name] + 1:
            if node.name == "value_of":
                return _built_in(of.args[-1])
            return _built_in(of.args[0]) if len(of.args) == 2 else interval(0, None)
        return None
    if node.name in ("int_mask", "int_mask_of"):
        flags = node.args[0].args if len(node.args) == 1 and node.args[0].name == "union" else node.args
        if not flags or any(x.name != "literal" or type(x.args[0]) is not int or x.args[0] < 0 for x in flags):
            return None
        return mask([x.args[0] for x in flags])
    if node.name in ("Array", "non-empty-array") and len(node.args) == 1:
        each = _built_in(node.args[0])
        if each is None:
            return None
        least = int(node.name != "Array")
        return lambda c: (F.size(c) >= least) & F.forall(c, lambda x: F.coalesce(each(x), F.lit(False)))
    if node.name in ("Hash", "non-empty-hash") and len(node.args) == 2:
        key, value = (_built_in(x) for x in node.args)
        if key is None or value is None:
            return None
        least = int(node.name != "Hash")
        return lambda c: (F.size(c) >= least) & F.forall(F.map_entries(c), lambda x: F.coalesce(key(x["key"]) & value(x["value"]), F.lit(False)))
    if not node.args:
        return NAMES.get(node.name)
    return None


def compile_payload(payload: str, more: tuple[Resolver, ...] = ()) -> Predicate | None:
    tree = parse(payload)
    return None if tree is None else resolve(tree, more)
