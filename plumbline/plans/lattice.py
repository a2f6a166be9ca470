"""Value domains as frozen carriers, their normalisation, text and record operations: what analysis of plans works on."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Top:
    pass


@dataclass(frozen=True)
class Bot:
    pass


@dataclass(frozen=True)
class Dynamic:
    """A gradual value with what is known of it."""

    inner: object = Top()


@dataclass(frozen=True)
class Nominal:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Singleton:
    name: str


@dataclass(frozen=True)
class Constant:
    value: object


@dataclass(frozen=True)
class IntegerRange:
    lo: int | None
    hi: int | None


@dataclass(frozen=True)
class Difference:
    base: object
    removed: object


@dataclass(frozen=True)
class Refined:
    base: object
    predicate: str


@dataclass(frozen=True)
class Union:
    members: tuple


@dataclass(frozen=True)
class Intersection:
    members: tuple


@dataclass(frozen=True)
class Tuple:
    items: tuple


@dataclass(frozen=True)
class Field:
    key: object
    type: object
    optional: bool = False
    read_only: bool = False


@dataclass(frozen=True)
class Shape:
    fields: tuple
    open: bool = False


@dataclass(frozen=True)
class App:
    """A type function applied, reduced later; bound is what is known meanwhile."""

    uri: str
    args: tuple
    bound: object = Top()


@dataclass(frozen=True)
class Bound:
    """A method with its receiver."""

    receiver: object
    name: str


def constant_class(v: object) -> str:
    return "true" if v is True else "false" if v is False else "NilClass" if v is None else {int: "Integer", float: "Float", str: "String"}.get(type(v), type(v).__name__)


def _literal(v: object) -> str:
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return str(v).lower()
    return f'"{v}"' if isinstance(v, str) else str(v)


#: Intervals and differences that have names.
_RANGES = {(1, None): "positive-int", (0, None): "non-negative-int", (None, -1): "negative-int", (None, 0): "non-positive-int", (None, None): "Integer"}
_DIFFERENCES = {('String', '""'): "non-empty-string", ("Integer", "0"): "non-zero-int", ("Array", "[]"): "non-empty-array", ("Hash", "{}"): "non-empty-hash"}


def describe(t: object) -> str:
    """Short text, the same for equal carriers."""
    match t:
        case Top():
            return "top"
        case Bot():
            return "bot"
        case Dynamic(inner):
            return f"Dynamic[{describe(inner)}]"
        case Nominal(name, args):
            return name + (f"[{', '.join(map(describe, args))}]" if args else "")
        case Singleton(name):
            return f"singleton({name})"
        case Constant(value):
            return _literal(value)
        case IntegerRange(lo, hi):
            return _RANGES.get((lo, hi)) or f"int<{'min' if lo is None else lo}, {'max' if hi is None else hi}>"
        case Difference(base, removed):
            return _DIFFERENCES.get((describe(base).split("[")[0], describe(removed))) or f"{describe(base)} - {describe(removed)}"
        case Refined(_, predicate):
            return f"{predicate}-string"
        case Union(members):
            return " | ".join(map(describe, members))
        case Intersection(members):
            return " & ".join(map(describe, members))
        case Tuple(items):
            return f"[{', '.join(map(describe, items))}]"
        case Shape(fields, open_):
            shown = [f"{'readonly ' * f.read_only}{'?' * f.optional}{f.key}: {describe(f.type)}" for f in fields] + ["..."] * open_
            return "{ " + ", ".join(shown) + " }" if shown else "{}"
        case Bound(_, _):
            return "Method"
        case App(uri, args, _):
            return f"App[{', '.join([uri, *map(describe, args)])}]"
    raise TypeError(t)


def union(*types: object) -> object:
    """Flat, without repeats and bot, sorted by text; top takes all; none is bot and one is itself."""
    flat: dict[str, object] = {}
    for t in types:
        for m in t.members if isinstance(t, Union) else (t,):
            if isinstance(m, Top):
                return Top()
            if not isinstance(m, Bot):
                flat[describe(m)] = m
    members = tuple(flat[k] for k in sorted(flat))
    return Bot() if not members else members[0] if len(members) == 1 else Union(members)


def intersection(*types: object) -> object:
    flat: dict[str, object] = {}
    for t in types:
        for m in t.members if isinstance(t, Intersection) else (t,):
            if isinstance(m, Bot):
                return Bot()
            if not isinstance(m, Top):
                flat[describe(m)] = m
    members = tuple(flat[k] for k in sorted(flat))
    return Top() if not members else members[0] if len(members) == 1 else Intersection(members)


def erase(t: object) -> str:
    """The plain type name left without refinements; a union with an untyped member is untyped."""
    match t:
        case Top():
            return "top"
        case Bot():
            return "bot"
        case Dynamic() | App():
            return "untyped"
        case Constant(value):
            return {"true": "bool", "false": "bool", "NilClass": "nil"}.get(constant_class(value), constant_class(value))
        case IntegerRange():
            return "Integer"
        case Difference(base, _) | Refined(base, _):
            return erase(base)
        case Union(members) | Intersection(members):
            names = list(dict.fromkeys(map(erase, members)))
            return "untyped" if "untyped" in names else (" | " if isinstance(t, Union) else " & ").join(names)
        case Tuple(items):
            return f"[{', '.join(map(erase, items))}]"
        case Shape(fields, _):
            return "{ " + ", ".join(f"{f.key}: {erase(f.type)}" for f in fields) + " }"
    return describe(t)


def partial(s: Shape) -> Shape:
    return replace(s, fields=tuple(replace(f, optional=True) for f in s.fields))


def required(s: Shape) -> Shape:
    return replace(s, fields=tuple(replace(f, optional=False) for f in s.fields))


def readonly(s: Shape) -> Shape:
    return replace(s, fields=tuple(replace(f, read_only=True) for f in s.fields))


def pick(s: Shape, keys: list) -> Shape:
    return replace(s, fields=tuple(f for f in s.fields if f.key in keys))


def omit(s: Shape, keys: list) -> Shape:
    return replace(s, fields=tuple(f for f in s.fields if f.key not in keys))


def key_of(t: Shape | Tuple) -> object:
    return union(*(Constant(f.key) for f in t.fields)) if isinstance(t, Shape) else union(*(Constant(i) for i in range(len(t.items))))


def value_of(t: Shape | Tuple) -> object:
    return union(*(f.type for f in t.fields)) if isinstance(t, Shape) else union(*t.items)


def indexed(t: object, key: object) -> object:
    """T[K]; what isn't there is top."""
    if isinstance(t, Shape):
        return next((f.type for f in t.fields if f.key == key), Top())
    if isinstance(t, Tuple) and isinstance(key, int):
        return t.items[key] if -len(t.items) <= key < len(t.items) else Top()
    return Top()


def lossy(t: object) -> bool:
    """Whether a record operation on t loses what it was meant to keep: it is no shape."""
    return not isinstance(t, (Shape, Tuple))
