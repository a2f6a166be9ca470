"""Text with where it comes from: a value and a flag that it was made of literals alone. The flag is no property of the value."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Text:
    """Operations that make text of text keep the flag only if all they are made of has it; any other result is unknown."""

    value: Column
    literal: Column

    def __add__(self, other: "Text | str") -> "Text":
        return interpolated(self, other)

    def repeated(self, times: Column | int) -> "Text":
        """A known non-negative count keeps the flag; of a negative or unknown one there is no text."""
        n = F.lit(times) if isinstance(times, int) else times
        known = F.coalesce(n >= 0, F.lit(False))
        return Text(F.when(known, F.repeat(self.value, n)), self.literal & known)

    def stripped(self, side: str = "both") -> "Text":
        return Text({"both": T.strip, "left": T.lstrip, "right": T.rstrip}[side](self.value), self.literal)

    def chomped(self) -> "Text":
        return Text(T.chomp(self.value), self.literal)

    def chopped(self) -> "Text":
        return Text(T.chop(self.value), self.literal)

    def padded(self, width: int, fill: str = " ", side: str = "left") -> "Text":
        return Text(T.pad(self.value, width, fill, side), self.literal)

    def other(self, value: Column) -> "Text":
        """A result of an operation that isn't known to keep literals apart."""
        return Text(value, F.lit(False))

    @property
    def flag(self) -> Column:
        """Whether the text is there and made of literals; never null."""
        return F.coalesce(self.literal & self.value.isNotNull(), F.lit(False))


def literal(text: str) -> Text:
    return Text(F.lit(text), F.lit(True))


def unknown(c: Column) -> Text:
    return Text(c, F.lit(False))


def _text(x: "Text | str") -> Text:
    return x if isinstance(x, Text) else literal(x)


def _all(parts: list[Text]) -> Column:
    return reduce(lambda a, b: a & b, [p.literal for p in parts], F.lit(True))


def interpolated(*parts: Text | str) -> Text:
    """Parts one after the other; a part that is null makes the whole null."""
    texts = [_text(p) for p in parts]
    return Text(F.concat(*[t.value for t in texts]), _all(texts))


def joined(parts: list[Text | str], separator: Text | str = "") -> Text:
    texts, s = [_text(p) for p in parts], _text(separator)
    if not texts:
        return literal("")
    between = [x for t in texts for x in (s, t)][1:]
    return Text(F.concat(*[t.value for t in between]), _all(between))


def formatted(template: str, *args: Text | str | int) -> Text:
    """Arguments that are texts have their own flags, constants are literal."""
    texts = [a for a in args if isinstance(a, Text)]
    return Text(F.format_string(template, *[a.value if isinstance(a, Text) else F.lit(a) for a in args]), _all(texts))
