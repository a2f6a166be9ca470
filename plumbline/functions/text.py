"""String functions with the semantics of a scripting language's standard string class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What strip removes at either end: white space of ASCII and NUL.
BLANK = r"[\x00\x09-\x0D\x20]"


def strip(c: Column) -> Column:
    return rstrip(lstrip(c))


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{BLANK}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{BLANK}+\z", "")


def chomp(c: Column) -> Column:
    """Without one line end."""
    return F.regexp_replace(c, r"(\r\n|\n|\r)\z", "")


def chop(c: Column) -> Column:
    """Without the last character, or a whole CR LF."""
    return F.regexp_replace(c, r"(?s)(\r\n|.)\z", "")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def swapcase_ascii(c: Column) -> Column:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, lower + upper, upper + lower)


def split_on(c: Column, separator: str) -> Column:
    """Fields between separators, without empty ones at the end."""
    import re

    fields = F.split(c, re.escape(separator))
    kept = F.aggregate(fields, F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), lambda a, x: F.struct((a["n"] + 1).alias("n"), F.when(x != "", a["n"] + 1).otherwise(a["last"]).alias("last")))
    return F.slice(fields, F.lit(1), kept["last"])


def lines(c: Column) -> Column:
    """Lines with their line feeds; none for an empty text."""
    return F.regexp_extract_all(c, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


def characters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0))


def scan(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def tr(c: Column, old: str, new: str) -> Column:
    """Characters replaced one by one; the last of new stands for all further ones."""
    padded = new + new[-1] * max(0, len(old) - len(new)) if new else ""
    return F.translate(c, old, padded)


def delete(c: Column, characters_: str) -> Column:
    return F.translate(c, characters_, "")


def count_in(c: Column, characters_: str) -> Column:
    return (F.length(c) - F.length(delete(c, characters_))).cast("long")


def pad(c: Column, width: int, fill: str, side: str) -> Column:
    """ljust, rjust or center: never shorter than the text itself."""
    n = F.length(c)
    short = F.greatest(F.lit(width) - n, F.lit(0))
    left = {"left": F.lit(0), "right": short, "center": F.floor(short / 2).cast("int")}[side]
    whole = F.lit(fill * (width // max(1, len(fill)) + 1))
    return F.concat(F.left(whole, left), c, F.left(whole, short - left))


def partition(c: Column, separator: str, last: bool = False) -> Column:
    """struct(head, separator, tail); without the separator all is head (last: all is tail)."""
    n = F.length(F.lit(separator))
    at = F.instr(c, separator) if not last else F.when(F.instr(c, separator) > 0, F.length(c) - n - F.instr(F.reverse(c), separator[::-1]) + 2).otherwise(0)
    head = F.when(at > 0, F.left(c, at - 1)).otherwise("" if last else c)
    tail = F.when(at > 0, F.substr(c, at + n)).otherwise(c if last else "")
    return F.struct(head.alias("head"), F.when(at > 0, separator).otherwise("").alias("separator"), tail.alias("tail"))


def delete_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def delete_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def to_integer(c: Column) -> Column:
    """The integer a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(c, r"\A\s*([-+]?[0-9]{1,18})", 1).try_cast("long"), F.lit(0).cast("long"))


def ordinal(c: Column) -> Column:
    return F.ascii(c).cast("long")


def basename(c: Column) -> Column:
    return F.when(c.rlike(r"\A/+\z"), "/").otherwise(F.regexp_extract(c, r"([^/]*)/*\z", 1))


def dirname(c: Column) -> Column:
    head = F.regexp_replace(F.regexp_replace(c, r"/*[^/]*/*\z", ""), r"/+\z", "")
    return F.when(head != "", head).when(c.startswith("/"), "/").otherwise(".")


def extname(c: Column) -> Column:
    """With its dot; none for a leading dot or one at the end."""
    return F.regexp_extract(basename(c), r"\A.*[^.](\.[^.]+)\z", 1)


def is_absolute(c: Column) -> Column:
    return c.startswith("/")
