"""The few text functions that no built-in expresses: normal forms, successors, path algebra. Arrow batches, never single rows."""

from __future__ import annotations

import posixpath
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _mapped(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return F.pandas_udf(run, "string")


def unicode_normalize(c: Column, form: str = "NFC") -> Column:
    return _mapped(lambda x: unicodedata.normalize(form, x))(c)


def successor(text: str) -> str:
    """The next text: the rightmost letter or digit is raised and carries to the left; without any, the last character is raised."""
    if not text:
        return ""
    alnum = [i for i, ch in enumerate(text) if ch.isascii() and ch.isalnum()]
    if not alnum:
        out = list(text)
        i = len(out) - 1
        while i >= 0 and ord(out[i]) == 0x10FFFF:
            out[i] = "\x00"
            i -= 1
        if i < 0:
            return "\x01" + "".join(out)
        out[i] = chr(ord(out[i]) + 1)
        return "".join(out)
    out, last = list(text), alnum[-1]
    for i in reversed(alnum):
        if last - i > 1 and out[i].isdigit() != text[last].isdigit():
            break  # over a gap a carry passes only from digit to digit or letter to letter
        last = i
        ch = out[i]
        if ch == "z":
            out[i] = "a"
        elif ch == "Z":
            out[i] = "A"
        elif ch == "9":
            out[i] = "0"
        else:
            out[i] = chr(ord(ch) + 1)
            return "".join(out)
    out.insert(last, {"a": "a", "A": "A", "0": "1"}[out[last]])
    return "".join(out)


def succ(c: Column) -> Column:
    return _mapped(successor)(c)


def cleanpath(c: Column) -> Column:
    """Without empty, ``.`` and resolvable ``..`` parts."""
    return _mapped(lambda p: posixpath.normpath(p).replace("//", "/") if p else ".")(c)


def relative_path(c: Column, base: str) -> Column:
    return _mapped(lambda p: posixpath.relpath(p, base) if p.startswith("/") == base.startswith("/") else None)(c)
