"""Cutting a text where a byte-level BPE's pre-tokens certainly end.

A pre-token may start with white space but never holds white space after something else. So a text can be
cut before every run of white space that follows a non-space, and each unit can be tokenised alone, once.
White space is Unicode's White_Space, which is what the pre-token pattern's ``\\s`` means.
"""

from __future__ import annotations

import re

_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
starts_with_space = re.compile(f"[{_WS}]").match
find_units = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+").findall

#: Fixed value: the public pattern that splits text before the merges of byte-level BPE.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
