"""Word tokenisation as a JVM regular expression (no Python on the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.semantics import col

# Word token: digit runs joined by . , ; ' (10,000 / 3.5), letter runs (with marks) joined
# by ' ’ . : · (don't, l’impôt, u.s.a), and underscores glued to either (10,000_l, _on_).
# Lower-casing happens before matching, so tokens come out lower-case. No look-around, so
# the same pattern runs in Java regex and RE2.
TOKEN_PATTERN = r"(?:\p{Nd}+(?:[.,;']\p{Nd}+)*|[\p{L}\p{M}]+(?:['’.:·][\p{L}\p{M}]+)*|_)+"


def token_array(text: str | Column, pattern: str = TOKEN_PATTERN) -> Column:
    """All word tokens of the lower-cased text, in order, as an array<string>."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(pattern), F.lit(0))

