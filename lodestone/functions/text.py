"""Tokens of a text: lower-case runs of letters (with the marks that spell them) and digits of any alphabet."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"
_SPLIT = regex.compile(r"[^\p{Alphabetic}\p{N}]+")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda t: t != "")


def tokens_of(text: str) -> list[str]:
    """The same on the driver, for queries."""
    return [t for t in _SPLIT.split(text.lower()) if t]
