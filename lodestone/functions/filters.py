"""Predicates over a document's metadata; they are plain columns, so they combine with &, | and ~ and run before anything is scored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def metadata_val(key: str, metadata: str = "metadata") -> Column:
    return F.col(metadata)[key]


def metadata_eq(key: str, value: str, metadata: str = "metadata") -> Column:
    return F.coalesce(metadata_val(key, metadata) == value, F.lit(False))


def metadata_contains(key: str, part: str, metadata: str = "metadata") -> Column:
    return F.coalesce(F.contains(metadata_val(key, metadata), F.lit(part)), F.lit(False))


def metadata_exists(key: str, metadata: str = "metadata") -> Column:
    return F.coalesce(F.map_contains_key(metadata, key), F.lit(False))


def all_of(*predicates: Column) -> Column:
    """True where all hold; of none: true."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def preview(text: Column, most: int, keep: int, mark: str = "...") -> Column:
    """At most `most` characters; longer texts show `keep` of them and the mark."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)
